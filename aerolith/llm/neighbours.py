"""Operator 9, approximate nearest neighbours: inverted lists scanned with an adaptive number of dimensions.

A bounded sample gives the lists' centroids (k-means in numpy); every vector is put in the list of its nearest centroid.
A query scans the lists of its nearest centroids, as many as hold RECALL of the true nearest of a sample of the queries,
whose distances to all vectors are measured. Within a list vectors are turned by one random rotation and read in
blocks of columns. After t of D columns the distance so far, scaled by D / t, estimates the whole; a candidate is given
up where a test says that its distance exceeds the query's bound: sqrt(D / t) * partial > (1 + EPSILON / sqrt(t)) * bound,
the bound being the distance of the last of the nearest among the candidates that looked best after the first block.
What is left is measured exactly, on the original vectors in double precision.

Copies of one vector tie, so only the smallest ids among them can be in a result: of each distinct vector the k + 1
smallest ids are indexed, and a vector asked for by many queries is searched once. Long lists are split into blocks by a
hash of the id, and queries of a list into blocks likewise, so no task holds a whole list of unbounded length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.llm import common

NEAREST = 10
#: Bounds of the sample that the centroids are fitted on, lowest hash of the id first: so many vectors at least (if there
#: are), and so many for each list.
SAMPLE, SAMPLE_PER_LIST = 16_384, 32
#: Vectors a list is meant to hold, bound of the number of lists, least number of lists that a query scans.
PER_LIST, MOST_LISTS, PROBES = 512, 4096, 16
#: Queries that are compared with all vectors, and the share of their nearest that the scanned lists must hold.
TRIALS, RECALL = 128, 0.95
#: Vectors, and queries, of a list that one task takes.
LIST_BLOCK, QUERY_BLOCK = 20_000, 2_000
COLUMNS, EPSILON, ROUNDS, SEED = 16, 2.1, 8, 7


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part: distinct pairs, no null, zero or non-finite vector, no null id."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """k-means; a list that loses all its vectors starts again from one drawn at random."""
    random = np.random.default_rng(seed)
    centre = sample[random.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        own = _closest(sample, centre, 1)[:, 0]
        count = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], sample[random.integers(0, len(sample), len(centre))])
    return centre


def _closest(rows: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest centroids of each row, nearest first."""
    out = np.empty((len(rows), k), np.int64)
    for lo in range(0, len(rows), 2048):
        far = (centre * centre).sum(axis=1) - 2 * rows[lo : lo + 2048] @ centre.T
        some = np.argpartition(far, k - 1, axis=1)[:, :k] if k < len(centre) else np.broadcast_to(np.arange(len(centre)), far.shape)
        out[lo : lo + 2048] = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)
    return out


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def scan(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, k: int, turn: np.ndarray, epsilon: float = EPSILON) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and distances of the k nearest rows that the tests left, nearest first, ties to smaller ids.

    The candidates whose distances gave the bound are never given up, so k rows are left where there are so many.
    """
    d = rows.shape[1]
    turned, asked = rows @ turn, queries @ turn
    for query, q in zip(queries, asked, strict=True):
        left, partial, bound, t = np.arange(len(rows)), np.zeros(len(rows)), np.inf, 0
        measured = np.zeros(len(rows), bool)
        while t < d:
            upto = min(t + COLUMNS, d)
            step = turned[left, t:upto] - q[t:upto]
            partial += np.einsum("ij,ij->i", step, step)
            t = upto
            if t < d and len(left) > 4 * k:
                if bound == np.inf:
                    best = left[np.argpartition(partial, 4 * k)[: 4 * k]]
                    bound = np.partition(_distances(rows[best], query), k - 1)[k - 1]
                    measured[best] = True
                keep = measured[left] | (np.sqrt(partial * (d / t)) <= (1 + epsilon / np.sqrt(t)) * bound)
                left, partial = left[keep], partial[keep]
        far = _distances(rows[left], query)
        order = np.lexsort((ids[left], far))[:k]
        yield ids[left][order], far[order]


def _distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, squares added in order of the columns."""
    total = np.zeros(len(rows))
    for column, x in zip(rows.T, query, strict=True):
        total += (column - x) * (column - x)
    return np.sqrt(total)


def measured_probes(listed: DataFrame, asked: DataFrame, centre: np.ndarray, k: int) -> int:
    """How many lists nearest to a query hold RECALL of the k nearest vectors, from TRIALS queries against all of listed."""
    trials = asked.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(TRIALS).toArrow().combine_chunks()
    if not len(trials):
        return 1
    own, queries = trials.column("id").to_numpy(), _matrix(trials.column("v").combine_chunks(), centre.shape[1])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, ids, lists = np.zeros((len(own), 0)), np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0), np.int64)
        for batch in batches:
            rows = _matrix(batch.column(1), queries.shape[1])
            step = (queries * queries).sum(axis=1)[:, None] + (rows * rows).sum(axis=1) - 2 * queries @ rows.T
            i, at = (np.broadcast_to(batch.column(c).to_numpy(), step.shape) for c in (0, 2))
            far, ids, lists = np.hstack([far, np.where(i == own[:, None], np.inf, step)]), np.hstack([ids, i]), np.hstack([lists, at])
            best = np.argsort(far, axis=1, kind="stable")[:, :k]
            far, ids, lists = (np.take_along_axis(x, best, 1) for x in (far, ids, lists))
        q, place = np.nonzero(np.isfinite(far))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(far[q, place]), pa.array(ids[q, place]), pa.array(lists[q, place])], ["q", "far", "id", "list"])

    found = listed.select("id", "v", "list").mapInArrow(nearest, "q long, far double, id long, list long")
    true = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("far", "id"))).where(F.col("n") <= k).toArrow()
    if not len(true):
        return 1
    place = np.argsort(_closest(queries, centre, len(centre)), axis=1)
    needed = np.sort(place[true.column("q").to_numpy(), true.column("list").to_numpy()] + 1)
    return int(needed[int(np.ceil(RECALL * len(needed))) - 1])


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(query_id, rank, id, score): for each query its k nearest vectors found, but those of its own id.

    Null, zero and non-finite vectors, and vectors with null components, take no part, nor do null ids; repeated rows
    count once; ids are cast to long. Vectors of another length than the commonest in the sample take no part. At least k
    candidates are scanned where there are so many, and probes lists or as many as measured_probes says; exact: all lists,
    without tests, for results that are those of brute force. Ties go to the smaller id. An empty table gives no rows.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    base, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    about = int(np.clip(base.count() // PER_LIST, 1, MOST_LISTS))
    sample = base.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, SAMPLE_PER_LIST * about)).select("v").toArrow().column("v").combine_chunks()
    sizes = np.bincount(sample.value_lengths().to_numpy()) if len(sample) else np.ones(1)
    d = int(sizes.argmax()) or 1
    sample = sample.filter(pa.compute.equal(sample.value_lengths(), d)) if len(sample) else sample
    base, asked = base.where(F.size("v") == d), asked.where(F.size("v") == d)
    by_vector = Window.partitionBy("v").orderBy("id")
    base = base.distinct().withColumn("copy", F.row_number().over(by_vector)).where(F.col("copy") <= k + 1).select("id", "v")
    base = common.written(base)
    lists = int(np.clip(base.count() // PER_LIST, 1, MOST_LISTS))
    centre = centroids(_matrix(sample, d), lists) if len(sample) else np.zeros((1, d))
    shared = common.broadcast(spark, (centre, rotation(d)))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _closest(_matrix(batch.column(1), d), shared.value[0], 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], ["id", "v", "list"])

    listed = common.written(base.mapInArrow(assigned, "id long, v array<double>, list int"))
    held = np.zeros(len(centre), np.int64)
    for r in listed.groupBy("list").count().collect():
        held[r["list"]] = r["count"]

    probes = len(centre) if exact else max(probes, measured_probes(listed, asked, centre, k))
    epsilon = np.inf if exact else EPSILON

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                near = _closest(_matrix(part.column(1), d), shared.value[0], len(held))
                upto = np.maximum(probes, (np.cumsum(held[near], axis=1) < k + 1).sum(axis=1) + 1)
                row, place = np.nonzero(np.arange(len(held)) < upto[:, None])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(near[row, place].astype(np.int32))], ["id", "v", "list"])

    distinct = asked.groupBy("v").agg(F.min("id").alias("id"))
    wanted = common.written(distinct.select("id", "v").mapInArrow(probed, "id long, v array<double>, list int"))
    parts = listed.groupBy("list").agg(F.ceil(F.count("*") / LIST_BLOCK).alias("blocks"))
    parts = parts.join(wanted.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("askers")), "list")
    parts = F.broadcast(parts)  # one row a list, MOST_LISTS at most
    left = listed.join(parts, "list").select("list", F.pmod(F.xxhash64("id"), "blocks").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("askers") - 1)).alias("a"), "id", "v")
    right = wanted.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"), F.pmod(F.xxhash64("id"), "askers").alias("a"), "id", "v")

    def scanned(rows: pa.Table, queries: pa.Table) -> pa.Table:
        rows, queries = rows.combine_chunks(), queries.combine_chunks()
        out: list[tuple] = []
        if len(rows) and len(queries):
            ids, at = rows.column("id").to_numpy(), queries.column("id").to_numpy()
            found = scan(ids, _matrix(rows.column("v").combine_chunks(), d), _matrix(queries.column("v").combine_chunks(), d), k + 1, shared.value[1], epsilon)
            out = [(np.full(len(i), q), i, far) for q, (i, far) in zip(at, found, strict=True)]
        q, i, far = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"q": q, "id": i, "far": far})

    keys = ["list", "b", "a"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scanned, "q long, id long, far double")
    best = Window.partitionBy("q").orderBy("far", "id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("q", F.col("id").alias("found"), "far")
    owners = asked.distinct().join(distinct.withColumnRenamed("id", "q"), "v").select(F.col("id").alias("query_id"), "q")
    each = Window.partitionBy("query_id").orderBy("far", "found")
    ranked = owners.join(found, "q").where("query_id != found").withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("found").alias(id_col), F.col("far").alias("score"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found of every vector whose id is divisible by 100."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
