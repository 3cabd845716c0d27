"""Operator 2, SimHash near-duplicates: Golay-code fuzzy hashing.

Fingerprints are cut into segments of 23, 23 and 18 bits: A, B and C. Two that differ in two bits at most have either
equal C, or one of A and B equal (pigeonhole, as an error in C leaves one for A and B). Segments with errors are
compared through codeword indices near them, of which two words at two errors or fewer share one:

* A itself with each index near B, and B itself with each index near A: all pairs where A or B is equal;
* C itself with an index near A and one near B, for the rest: A and B differ in one bit each. Two words that differ in
  one bit differ in parity, so an even word gives its own index alone and only an odd word gives those of its neighbours.

Equal fingerprints are one node from the start. Nodes with a common key are candidates, verified by the number of
differing bits. A key of the first two kinds with more than FEW nodes is split by the codeword indices near C, which two
nodes with two errors at most have in common too. In each part all nodes are compared with the least, then all pairs that
are in different components by then. Components come from rounds of star contraction on written tables.

Two bits of 64 find copies that are all but equal. For near copies in the usual sense, whose shingle sets are similar to
SIMILARITY t or more, a text's shingles are put in one order that holds for all texts, common ones last. Two sets of
similarity t share t / (1 + t) of their sizes' sum at least, so the first of n - ceil(t * n) + 1 shingles of each have one
in common. Those shingles are the keys. At the first shingle that two sets share, their places say how many they can share
at most, and so do the counts of their values by remainder (sketches); pairs that cannot reach t are no candidates, and
the whole shingle sets decide for all others. Equal sets are one node. So no pair is lost (but for equal 64-bit hashes), whatever the order is; the order, from a sample, only
keeps the keys small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.llm import common, golay

SHINGLE, SEED, BITS, MOST_BITS = 3, 42, 64, 2
#: Nodes of a key up to which candidates are compared pair by pair.
FEW = 12
#: For near copies: words of a shingle, and least Jaccard similarity of the shingle sets.
WORDS, SIMILARITY = 5, 0.8
#: Rows about which common shingles are counted in, and how many shingles, met OFTEN times there, go last in the order.
SAMPLE, LAST, OFTEN = 1 << 14, 1 << 17, 3
#: Least and most remainders that a sketch of a shingle set counts, powers of two.
LANES = 64, 4096
#: Ids up to which a set of them is broadcast.
BROADCAST_ROWS = 1 << 20
_EACH_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """Bits that more than half of the shingles' XXH64 values have; 0 for a text without words."""
    import xxhash

    found = text.lower().split()
    if not found:
        return 0
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    joined, digest = b" ".join(found), xxhash.xxh64_digest
    span = min(words, len(found))
    shingles, counts = len(found) - span + 1, np.zeros(2048, np.int64)
    for lo in range(0, shingles, 1 << 16):
        hi = min(lo + (1 << 16), shingles)
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(begins[lo:hi].tolist(), ends[lo + span - 1 : hi + span - 1].tolist(), strict=True)])
        lanes = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        counts += np.bincount((lanes + np.arange(0, 2048, 256)).ravel(), minlength=2048)
    return int.from_bytes(np.packbits((counts.reshape(8, 256) @ _EACH_BIT)[:, ::-1] * 2 > shingles).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, near: tuple | None = None) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long. A null text is empty.

    With near, a broadcast of common_shingles and a similarity: also shingles, a hash of the shingle set, its size, prefix,
    its keys, and sketch.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.blocks(batch.column(1)):
                texts = batch.column(1)[lo:hi].to_pylist()
                found = np.array([fingerprint(x, words) for x in texts], np.uint64).view(np.int64)
                columns = {"id": batch.column(0)[lo:hi], "fp": pa.array(found)}
                if near is not None:
                    columns["text"] = batch.column(2)[lo:hi]
                    sets = [shingle_set(x) for x in texts]
                    columns |= {"shingles": pa.array(np.array([set_hash(x) for x in sets], np.int64)), "size": pa.array([len(x) for x in sets], pa.int32()), "prefix": pa.array([prefix(x, near[0].value, near[1]) for x in sets], pa.list_(pa.int64())), "sketch": pa.array([sketch(x) for x in sets], pa.binary())}
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    text = [] if near is None else [_text_hash(text_col).alias("text")]
    more = ", shingles long, size int, prefix array<long>, sketch binary" if near is not None else ""
    read = docs.select(F.col(id_col).alias("id"), common.as_bytes(text_col).alias("data"), *text)
    return read.mapInArrow(made, f"id {kind}, fp long{', text long' * len(text)}{more}").withColumnRenamed("id", id_col)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 values of the text's shingles, rising; a shorter text has one, of all its words; none has none."""
    import xxhash

    found = text.lower().split()
    if not found:
        return np.zeros(0, np.int64)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    span = min(words, len(found))
    joined, digest, shingles = b" ".join(found), xxhash.xxh64_digest, len(found) - span + 1
    parts = [np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(begins[lo : min(lo + (1 << 16), shingles)].tolist(), ends[lo + span - 1 : lo + span - 1 + (1 << 16)].tolist(), strict=True)]), ">i8").astype(np.int64) for lo in range(0, shingles, 1 << 16)]
    return np.unique(np.concatenate(parts))


def set_hash(shingles: np.ndarray) -> int:
    """One number for equal sets."""
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(shingles.astype("<i8").tobytes(), SEED), "big", signed=True)


def common_shingles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, rank): the commonest shingles of a sample of rows, rising, and a rank that rises with their counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.blocks(batch.column(0)):
                sets = [shingle_set(x, words) for x in batch.column(0)[lo:hi].to_pylist()]
                shingle, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(n)], ["shingle", "n"])

    share = min(1.0, SAMPLE / max(docs.count(), 1))
    some = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = some.select(common.as_bytes(text_col).alias("data")).mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    last = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(LAST).toArrow()
    shingle, n = last.column("shingle").to_numpy(), last.column("n").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], (2 * np.log2(n[order])).astype(np.int64) + 1


def prefix(shingles: np.ndarray, last: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a set in the order of all texts: those not in last by value, then last by rank.

    Of two sets with the similarity, the prefixes share a shingle: the first, in this order, that the sets share.
    """
    if not len(shingles):
        return shingles
    rank = np.zeros(len(shingles), np.int64)
    if len(last[0]):
        at = np.minimum(np.searchsorted(last[0], shingles), len(last[0]) - 1)
        rank = np.where(last[0][at] == shingles, last[1][at], 0)
    return shingles[np.lexsort((shingles, rank))[: len(shingles) - math.ceil(similarity * len(shingles) - 1e-6) + 1]]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, which fingerprint), all keys of all fingerprints."""
    fps = fps.view(np.uint64)
    a, b, c = ((fps >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((41, 0x7FFFFF), (18, 0x7FFFFF), (0, 0x3FFFF)))
    which = np.arange(len(fps))
    (near_a, n_a), (near_b, n_b) = golay.near(a), golay.near(b)
    six = np.arange(6)
    one_a, one_b = (six < np.where(np.bitwise_count(w) % 2, n, 1)[:, None] for w, n in ((a, n_a), (b, n_b)))
    parts = [
        (1 << 60 | a[:, None] << 12 | near_b, six < n_b[:, None]),
        (2 << 60 | b[:, None] << 12 | near_a, six < n_a[:, None]),
        ((c << 24)[:, None, None] | near_a[:, :, None] << 12 | near_b[:, None, :], one_a[:, :, None] & one_b[:, None, :]),
    ]
    return np.concatenate([k[m] for k, m in parts]), np.concatenate([np.broadcast_to(which.reshape(-1, *[1] * (m.ndim - 1)), m.shape)[m] for _, m in parts])


def _keyed(nodes: DataFrame) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            key, which = keys_of(fps)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[which])], ["key", "fp"])

    return nodes.select("fp").mapInArrow(made, "key long, fp long")


def _close(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= MOST_BITS


def _split(rows: DataFrame) -> DataFrame:
    """(key, fp): keys of the first two kinds once for each codeword index near segment C, which links keep in common too."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fps = (batch.column(k).to_numpy() for k in (0, 1))
            near_c, n = golay.near(fps & 0x3FFFF)
            held = np.where((key >> 60 > 0)[:, None], np.arange(6) < n[:, None], np.arange(6) < 1)
            finer = np.where((key >> 60 > 0)[:, None], key[:, None] | near_c << 35, key[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(finer[held]), pa.array(np.broadcast_to(fps[:, None], held.shape)[held])], ["key", "fp"])

    return rows.select("key", "fp").mapInArrow(made, "key long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints, enough of them that every pair within two bits is connected.

    A key's fingerprints are compared pair by pair up to FEW. A larger key is split by segment C, and of each part all are
    compared with the least, then all pairs that are not connected by then.
    """
    sizes = common.written(_keyed(nodes).groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), True)
    twos = sizes.where((F.col("n") == 2) & _close(F.col("a"), F.col("b"))).select("a", "b")
    more = common.written(_keyed(nodes).join(sizes.where("n > 2").select("key", "n"), "key"), True)
    few = more.where(F.col("n") <= FEW).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("g"))
    pairs = F.flatten(F.transform("g", lambda x, i: F.transform(F.filter(F.slice("g", i + 2, F.lit(FEW)), lambda y: _close(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    fews = few.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    edges = common.written(twos.unionByName(fews).distinct(), True)
    of_key = Window.partitionBy("key")
    many = _split(more.where(F.col("n") > FEW)).select("key", "fp", F.min("fp").over(of_key).alias("least"), F.max("fp").over(of_key).alias("most")).where("least < most")
    many = common.written(many.select("key", "fp", "least"), True)
    stars = many.where((F.col("fp") > F.col("least")) & _close(F.col("fp"), F.col("least"))).select(F.col("least").alias("a"), F.col("fp").alias("b"))
    edges = common.written(edges.unionByName(stars).distinct(), True)
    rooted = many.join(components(edges).toDF("fp", "root"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    parted = rooted.select("*", F.min("root").over(of_key).alias("lo"), F.max("root").over(of_key).alias("hi")).where("lo < hi").select("key", "fp", "root")
    parted = common.written(parted, True)
    close = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & _close(F.col("x.fp"), F.col("y.fp"))
    across = parted.alias("x").join(parted.alias("y"), close).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))
    return edges.unionByName(across).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a < b): root is the least node of its component.

    Large-star and small-star rounds: each links a node's larger neighbours, then its smaller ones, to the least node
    among them and itself. A round never parts or joins components; when none changes an edge, all edges are stars.
    """
    edges = common.written(edges.select("a", "b"), True)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select("m", "b").where("m < b").distinct()
        down = large.groupBy(F.col("b").alias("a")).agg(F.min("m").alias("least"))
        small = large.select(F.col("b").alias("a"), F.col("m").alias("c")).join(down, "a")
        spread = small.select(F.explode(F.array(F.struct(F.col("least").alias("a"), F.col("c").alias("b")), F.struct(F.col("least").alias("a"), F.col("a").alias("b")))).alias("p"))
        before, edges = edges, common.written(spread.select("p.a", "p.b").where("a < b").distinct(), True)
        common.dropped(before)
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def _held(df: DataFrame, count: int) -> DataFrame:
    """df to be broadcast if it has few enough rows; else it is joined as any other."""
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


def _can_be_similar(similarity: float) -> Column:
    """Whether sets x and y can have the similarity if the first shingle that they share is at these places."""
    left, right = (F.col(f"{k}.size") - F.col(f"{k}.at") for k in "xy")
    return F.least(left, right) >= similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-6


def sketch(shingles: np.ndarray) -> bytes:
    """How many of the set's values have each remainder by its lanes, a power of two about a quarter of its size; 255 or more: 255."""
    lanes = min(max(1 << max(len(shingles) // 4, 1).bit_length(), LANES[0]), LANES[1])
    return np.minimum(np.bincount(shingles & (lanes - 1), minlength=lanes), 255).astype(np.uint8).tobytes()


def most_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bounds of how many values two sets share, from rows of their sketches; the longer are folded to the shorter."""
    lanes = min(x.shape[1], y.shape[1])
    full = (x == 255).any(axis=1) | (y == 255).any(axis=1)
    x, y = (v.reshape(len(v), -1, lanes).sum(axis=1, dtype=np.int64) for v in (x, y))
    return np.where(full, np.iinfo(np.int64).max, np.minimum(x, y).sum(axis=1))


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs that can have the similarity by their sketches: all that have it, and few others."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            (x, at_x), (y, at_y) = (common.raw(batch.column(k)) for k in (2, 3))
            kinds = np.diff(at_x) << 32 | np.diff(at_y)
            for kind in np.unique(kinds).tolist():
                rows = np.flatnonzero(kinds == kind)
                left, right = x[at_x[rows][:, None] + np.arange(kind >> 32)], y[at_y[rows][:, None] + np.arange(kind & 0xFFFFFFFF)]
                sizes = left.sum(axis=1, dtype=np.int64) + right.sum(axis=1, dtype=np.int64)
                keep[rows] = most_shared(left, right) >= similarity / (1 + similarity) * sizes - 1e-6
            yield batch.select([0, 1]).filter(pa.array(keep))

    held = nodes.select("fp", "sketch")
    both = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(kept, "a long, b long")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(common.as_bytes(text_col))


def similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str, similarity: float, repeated: bool, words: int = WORDS) -> DataFrame:
    """The pairs whose whole shingle sets have the similarity. repeated: whether rows of docs have an id and a text in common.

    A node's text is that of the row with its id, which may be null, and its text's hash.
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.blocks(batch.column(1)):
                sets = [shingle_set(x, words) for x in batch.column(1)[lo:hi].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(sets, pa.list_(pa.int64()))], ["fp", "s"])

    pairs = common.written(plausible(pairs, nodes, similarity), True)
    wanted = common.written(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(nodes.select("fp", F.col("least").alias("_id"), F.col("text").alias("_text")), "fp"), True)
    held = docs.select(F.col(id_col).alias("id"), _text_hash(text_col).alias("text"), common.as_bytes(text_col).alias("data"))
    texts = held.join(_held(wanted, wanted.count()), F.col("id").eqNullSafe(F.col("_id")) & (F.col("text") == F.col("_text"))).select("fp", "data")
    sets = texts.mapInArrow(shingled, "fp long, s array<long>")
    sets = common.written(sets.dropDuplicates(["fp"]) if repeated else sets)
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    out = common.written(both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), True)
    common.dropped(pairs, wanted, sets)
    return out


def near_links(docs: DataFrame, nodes: DataFrame, edges: DataFrame, id_col: str, text_col: str, repeated: bool, similarity: float = SIMILARITY) -> DataFrame:
    """edges, and (a, b), a < b, of nodes whose texts are similar.

    nodes: fp, here the hash of a shingle set, so that equal sets are one node; the least id that has it, that row's text
    (a hash), and the set's size, prefix and sketch. There are two rounds: each of a key's nodes with its centre, the one
    with the fewest shingles before the key, as copies with the fewest changes have; then all pairs of a key that are not
    connected by then. So a large group of near copies costs about one comparison a text, and
    texts are compared with each other also where the centre is like neither. No key's nodes are gathered: the first round
    is a window that spills, the second an equi-join.
    """
    keyed = nodes.select("fp", "size", F.posexplode("prefix").alias("at", "key"))
    of_key = Window.partitionBy("key")
    foremost = keyed.select("*", F.count("*").over(of_key).alias("n"), F.min("at").over(of_key).alias("least_at")).where("n > 1")
    shared = foremost.withColumn("centre", F.min(F.when(F.col("at") == F.col("least_at"), F.col("fp"))).over(of_key)).drop("least_at")
    shared = common.written(shared)
    stars = shared.where("fp != centre").select(F.least("centre", "fp").alias("a"), F.greatest("centre", "fp").alias("b")).distinct()
    stars = common.written(stars, True)
    edges = common.written(edges.unionByName(similar(docs, nodes, stars, id_col, text_col, similarity, repeated)).distinct(), True)
    rooted = shared.where("n > 2").drop("n", "centre").join(components(edges).toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    parted = rooted.select("*", F.min("root").over(of_key).alias("lo"), F.max("root").over(of_key).alias("hi")).where("lo < hi").drop("lo", "hi")
    parted = common.written(parted, True)
    across = parted.alias("x").join(parted.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & _can_be_similar(similarity))
    others = across.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    others = common.written(others, True)
    common.dropped(shared, parted)
    return common.written(edges.unionByName(similar(docs, nodes, others, id_col, text_col, similarity, repeated)).distinct(), True)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """(id, fp, component_id) for every row of docs; component_id is the least id of the row's component.

    Rows of equal fingerprints, or fingerprints that differ in two bits or fewer, are linked. With a similarity, rows are
    linked if their sets of WORDS-word shingles reach it instead, and only then: links between fingerprints are what is
    compared first, and sets decide.
    Null and empty texts, and texts of white space alone, have fingerprint 0, or no shingles, and are linked like any other. A
    null id is no component's name unless it has no other. Texts are read whole however long. Repeated rows each give a row.
    An empty table gives no rows. Other columns are not read, whatever their names.
    """
    mark = common.live()
    near = None if similarity is None else (common.broadcast(docs.sparkSession, common_shingles(docs, id_col, text_col)), similarity)
    made = fingerprints(docs, id_col, text_col, words, near)
    found = common.written(made)
    common.release(mark)
    node = "fp" if near is None else "shingles"
    # nulls last: a null id stands for a node only if there is no other
    of_text = [] if near is None else ["text", "size", "prefix", "sketch"]
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *of_text))
    nodes = found.groupBy(node).agg(first.alias("x")).select(F.col(node).alias("fp"), F.col("x.id").alias("least"), *(f"x.{c}" for c in of_text))
    nodes = common.written(nodes)
    if near is None:
        edges = links(nodes)
    else:
        repeated = not found.groupBy(id_col, "text").count().where("count > 1").isEmpty()
        candidates = common.written(_fingerprint_pairs(found), True)
        edges = similar(docs, nodes, candidates, id_col, text_col, similarity, repeated)
        edges = near_links(docs, nodes, edges, id_col, text_col, repeated, similarity)
    roots = components(edges)
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = rooted.join(named, "root").select(F.col("fp").alias("_node"), "component_id")
    return found.join(by_node, F.col(node) == F.col("_node")).select(id_col, "fp", "component_id")


def _fingerprint_pairs(found: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes, by the hashes of their sets, that their fingerprints make candidates.

    Of the nodes of one fingerprint each goes with the least, and so do the least ones of two linked fingerprints. It is
    where most copies are found; what it leaves out is found by keys of shingles.
    """
    has = common.written(found.select("fp", F.col("shingles").alias("node")).distinct(), True)
    least = common.written(has.groupBy("fp").agg(F.min("node").alias("least")), True)
    own = has.join(least, "fp").where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    first, second = least.toDF("fa", "a"), least.toDF("fb", "b")
    linked = links(least.select("fp")).toDF("fa", "fb").join(first, "fa").join(second, "fb").where("a != b")
    return own.unionByName(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, similarity: float | None = SIMILARITY) -> DataFrame:
    """The row of least id of each component, with all its columns; of repeated ids one row stays, and one null id's row.

    Texts are not shuffled unless ids repeat or those that go are many: the ids that go are taken from the documents.
    """
    rows = classes(docs, id_col, text_col, words, similarity)
    name = common.unused(docs, "gone")
    per = common.written(rows.groupBy(F.col(id_col).alias(name)).agg(F.count("*").alias("n"), F.bool_or(F.col(id_col).eqNullSafe(F.col("component_id"))).alias("stays")), True)
    gone, repeated = per.agg(F.count_if(~F.col("stays")), F.coalesce(F.max("n"), F.lit(0)) > 1).first()
    left = docs.join(_held(per.where(~F.col("stays")).select(name), gone), docs[id_col].eqNullSafe(F.col(name)), "left_anti")
    return left.dropDuplicates([id_col]) if repeated else left


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, by two bits of difference."""
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
