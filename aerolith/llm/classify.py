"""What the two text classifiers share: bounded samples of documents as bags of features, and scoring every document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm import common, features


def labelled_ids(labels: DataFrame, label: str, id_col: str, most: int) -> DataFrame:
    """(id, label) of at most `most` labelled rows outside fold 0, lowest hash of the id first.

    Null ids and labels are left out; an id with several labels takes the largest.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (common.fold(id_col) != 0))
    each = rows.groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    return each.orderBy(F.xxhash64(id_col), id_col).limit(most)


def chosen_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, label, data) of the documents with these ids, a bounded number. Of repeated ids one row is taken, that of the least text."""
    wanted = ids.toDF("id", "label")
    few = docs.select(F.col(id_col).alias("id"), common.as_bytes(text_col).alias("data")).join(F.broadcast(wanted), "id")
    return few.groupBy("id").agg(F.first("label").alias("label"), F.min("data").alias("data"))


def bagged(docs: DataFrame, ids: DataFrame, spec: features.Spec, id_col: str, text_col: str) -> DataFrame:
    """(id, label, size, ids, share, count) of the documents with these (id, label); ids has as many rows as the caller's bound lets it.

    size is in bytes; the arrays are the document's bag of features.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.blocks(batch.column(2)):
                texts = batch.column(2)[lo:hi].to_pylist()
                bags = features.bags(texts, spec)
                parts = [pa.array([b[k] for b in bags], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.float32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array([len(x) for x in texts], pa.int64()), *parts], ["id", "label", "size", "ids", "share", "count"])

    kind = docs.schema[id_col].dataType.simpleString()
    few = chosen_texts(docs, ids, id_col, text_col).select("id", "label", "data")
    return few.mapInArrow(made, f"id {kind}, label int, size long, ids array<int>, share array<float>, count array<int>")


def restricted(bags: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(id, label, size, ids, count) with only the chosen buckets (rising) in the bags."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(k) for k in (3, 4)]
            ids, count = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            keep = np.isin(ids, chosen)
            ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())])]
            parts = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x[keep])) for x in (ids, count)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *parts], ["id", "label", "size", "ids", "count"])

    return bags.select("id", "label", "size", "ids", "count").mapInArrow(made, f"id {bags.schema['id'].dataType.simpleString()}, label int, size long, ids array<int>, count array<int>")


def collected(bags: DataFrame, value: str) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(label, size, ids, value) of a bounded number of bags, in order of their ids."""
    rows = bags.select("id", "label", "size", "ids", value).toArrow().combine_chunks().sort_by("id")
    lists = [rows.column(k).combine_chunks() for k in ("ids", value)]
    ends = lists[0].offsets.to_numpy() if len(rows) else np.zeros(1, np.int32)
    flat = [x.values.to_numpy(zero_copy_only=False) for x in lists]
    return [(y, n, *(x[a:b] for x in flat)) for y, n, a, b in zip(rows.column("label").to_pylist(), rows.column("size").to_pylist(), ends[:-1], ends[1:], strict=True)]


def scored(docs: DataFrame, weights: np.ndarray, logit: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], spec: features.Spec, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, score) for every row. logit takes sums of weights and counts by group, and sizes in bytes.

    A text of any length is read in pieces. Kept columns may have any name but that of the id; the last column is the score.
    """
    shared = common.broadcast(docs.sparkSession, weights.astype(np.float32))
    rest = [id_col, *keep]
    names = [f"c{i}" for i in range(len(rest))]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0)
            found = [np.zeros(0)]
            for lo, hi in common.blocks(text):
                texts = text[lo:hi].to_pylist()
                total, count = features.totals(texts, shared.value, spec)
                found.append(logit(total, count, np.array([len(x) for x in texts])))
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(found), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], [*names, "score"])

    data = docs.select(common.as_bytes(text_col).alias("data"), *(F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)))
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(rest, names, strict=True))
    return data.mapInArrow(made, f"{schema}, score double").toDF(*rest, "score")
