"""Operator 13, filter interaction audit: what each of five filters removes, in every order of them.

Texts are scanned as Arrow buffers, about half a megabyte at a time: NumPy looks up a class for every byte, prefix sums
over the classes count capitals, symbols and code points of each text, and the places where a word begins give the words.
Distinct words are found by sorting word hashes within each document; neighbours of equal hash are compared byte by byte,
and a document with two different words of one hash is counted again from the words themselves.

What fails a row comes to a mask of five bits, and masks are all that is reduced: a part of the table is 32 counts, from
which every figure of every order follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.llm import common

#: Bit of each filter: too few words, few distinct words, capitals, symbols, a copy of a text of a smaller id.
FILTERS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
_SPACE, _CAPITAL, _SYMBOL, _START = 1, 2, 4, 8
#: Bytes of a word up to which its hash is made of its 8-byte pieces; longer words are hashed whole.
_LONG = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] |= _SPACE
    out[65:91] |= _CAPITAL
    out[list(SYMBOLS)] |= _SYMBOL
    out[:0x80] |= _START
    out[0xC0:] |= _START
    return out


_CLASS = _classes()


def scan(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """For each text, data[at[i]:at[i + 1]]: its words, distinct words, capitals A-Z, symbols and code points."""
    kind = _CLASS[data]
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])[at])
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    letter = kind & _SPACE == 0
    begin = np.flatnonzero(letter & (edge[:-1] | np.concatenate([[True], ~letter[:-1]])))
    end = np.flatnonzero(letter & (edge[1:] | np.concatenate([~letter[1:], [True]]))) + 1
    row = np.searchsorted(at, begin, side="right") - 1
    n = len(at) - 1
    return {
        "words": np.bincount(row, minlength=n), "distinct": distinct(data, begin, end, row, n),
        "capitals": sums(kind & _CAPITAL != 0), "symbols": sums(kind & _SYMBOL != 0), "code_points": sums(kind & _START != 0),
    }


def distinct(data: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray, n: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """The distinct words data[begin:end] of each of n rows."""
    length = end - begin
    if hashes is None:
        hashes = _hashes(data, begin, length)
    key = hashes ^ (row.astype(np.uint64) + np.uint64(1)) * _MIX
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    a, b = order[:-1][same], order[1:][same]
    fine = (row[a] == row[b]) & (length[a] == length[b])
    fine[fine] = _equal(data, begin[a[fine]], begin[b[fine]], length[a[fine]])
    first = np.ones(len(order), bool)
    first[1:][same] = False
    out = np.bincount(row[order[first]], minlength=n)
    for k in np.unique(np.concatenate([row[a[~fine]], row[b[~fine]]])).tolist():  # two words of one hash
        out[k] = len({data[x:y].tobytes() for x, y in zip(begin[row == k].tolist(), end[row == k].tolist(), strict=True)})
    return out


def _piece(held: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each place as a number; left says how many belong to the word."""
    bits = (np.minimum(left, 8) * 8).astype(np.uint64)
    return held[at] & np.where(bits == 64, np.uint64(2**64 - 1), (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))


def _windows(data: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    held, out = _windows(data), length.astype(np.uint64) * _MIX
    left = np.flatnonzero(length <= _LONG)
    k = 0
    while len(left):
        out[left] = (out[left] ^ _piece(held, begin[left] + k, length[left] - k)) * _MIX
        out[left] ^= out[left] >> np.uint64(29)
        k += 8
        left = left[length[left] > k]
    for i in np.flatnonzero(length > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : begin[i] + length[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    held, out, k = _windows(data), np.ones(len(a), bool), 0
    left = np.flatnonzero(length <= _LONG)
    while len(left):
        out[left] &= _piece(held, a[left] + k, length[left] - k) == _piece(held, b[left] + k, length[left] - k)
        k += 8
        left = left[length[left] > k]
    for i in np.flatnonzero(length > _LONG).tolist():
        out[i] = data[a[i] : a[i] + length[i]].tobytes() == data[b[i] : b[i] + length[i]].tobytes()
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, part, digest, words, distinct, capitals, symbols, code_points, mask) for every row; mask has filters A to D.

    part: the source, a null one as an empty string. digest: SHA-256 of the text. A null text is empty, which fails A
    alone (and E, if it is not the first). Texts are read whole. Bytes that are not UTF-8 count as code points where one
    would begin.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.blocks(batch.column(2)):
                data, at = common.raw(batch.column(2)[lo:hi])
                found = scan(data, at)
                digests = [hashlib.sha256(memoryview(data[x:y])).digest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                mask = (found["words"] < LEAST_WORDS) * FILTERS["A"] + (100 * found["distinct"] < LEAST_DISTINCT * found["words"]) * FILTERS["B"]
                mask = mask + (100 * found["capitals"] > MOST_CAPITALS * found["code_points"]) * FILTERS["C"] + (found["symbols"] > 0) * FILTERS["D"]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(digests, pa.binary()), *(pa.array(x.astype(np.int64)) for x in found.values()), pa.array(mask.astype(np.int32))], names)

    names = ["id", "part", "digest", "words", "distinct", "capitals", "symbols", "code_points", "mask"]
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), common.as_bytes(text_col).alias("data"))
    return read.mapInArrow(made, f"id {kind}, part string, digest binary, words long, distinct long, capitals long, symbols long, code_points long, mask int")


def masks(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic, n): how many rows of each part fail which filters, E among them, by label.

    rows: from measured(). labels: (id, quality, toxic); of several rows of one id any that says 1 counts. A row fails E
    if a row of a smaller id has the same text, wherever that row is and whatever else it fails. Rows of one id are no
    copies of each other; null ids are neither copies nor have any. Copies are counted up by text, part and label before
    they meet, so a text takes as many rows as it has sources and labels, however many copies there are.
    """
    known = labels.groupBy(F.col(id_col).alias("id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    known = known.where("id is not null")
    narrow = rows.select("id", "part", "digest", "mask")
    none = [F.lit(False).alias("good"), F.lit(False).alias("toxic")]
    marked = narrow.where("id is not null").join(known, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    of_id = marked.groupBy("id", "digest", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    groups = of_id.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"))
    first = F.min("least").over(Window.partitionBy("digest"))
    groups = groups.withColumn("firsts", F.when(F.col("least") == first, F.col("at_least")).otherwise(0))
    counts = groups.groupBy("part", "mask", "good", "toxic").agg(F.sum("firsts").alias("firsts"), (F.sum("n") - F.sum("firsts")).alias("copies"))
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + FILTERS["E"]).alias("mask"), F.col("copies").alias("n"))))
    split = counts.select("part", "good", "toxic", both.alias("x")).select("part", "x.mask", "good", "toxic", "x.n")
    nameless = narrow.where("id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", *none, "n")
    return split.unionByName(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(counts: DataFrame) -> DataFrame:
    """From masks(): for each part, order of the filters and step in it what the step's filter removes.

    kept: rows that pass all filters up to the step. removed: rows that it removes at the step. redundant: rows that fail
    it but were removed before. unique_fails: rows that fail it alone. good_lost, toxic_lost: of removed, those with the
    label. shapley: its removed rows summed over all orders: a row that fails k filters counts 120 / k times.
    """
    every = range(2 ** len(FILTERS))
    sums = lambda where, name: F.array(*(F.coalesce(F.sum(F.when((F.col("mask") == m) & where, F.col("n"))), F.lit(0)).cast("long") for m in every)).alias(name)
    parts = counts.groupBy("part").agg(sums(F.lit(True), "n"), sums(F.col("good"), "good"), sums(F.col("toxic"), "toxic"))
    orders = ["".join(x) for x in permutations(FILTERS)]
    names = F.array(*(F.lit(x) for x in orders))
    letters = F.create_map(*(F.lit(x) for kv in FILTERS.items() for x in kv))
    steps = parts.select("*", F.explode(names).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = F.transform(F.split("filter_order", ""), lambda x: F.element_at(letters, x))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    steps = steps.withColumn("before", total(F.slice(bits, F.lit(1), F.col("step") - 1))).withColumn("bit", F.element_at(bits, F.col("step")))

    def where(column: str, keep) -> Column:
        held = F.transform(F.col(column), lambda x, m: F.when(keep(m), x).otherwise(F.lit(0).cast("long")))
        return F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + x)

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    share = F.array(*(F.lit(len(orders) // max(m.bit_count(), 1)).cast("long") for m in every))  # a row is removed first by each of what it fails equally often
    shares = F.transform("n", lambda x, m: F.when(fails(m), x * F.element_at(share, m + 1)).otherwise(F.lit(0).cast("long")))
    return steps.select(
        "part", "filter_order", "step",
        where("n", lambda m: (m.bitwiseAND(F.col("before") + F.col("bit"))) == 0).alias("kept"),
        where("n", lambda m: fails(m) & ~earlier(m)).alias("removed"),
        where("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        where("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        where("good", lambda m: fails(m) & ~earlier(m)).alias("good_lost"),
        where("toxic", lambda m: fails(m) & ~earlier(m)).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes from every source in every order."""
    rows = measured(common.table(spark, sf_dir, "documents"))
    return audit(masks(rows, common.table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), s AS (
  SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS earlier FROM o, range(1, 6) r(step)
), v AS (
  SELECT c.part, s.filter_order, s.step,
    CAST(sum(CASE WHEN mask & (earlier + bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n * good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
    any_value(bit) AS bit
  FROM c, s GROUP BY c.part, s.filter_order, s.step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM v
"""
