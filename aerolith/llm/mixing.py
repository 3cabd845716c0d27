"""Operator 11, mixing sources to target weights.

Sources share a budget of words by weight, none above a multiple of what it has; the excess is shared again. Which words a
source gives is decided by hash-random keys: documents are put in the order of a hash of their id within each source,
running sums of words are made range by range, and the order is cut where the source's budget ends, within a document if
need be. A budget above the source's size takes whole epochs first.

Keys are uniform, so their ranges are cut at even steps: as many ranges as the square root of the number of documents. A
source of any size is spread over all ranges, one range's part of a source is one sort, and the ranges' totals are added up
per source: both grow with the square root. Every run gives the same mix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.llm import common

#: Weights of the sources in code-point order, repeating; the mix's words by those there are; most epochs of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Fixed: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
_WORD_ENDS = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(label, source_size, target) from (label, source_size); labels are distinct and ranked to get their weights.

    Targets sum to share times all sizes, or to most times all sizes if that is less. A round finds the sources that are
    above most times their size and what is left for the others; rounds end when no more are found.
    """
    numbered = common.ranked(sources, F.col("label"))
    given = common.written(numbered.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))))
    size, weight = F.col("source_size"), F.col("weight")
    total, left = given.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rest, full = share * total, 0
    while True:
        above = size * most * F.lit(left) > weight * F.lit(rest)
        held, free, n = given.agg(F.coalesce(F.sum(F.when(~above, size * most)), F.lit(0.0)), F.coalesce(F.sum(F.when(above, weight)), F.lit(0.0)), F.count_if(~above)).first()
        if n == full or not free:
            break
        rest, left, full = share * total - held, free, n
    even = weight * F.lit(rest) / F.lit(left or 1.0)
    return given.select("label", "source_size", F.least(even, size * most).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", texts: bool = False) -> DataFrame:
    """(id, source, size, source_size, target, taken) for every row of docs, and its text too if texts.

    size: the text's words, 0 for a null text. taken: the words that the mix takes of the row, all epochs together. A
    source's taken words are its target, rounded. A null source is one source, after all others. Rows go in the order of a
    hash of their id; null ids by a hash of the text. Repeated rows each have a place of their own, next to each other; of
    rows that are equal in id, source and size any may be the one that is cut. A text without words takes no part and has
    taken 0. An empty table gives no rows. Other columns are not read.
    """
    id_, text = F.col(id_col), F.col(text_col)
    # never null, and in code-point order with the null source last
    label = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    key = F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = docs.select(id_.alias("id"), F.col(source_col).alias("source"), label.alias("label"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"), *([text.alias("text")] if texts else []))
    narrow = common.written(rows.drop("text"), True)
    spans = max(1, math.isqrt(narrow.count()))
    span = F.shiftright(F.shiftright("key", 28) * F.lit(spans), 32).alias("span")  # keys have 60 bits
    totals = common.written(narrow.groupBy("label", span).agg(F.sum("size").alias("total")), True)
    goals = targets(totals.groupBy("label").agg(F.sum("total").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("label").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spread = totals.select("label", "span", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before")).join(goals, "label")
    within = Window.partitionBy("label", "span").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows if texts else narrow).withColumn("span", span).withColumn("upto", F.sum("size").over(within)).join(spread, ["label", "span"])
    whole = _whole(F.floor(F.col("target") + 0.5), F.col("source_size"))
    over = F.floor(F.col("target") + 0.5) - whole * F.col("source_size")
    part = F.least(F.greatest(over - (F.col("before") + F.col("upto") - F.col("size")), F.lit(0)), F.col("size"))
    taken = (whole * F.col("size") + part).cast("long").alias("taken")
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken, *([F.col("text").alias(text_col)] if texts else []))


def _whole(budget: Column, size: Column) -> Column:
    """Whole epochs within the budget."""
    return F.when(size > 0, F.floor(budget / F.when(size > 0, size))).otherwise(0)


def epochs(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself, from mix(texts=True): each row once for every epoch that takes words of it, with epoch (from 1), words and text.

    An epoch's text is the whole text, or its begin up to the end of the last word taken. Rows with taken 0 give none.
    """
    times = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    each = mixed.where("taken > 0").withColumn("epoch", F.explode(times))
    each = each.withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size")))
    begin = F.array_join(F.slice(F.split(text_col, _WORD_ENDS), F.lit(1), F.col("words").cast("int")), "")
    return each.withColumn(text_col, F.when(F.col("words") == F.col("size"), F.col(text_col)).otherwise(begin)).drop("taken")


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, source) AS i,
    coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget
  FROM s
), f AS (
  SELECT i, (budget - held) AS rest, free FROM o WHERE 2.0 * source_size * free >= w * (budget - held) ORDER BY i LIMIT 1
), t AS (
  SELECT o.source, o.source_size, CASE WHEN o.i < f.i THEN 2.0 * o.source_size ELSE CAST(o.w * f.rest AS DOUBLE) / CAST(f.free AS DOUBLE) END AS target
  FROM o, f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, CAST(t.target AS DOUBLE) AS target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS lo
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + least(greatest(budget % source_size - lo, 0), size) END AS BIGINT) AS taken
FROM p
"""
