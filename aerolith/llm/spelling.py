"""Operator 12, spelling variant grouping without pairs.

Two words are near if one inserted, deleted or replaced code point parts them. Words that differ by a replacement are
those with a common (position, prefix, suffix): the word with a wildcard at the position. Such a group keeps its size and
its two best words, so each member learns how many others there are and which is the best of them. A word that lacks one
code point of another is found where the deletions of the one meet the other itself: the shorter learns the number and the
best of those that can lose a code point to become it, each of those learns the shorter. What a word learns is added up by
word; no pair is made.

Words are ranked once, best (most occurrences, then least in code-point order) first. Keys carry ranks alone, and the best
of several is the least rank.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.llm import common

#: Least code points and occurrences of a word; how many times as frequent as a word its form must be; one run in SLIP loses a letter.
LENGTH, OCCURRENCES, RATIO, SLIP = 6, 5, 5, 199
#: Fixed: letters of a run, A-Z lower-cased already.
LETTERS = "a-zÀ-ÿ"
#: Words, or bytes of them, that a task counts before it hands them on.
_HELD, _HELD_BYTES = 1 << 17, 1 << 24
#: Code points up to which keys are texts; beyond, a hash modulo a prime, as a word has as many keys as code points.
_SPELLED = 64
_PRIME, _BASE = (1 << 127) - 1, 0x5DEECE66D_9E3779B97F4A7C15_1B873593
#: Rows of a table of forms that is broadcast; larger ones are joined.
BROADCAST_ROWS = 1 << 20


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, slip: int | None = SLIP) -> DataFrame:
    """(word, n): how often each word of so many code points at least occurs.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z is lower-cased. With slip, a run whose crc32 of
    `<id>:<run>` it divides loses the code point at that crc32 modulo the run's length. A null id has no digits before the
    colon. A null text has no words. Texts are read whole; a task hands its counts on before they get many.
    """
    run = re.compile(f"[{LETTERS}]{{{length},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = Counter(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for lo, hi in common.blocks(batch.column(1)):
                for name, text in zip(batch.column(0)[lo:hi].to_pylist(), batch.column(1)[lo:hi].to_pylist(), strict=True):
                    begun = zlib.crc32(name + b":")
                    for word, n in Counter(run.findall(text.lower().decode("utf-8", "replace"))).items():
                        if slip and (h := zlib.crc32(word.encode(), begun)) % slip == 0:
                            if len(word) == length:
                                continue
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        held[word] += n
                        size += len(word)
                if len(held) > _HELD or size > _HELD_BYTES:
                    yield out()
                    held, size = Counter(), 0
        yield out()

    name = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(name.alias("name"), common.as_bytes(text_col).alias("data")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def keys_of(word: str) -> tuple[list[str], list[str]]:
    """The word with a wildcard at each place, and the distinct words that it becomes by losing a code point."""
    n = len(word)
    if n <= _SPELLED:
        return [f"{word[:i]}*{word[i + 1 :]}" for i in range(n)], list({word[:i] + word[i + 1 :] for i in range(n)})
    points = [ord(c) for c in word]
    before, after, power = [0], [0] * (n + 1), [1]
    for c in points:
        before.append((before[-1] * _BASE + c) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    for i in range(n - 1, -1, -1):
        after[i] = (after[i + 1] + points[i] * power[n - 1 - i]) % _PRIME
    wild = [f"{n} {i} {(before[i] * power[n - i] + after[i + 1]) % _PRIME:x}" for i in range(n)]
    if n - 1 <= _SPELLED:
        return wild, list({word[:i] + word[i + 1 :] for i in range(n)})
    return wild, list({f"{n - 1} {(before[i] * power[n - 1 - i] + after[i + 1]) % _PRIME:x}" for i in range(n)})


def own_key(word: str) -> str:
    """What the deletions of a word one longer must be to be this word."""
    if len(word) <= _SPELLED:
        return word
    h = 0
    for c in word:
        h = (h * _BASE + ord(c)) % _PRIME
    return f"{len(word)} {h:x}"


def _keyed(ranked: DataFrame) -> DataFrame:
    """(key, rank, kind): wildcard keys (0), deletions (1) and the word itself (2)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ranks, kinds = [], [], []
            for word, rank in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wild, shorter = keys_of(word)
                keys += [*wild, *shorter, own_key(word)]
                ranks.append(np.full(len(wild) + len(shorter) + 1, rank))
                kinds.append(np.repeat([0, 1, 2], [len(wild), len(shorter), 1]))
                if len(keys) > _HELD:
                    yield _rows(keys, ranks, kinds)
                    keys, ranks, kinds = [], [], []
            if keys:
                yield _rows(keys, ranks, kinds)

    return ranked.select("word", "rank").mapInArrow(made, "key string, rank long, kind int")


def _rows(keys: list[str], ranks: list[np.ndarray], kinds: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.concatenate(ranks)), pa.array(np.concatenate(kinds).astype(np.int32))], ["key", "rank", "kind"])


def near(ranked: DataFrame) -> DataFrame:
    """(rank, n_near, best): for every word that has near words their number and least rank.

    Groups are windows over a key: a wildcard group has as many words as there are letters at most, a word's own key those
    that become it by losing a letter.
    """
    of_key = Window.partitionBy("key")
    wild, shorter, own = (F.col("kind") == k for k in range(3))
    first = _keyed(ranked).select(
        "*", F.count("*").over(of_key).alias("size"), F.min(F.when(~own, F.col("rank"))).over(of_key).alias("first"), F.min(F.when(own, F.col("rank"))).over(of_key).alias("own"),
    ).where("size > 1")
    second = F.min(F.when(wild & (F.col("rank") > F.col("first")), F.col("rank"))).over(of_key)
    groups = first.withColumn("second", second)
    others = F.when(wild, F.col("size") - 1).when(own, F.col("size") - 1).when(F.col("own").isNotNull(), 1)
    best = F.when(wild, F.when(F.col("rank") == F.col("first"), F.col("second")).otherwise(F.col("first"))).when(own, F.col("first")).otherwise(F.col("own"))
    told = groups.select("rank", others.alias("others"), best.alias("best")).where("others > 0")
    return told.groupBy("rank").agg(F.sum("others").alias("n_near"), F.min("best").alias("best"))


def _held(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def group(counts: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every distinct word of so many code points and occurrences.

    counts: (word, n), words distinct and not null. form: the near word of most occurrences, the least in code-point order
    of several, if it has ratio times the word's own at least; else null, as is form_n. root: from word to form to its form
    and so on, the last; the word itself without a form. n_near: near words, 0 if none. An empty table gives no rows.

    Forms lead to ever more frequent words, so they have no circles; roots double their reach in each round.
    """
    known = counts.where((F.char_length("word") >= length) & (F.col("n") >= occurrences)).select("word", "n")
    ranked = common.written(common.ranked(known, F.desc("n"), F.asc("word")).select("word", "n", F.col("rank").cast("long").alias("rank")))
    best = ranked.select("rank", F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = ranked.join(near(ranked), "rank", "left")
    found = found.join(best.withColumnRenamed("rank", "best"), "best", "left")
    has = F.col("form_n") >= ratio * F.col("n")
    found = common.written(found.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(has, F.col(c)).alias(c) for c in ("best", "form", "form_n"))))
    reach = common.written(found.where("best is not null").select("rank", F.col("best").alias("root")), True)
    rows = reach.count()
    while True:
        further = _held(reach.select(F.col("rank").alias("root"), F.col("root").alias("next")), rows)
        moved = common.written(reach.join(further, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), True)
        common.dropped(reach)
        reach = moved.select("rank", "root")
        reach._written_at = moved._written_at
        if moved.where("moved").isEmpty():
            break
    rooted = reach.join(best.select(F.col("rank").alias("root"), F.col("form").alias("root_word")), "root").select("rank", "root_word")
    return found.join(rooted, "rank", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its form, root and number of near words."""
    return group(words(common.table(spark, sf_dir, "documents")))


ORACLE = r"""
WITH RECURSIVE tbl AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i)
  )
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{6,}')) AS run FROM documents
), d AS (
  SELECT run, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run
), h AS (
  SELECT run, c, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM d, tbl
), v AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h
  ) GROUP BY word HAVING length(word) >= 6 AND sum(c) >= 5
), wild AS (
  SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS k FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)
), shorter AS (
  SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS k FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM wild a JOIN wild b ON a.k = b.k AND a.word <> b.word
  UNION ALL SELECT a.word, v.word, v.n FROM shorter a JOIN v ON a.k = v.word
  UNION ALL SELECT v.word, a.word, a.n FROM shorter a JOIN v ON a.k = v.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS n FROM pairs GROUP BY word
), f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN best.n >= 5 * v.n THEN best.other END AS form, CASE WHEN best.n >= 5 * v.n THEN best.n END AS form_n
  FROM v LEFT JOIN best USING (word)
), r AS (
  SELECT word, word AS at FROM f
  UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.at = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN r USING (word) JOIN f e ON e.word = r.at WHERE e.form IS NULL
"""
