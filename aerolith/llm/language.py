"""Operator 5, language identification: word-first backoff.

Training counts every word of every labelled document outside fold 0, and from the words' counts the character n-grams
of words between begin and end marks. A word that training has is scored by each language's smoothed log frequency of it.
Any other word is covered by n-grams: at each place the longest n-gram that training has is taken, from the longest order
down to a single character, and what no order knows is passed over.

Both tables hold all that training has, whatever their size. The commonest words are sent out, in bounded number, and
settle most of a text; all other words are looked up by a join. N-grams are sent out if they are few enough; else those of
words that are not known are looked up by a join, each distinct word once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import common

#: Words that are looked up without a join, and n-grams up to which no join looks them up.
TOP_WORDS, TOP_GRAMS = 1 << 18, 250_000
LONGEST = 4
#: An n-gram of n characters counts so much of a whole word at each place it covers.
GRAM_WEIGHT = 0.25
ALPHA = 0.5
UNDETERMINED = "und"


def words_of(text: str) -> list[str]:
    """Maximal runs of letters, lower-cased."""
    import regex

    text = text.lower()
    if text.isascii():
        return _ascii_words(text)
    found = []
    for run in _LOOSE.findall(text):
        if run.isalpha():
            found.append(run)
        else:
            found += regex.findall(r"\p{L}+", run)
    return found


def _ascii_words(text: str) -> list[str]:
    return text.translate(_ASCII).split()


_LOOSE = re.compile(r"[^\W\d_]+")
_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


@dataclass
class Model:
    """languages in order; words, and grams: key, total and an array of log frequencies, one a language; both are written tables.

    top_words and top_grams, keys and a row of log frequencies for each, are what is looked up without a join; top_grams is
    None if there are too many.
    """

    languages: list[str]
    prior: list[float]
    words: DataFrame | None = None
    grams: DataFrame | None = None
    top_words: tuple[pa.Array, np.ndarray] | None = None
    top_grams: tuple[pa.Array, np.ndarray] | None = None
    often: int = 0


def backed_off(word: str, grams: dict[str, np.ndarray], languages: int) -> np.ndarray:
    """The sum over the longest known n-grams that cover the marked word without overlap."""
    marked, at, total = f"<{word}>", 0, np.zeros(languages)
    while at < len(marked):
        for n in range(min(LONGEST, len(marked) - at), 0, -1):
            known = grams.get(marked[at : at + n])
            if known is not None:
                total += GRAM_WEIGHT * n * known
                break
        else:
            n = 1
        at += n
    return total


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, n) over all rows; each task counts before the shuffle. Rows of null language are not read."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0
        for batch in batches:
            for lo, hi in common.blocks(batch.column(1)):
                for lang, text in zip(batch.column(0)[lo:hi].to_pylist(), batch.column(1)[lo:hi].to_pylist(), strict=True):
                    held.setdefault(lang, Counter()).update(words_of(text.decode("utf-8", "replace")))
                size = sum(map(len, held.values()))
                if size > 300_000:
                    yield from _flat(held)
                    held = {}
        yield from _flat(held)

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), common.as_bytes(text_col).alias("data"))
    return rows.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _flat(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def grams_of(words: DataFrame) -> DataFrame:
    """words with a row for each place and length of their character n-grams, of 1 to LONGEST characters of the word between marks."""
    marked = words.withColumn("marked", F.concat(F.lit("<"), "word", F.lit(">")))
    placed = marked.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("marked"))))
    each = placed.select(*words.columns, F.inline(F.array(*(F.struct(F.lit(n).alias("size"), F.substring(F.col("marked"), F.col("i"), F.lit(n)).alias("gram")) for n in range(1, LONGEST + 1)))))
    return each.where(F.length("gram") == F.col("size")).drop("size")


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n): the n-grams of (lang, word, n), by the words' counts."""
    return grams_of(words).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top_words: int = TOP_WORDS, top_grams: int = TOP_GRAMS) -> Model:
    """Counts over all rows of docs. The bounds say what is sent out instead of joined; they change no result."""
    counts = common.written(word_counts(docs, lang_col, text_col))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], [])
    words = _table(counts.select("lang", F.col("word").alias("key"), "n"), languages)
    grams = _table(gram_counts(counts).select("lang", F.col("gram").alias("key"), "n"), languages)
    often = _often(words, top_words)
    everything = sum(totals.values())
    return Model(
        languages, [float(np.log(totals[x] / everything)) for x in languages], words, grams, _held(words.where(F.col("total") >= often)),
        _held(grams) if grams.count() <= top_grams else None, often,
    )


def _often(words: DataFrame, most: int) -> int:
    """The least total, of a scale of steps, that at most `most` words reach."""
    held = {r.s: r.n for r in words.groupBy(F.floor(F.log2("total") * 4).cast("int").alias("s")).agg(F.count("*").alias("n")).collect()}
    total = 0
    for s in sorted(held, reverse=True):
        total += held[s]
        if total > most:
            return int(np.floor(2 ** ((s + 1) / 4))) + 1
    return 1


def _table(counts: DataFrame, languages: list[str]) -> DataFrame:
    """(key, total, logs) of all keys: how often in all, and the smoothed log frequency in each language."""
    by_key = common.written(counts.groupBy("key").agg(F.sum("n").alias("total"), *(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages))))
    sums = by_key.agg(F.count("*").alias("keys"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages)))).first()
    logs = [F.log((F.col(f"n{i}") + ALPHA) / float(sums[f"n{i}"] + ALPHA * sums["keys"])) for i in range(len(languages))]
    return by_key.select("key", "total", F.array(*logs).alias("logs"))


def _held(table: DataFrame) -> tuple[pa.Array, np.ndarray]:
    rows = table.select("key", "logs").toArrow().combine_chunks()
    if not len(rows):
        return pa.array([], pa.string()), np.zeros((0, 0))
    keys, logs = (rows.column(k).combine_chunks() for k in range(2))
    return keys, logs.flatten().to_numpy().reshape(len(rows), -1)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row: the likeliest learned language and its posterior probability.

    A null text, and one without a letter, is `und` with score 0; of equally likely languages the first in alphabetical
    order is given. Texts are read whole; bytes that are not UTF-8 are no letters. Null ids and repeated rows are kept;
    other columns are not read, whatever their names. An empty table gives no rows. Without training rows every text is
    `und`.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spark, languages = docs.sparkSession, len(model.languages)
    if not languages:
        return docs.select(F.col(id_col), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    top = common.broadcast(spark, model.top_words)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of = {w: i for i, w in enumerate(top.value[0].to_pylist())}
        logs = top.value[1].reshape(-1, languages)
        for batch in batches:
            for lo, hi in common.blocks(batch.column(1)):
                sums, letters, rare, times = [], [], [], []
                for text in batch.column(1)[lo:hi].to_pylist():
                    counts = Counter(words_of(text.decode("utf-8", "replace")))
                    rows = [row_of.get(w, -1) for w in counts]
                    at, n = np.array(rows, np.int64), np.fromiter(counts.values(), np.int64, len(counts))
                    sums.append(n[at >= 0] @ logs[at[at >= 0]])
                    letters.append(bool(counts))
                    rare.append([w for w, i in zip(counts, rows, strict=True) if i < 0])
                    times.append(n[at < 0])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(letters), pa.array(sums, pa.list_(pa.float64())), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], ["id", "letters", "sums", "rare", "times"])

    found = docs.select(F.col(id_col).alias("id"), common.as_bytes(text_col).alias("data")).mapInArrow(known, f"id {kind}, letters boolean, sums array<double>, rare array<string>, times array<long>")
    found = common.written(found.withColumn("row", F.monotonically_increasing_id()))
    each = found.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("k")))).toDF("row", "word", "k")
    others = model.words.where(F.col("total") < model.often).select(F.col("key").alias("word"), "logs")
    part = [F.sum(F.col("k") * F.col("logs")[i]).alias(f"s{i}") for i in range(languages)]
    unseen = F.collect_list(F.when(F.col("logs").isNull(), F.struct("word", "k"))).alias("unseen")
    rest = each.join(others, "word", "left").groupBy("row").agg(*part, unseen)
    if model.top_grams is None:
        rest = _joined(common.written(rest), model)
    else:
        rest = _backed_off(rest, model)
    both = found.drop("rare", "times").join(rest, "row", "left")
    total = F.array(*(F.col("sums")[i] + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.coalesce(F.col("more")[i], F.lit(0.0)) + F.lit(model.prior[i]) for i in range(languages)))
    scored = both.select("id", "letters", total.alias("t")).withColumn("best", F.array_max("t"))
    likelihood = 1 / F.aggregate("t", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best")))
    name = F.element_at(F.array(*(F.lit(x) for x in model.languages)), F.array_position("t", F.col("best")).cast("int"))
    return scored.select(F.col("id").alias(id_col), F.when(F.col("letters"), name).otherwise(UNDETERMINED).alias("lang_pred"), F.when(F.col("letters"), likelihood).otherwise(0.0).alias("score"))


def _backed_off(rest: DataFrame, model: Model) -> DataFrame:
    """rest with more, the sums over its unseen words by n-grams that were sent out, instead of those words."""
    shared, languages = common.broadcast(rest.sparkSession, model.top_grams), len(model.languages)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = shared.value
        grams = dict(zip(keys.to_pylist(), logs, strict=True))
        remembered: dict[str, np.ndarray] = {}
        for batch in batches:
            words, times = batch.column(0).flatten().flatten()
            words, times = words.to_pylist(), times.to_numpy()
            for word in words:
                if word not in remembered:
                    remembered[word] = backed_off(word, grams, languages)
            each = np.array([remembered[w] for w in words]).reshape(-1, languages) * times[:, None]
            ends = np.concatenate([[0], np.cumsum(batch.column(0).value_lengths().to_numpy())])
            sums = np.concatenate([np.zeros((1, languages)), np.cumsum(each, axis=0)])[ends]
            more = np.diff(sums, axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], _rows(more)], [*batch.schema.names[1:], "more"])
            if len(remembered) > 100_000:
                remembered.clear()

    kept = ["row", *(f"s{i}" for i in range(languages))]
    schema = ", ".join(["row long", *(f"{c} double" for c in kept[1:]), "more array<double>"])
    return rest.select("unseen", *kept).mapInArrow(made, schema)


def _rows(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _joined(rest: DataFrame, model: Model) -> DataFrame:
    """As _backed_off, with n-grams that are looked up by a join, for each distinct word once; a word's n-grams come together, no more."""
    languages = len(model.languages)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [{x["gram"]: np.array(x["logs"]) for x in held} for held in batch.column(1).to_pylist()]
            logs = [backed_off(w, g, languages) for w, g in zip(batch.column(0).to_pylist(), grams, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _rows(np.array(logs).reshape(-1, languages))], ["word", "logs"])

    each = rest.select("row", F.inline("unseen"))
    known = grams_of(each.select("word").distinct()).distinct().join(model.grams.select(F.col("key").alias("gram"), "logs"), "gram", "left")
    held = known.groupBy("word").agg(F.collect_list(F.when(F.col("logs").isNotNull(), F.struct("gram", "logs"))).alias("g"))
    by_word = held.mapInArrow(made, "word string, logs array<double>")
    more = each.join(by_word, "word").groupBy("row").agg(F.array(*(F.sum(F.col("k") * F.col("logs")[i]) for i in range(languages))).alias("more"))
    return rest.drop("unseen").join(more, "row", "left")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest language of every document, learned from those outside fold 0."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(~common.is_fold("doc_id", 0)))
    return predict(docs, model).select("doc_id", common.is_fold("doc_id", 0).alias("held_out"), "lang_pred", "score")
