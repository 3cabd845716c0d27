"""Operator 8, language-model scoring: context-tree weighting over bytes.

A text is the bytes of its words (A-Z folded), joined by a space and ended by a newline. Each byte is eight binary
decisions; each decision, given the bits before it in the byte, has a tree of contexts of 0 to ORDER bytes before it. A
node estimates its next bit by Krichevsky-Trofimov from its counts; its weight is the posterior probability that the tree
ends there, which follows from the counts of the node and all below it. A bit's probability mixes the estimates along its
context path by these weights; where training did not reach a longer context, the path ends. log2 of it is code length.

A byte's probability depends on its (ORDER + 1)-gram alone, so it is worked out once for each distinct gram of the corpus,
from the whole trees; no node is left out. Grams are dealt out by the NEAR nearest context bytes and come in order, so a
task folds the longer contexts in runs of bounded size; contexts shorter than NEAR have bounded numbers of nodes and are
folded from the tasks' sums. The grams' probabilities are a written table that grows with the corpus. The commonest gram of
each of 2**SLOTS slots is sent out, so that most bytes need no join; all others are looked up in that table by a join.

Beside it, a unigram model over words gives the base score: counts of all words stay in a written table. Words that occur
often enough are sent out, in bounded number; all others are looked up by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import common

#: Context bytes; with the byte itself they fill a long. The grams are dealt out by so many of them.
ORDER, NEAR = 5, 3
#: log2 of the slots for grams, and of the most words, that are looked up without a join.
SLOTS, TOP_WORDS = 22, 18
#: Keys that a worker counts before it hands them on, and grams that it folds at once.
AT_ONCE, RUN = 1 << 22, 1 << 17
#: Parts in which the driver gathers the slots, and nodes of short contexts that are sent out at once.
PARTS, NODES = 8, 1 << 20
END = b"\n"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(255)


def stream(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + END


def grams(streams: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-gram that ends at each byte of each stream, and where each stream's begin.

    A gram is the context, its nearest byte highest, and then the byte itself. A stream follows order newlines.
    """
    gap = END * (order - 1)
    data = np.frombuffer(END * order + gap.join(streams) + bytes(8), np.uint8)
    sizes = np.array([len(x) for x in streams], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = int(sizes.sum() + (len(streams) - 1) * (order - 1))
    window = np.ndarray((n,), "<u8", data, strides=(1,))
    low = np.uint64((1 << 8 * order) - 1)
    keys = (window & low) << np.uint64(8) | window >> np.uint64(8 * order) & np.uint64(255)
    if len(streams) > 1:
        held = np.ones(n, bool)
        gaps = (starts + np.arange(len(streams)) * (order - 1))[1:, None] - 1 - np.arange(order - 1)
        held[gaps.ravel()] = False
        keys = keys[held]
    return keys, starts


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of gamma for x of 1/2 at least, by Stirling's series after eight steps up."""
    y = x + 8
    steps = np.prod([x + i for i in range(8)], axis=0) if len(x) else x
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(steps)


def _block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """Nodes of one depth: context and bit prefix, zeros, ones, ln of the weighted probability, and the weight of ending there."""

    node: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> Level:
        own = _block(zeros, ones)
        log = own if below is None else np.logaddexp(own, below) - np.log(2)
        weight = np.ones(len(node)) if below is None else np.exp(own - np.log(2) - log)
        return cls(node, zeros, ones, log, weight)

    def sums(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Nodes of the contexts shorter by their farthest byte, sums of zeros, ones and logs, and which of them each node has."""
        node, at = np.unique((self.node >> np.uint64(16)) << np.uint64(8) | self.node & _LOW, return_inverse=True)
        return node, tuple(np.bincount(at, x, len(node)) for x in (self.zeros, self.ones, self.log)), at

    def mixed(self, at: np.ndarray, longer: np.ndarray) -> np.ndarray:
        """Probabilities of a one where paths pass these nodes (-1: none); longer: those of longer contexts, NaN where there are none."""
        if not len(self.node):
            return longer
        met = (self.zeros + self.ones)[at]
        own, weight = (self.ones[at] + 0.5) / (met + 1), self.weight[at]
        return np.where((at < 0) | (met == 0), longer, np.where(np.isnan(longer), own, weight * own + (1 - weight) * longer))


def paths(keys: np.ndarray, order: int, depth: int) -> np.ndarray:
    """The node of each gram (rows) at a depth for each bit of its byte (columns)."""
    context, byte = (keys >> np.uint64(8 * (order - depth))) & ~_LOW, keys & _LOW
    return np.stack([context | np.uint64(1 << k) | byte >> np.uint64(8 - k) for k in range(8)], axis=1)


def folded(keys: np.ndarray, counts: np.ndarray, order: int, near: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Mixtures of contexts of `near` bytes or more for each gram and bit, and (node, zeros, ones, log) of the next shorter ones.

    keys are distinct and hold all grams of their nearest `near` bytes; counts may be zero.
    """
    node, at = np.unique(paths(keys, order, order).ravel(), return_inverse=True)
    bit = ((keys[:, None] & _LOW) >> np.arange(7, -1, -1, dtype=np.uint64) & np.uint64(1)).ravel() == 1
    times = np.repeat(counts, 8)
    level = Level.of(node, np.bincount(at, np.where(bit, 0, times), len(node)), np.bincount(at, np.where(bit, times, 0), len(node)), None)
    mixture = level.mixed(at, np.full(len(at), np.nan))
    for depth in range(order - 1, near - 2, -1):
        node, totals, parent = level.sums()
        if depth < near:
            return mixture.reshape(-1, 8), (node, *totals)
        level, at = Level.of(node, *totals), parent[at]
        mixture = level.mixed(at, mixture)


def log10_of(keys: np.ndarray, mixture: np.ndarray, shorter: list[Level], order: int) -> np.ndarray:
    """log10 probability of each gram's byte; shorter: levels of the contexts that the mixture lacks, longest first."""
    for depth, level in zip(range(len(shorter) - 1, -1, -1), shorter, strict=True):
        if len(level.node):
            node = paths(keys, order, depth)
            at = np.minimum(np.searchsorted(level.node, node), len(level.node) - 1)
            mixture = level.mixed(np.where(level.node[at] == node, at, -1), mixture)
    p = np.where(np.isnan(mixture), 0.5, mixture)
    bit = (keys[:, None] & _LOW) >> np.arange(7, -1, -1, dtype=np.uint64) & np.uint64(1)
    return np.log10(np.where(bit == 1, p, 1 - p)).sum(axis=1)


def _own(keys: np.ndarray, mixture: np.ndarray) -> np.ndarray:
    """Probabilities of a 1 to those of each gram's own bits, or back; a seldom bit's keeps its digits in a short float."""
    bit = (keys[:, None] & _LOW) >> np.arange(7, -1, -1, dtype=np.uint64) & np.uint64(1)
    return np.where(bit == 1, mixture, 1 - mixture)


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    return (keys * _MIX >> np.uint64(64 - slots)).astype(np.int64)


def _gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(key, n, m) of the rows (data, trains, asked): how often in those that train, how often in those that are asked."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, bool], list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for lo, hi in common.blocks(batch.column(0)):
                texts = batch.column(0)[lo:hi].to_pylist()
                kinds = list(zip(batch.column(1)[lo:hi].to_pylist(), batch.column(2)[lo:hi].to_pylist(), strict=True))
                for kind in set(kinds):
                    keys = grams([stream(x) for x, k in zip(texts, kinds, strict=True) if k == kind], order)[0]
                    held.setdefault(kind, []).append(keys)
                    size += len(keys)
                if size >= AT_ONCE:
                    yield from _summed(held)
                    held, size = {}, 0
        yield from _summed(held)

    return rows.mapInArrow(counted, "key long, n long, m long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _summed(held: dict[tuple[bool, bool], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for (trains, asked), parts in held.items():
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        zero = np.zeros(len(counts), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts if trains else zero), pa.array(counts if asked else zero)], ["key", "n", "m"])


def gram_scores(rows: DataFrame, order: int = ORDER, slots: int = SLOTS) -> DataFrame:
    """(key, m, slot, log) of every distinct gram of rows (data, trains, asked): log10 probability by the trees of the rows that train.

    The table is written; it has as many rows as the corpus has distinct grams. A task holds RUN grams or those of one
    context of NEAR bytes, whichever is more; of the latter there are 256**(ORDER + 1 - NEAR) at most.
    """
    near = min(NEAR, order)
    group = lambda keys: keys >> np.uint64(8 * (order + 1 - near))
    dealt = _gram_counts(rows, order).repartition(F.shiftrightunsigned("key", 8 * (order + 1 - near))).sortWithinPartitions("key")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([x.to_numpy() for x in batch.columns])
            size += batch.num_rows
            if size >= RUN:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                groups = group(columns[0].view(np.uint64))
                end = int(np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))[-1])
                if end:
                    yield from run([x[:end] for x in columns])
                held = [[x[end:] for x in columns]]
                size = len(held[0][0])
        if size:
            yield from run([np.concatenate(x) for x in zip(*held, strict=True)])

    def run(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n, m = columns[0].view(np.uint64), *columns[1:]
        mixture, (node, zeros, ones, log) = folded(keys, n, order, near)
        held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(keys), [None, pa.py_buffer(_own(keys, mixture).astype("<f4").tobytes())]).cast(pa.binary())
        none = lambda k, t: pa.nulls(k, t)
        k = len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(m), held, *[none(k, pa.float64())] * 3], _COLUMNS)
        met = zeros + ones > 0
        k = int(met.sum())
        yield pa.RecordBatch.from_arrays([pa.array(node[met].view(np.int64)), none(k, pa.int64()), none(k, pa.binary()), *(pa.array(x[met]) for x in (zeros, ones, log))], _COLUMNS)

    both = common.written(dealt.mapInArrow(made, "key long, m long, mixture binary, zeros double, ones double, below double"))
    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "below")]
    nodes = common.written(both.where("mixture is null").groupBy("key").agg(*sums))
    shorter = _short_levels(nodes, near)
    mark = common.live()
    parts = max(1, -(-nodes.count() // NODES))
    found = [_mixed(both.where("mixture is not null"), nodes, shorter, order, near, slots, i, parts) for i in range(parts)]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    out = common.written(out)
    common.release(mark)
    common.dropped(both, nodes)
    return out


_COLUMNS = ["key", "m", "mixture", "zeros", "ones", "below"]


def _level(rows: pa.Table) -> Level:
    rows = rows.sort_by("key")
    return Level.of(rows.column("key").to_numpy().view(np.uint64), *(rows.column(c).to_numpy() for c in ("zeros", "ones", "below")))


def _short_levels(nodes: DataFrame, near: int) -> list[Level]:
    """Levels of contexts of near - 2 bytes and fewer; nodes: of near - 1 bytes. Contexts of a byte have 255 * 256 nodes at most."""
    levels = []
    if near > 1:
        table = nodes

        def logged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                level = Level.of(*(batch.column(k).to_numpy() for k in range(4)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(level.log)], ["key", "zeros", "ones", "below"])

        logs = table.mapInArrow(logged, "key long, zeros double, ones double, below double")
        parent = F.shiftrightunsigned("key", 16) * 256 + F.col("key").bitwiseAND(255)
        few = logs.groupBy(parent.alias("key")).agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow()
        levels.append(_level(few))
        for _ in range(near - 2):
            node, totals, _ = levels[-1].sums()
            levels.append(Level.of(node, *totals))
    return levels


def _mixed(grams_: DataFrame, nodes: DataFrame, shorter: list[Level], order: int, near: int, slots: int, part: int, parts: int) -> DataFrame:
    """(key, m, slot, log) of the part of the grams whose near - 1 nearest bytes are in this part of their range."""
    bits = 8 * (near - 1)
    lo, hi = ((1 << bits) * i // parts for i in (part, part + 1))
    context = F.shiftrightunsigned("key", 8)
    here = _level(nodes.where((context >= lo) & (context < hi)).toArrow())
    shared = common.broadcast(grams_.sparkSession, [here, *shorter])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            mixture = _own(keys, common.raw(batch.column(2))[0].copy().view("<f4").reshape(-1, 8).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(slot_of(keys, slots).astype(np.int32)), pa.array(log10_of(keys, mixture, shared.value, order).astype(np.float32))], ["key", "m", "slot", "log"])

    own = F.shiftrightunsigned("key", 8 * (order + 1 - (near - 1)))
    return grams_.where((own >= lo) & (own < hi)).select("key", "m", "mixture").mapInArrow(made, "key long, m long, slot int, log float")


def slotted(scores: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """By slot the gram asked for most often, ties to the least key, and its log; all ones where there is none."""
    best = common.written(scores.groupBy("slot").agg(F.max_by(F.struct("key", "log"), F.struct("m", -F.col("key"))).alias("x")).select("slot", "x.*"))
    known, value = np.full(1 << slots, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << slots, np.float32)
    part = max(1, (1 << slots) // PARTS)
    for lo in range(0, 1 << slots, part):
        rows = best.where((F.col("slot") >= lo) & (F.col("slot") < lo + part)).toArrow()
        at = rows.column("slot").to_numpy()
        known[at], value[at] = rows.column("key").to_numpy().view(np.uint64), rows.column("log").to_numpy()
    common.dropped(best)
    return known, value


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c): words as bytes, and one end for each row; each task counts before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for lo, hi in common.blocks(batch.column(0)):
                for text in batch.column(0)[lo:hi].to_pylist():
                    held.update(text.lower().split())
                    held[END] += 1
                if len(held) > 400_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

    return docs.select(common.as_bytes(text_col).alias("data")).mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _often(counts: DataFrame, most: int) -> int:
    """The least count, of a scale of steps, that at most `most` words reach."""
    step = F.floor(F.log2("c") * 4).cast("int")
    held = {r.s: r.n for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}
    total = 0
    for s in sorted(held, reverse=True):
        total += held[s]
        if total > most:
            return int(np.floor(2 ** ((s + 1) / 4))) + 1
    return 1


def score(docs: DataFrame, training: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, slots: int = SLOTS, top_words: int = TOP_WORDS) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for every row of docs.

    training is a table with the same text column, or a condition on docs that says which rows train. score is log10 of
    the weighted trees' probability of the text, bits_per_byte its code length over the n_bytes of its stream. n_known
    counts tokens that training has; base_score is the unigram log10 probability. A null text is empty: one token, the
    end. Texts are read whole; equal texts have equal scores up to the order of additions. Null ids and repeated rows are
    kept, other columns are not read. An empty table gives no rows. Without training rows every bit has probability 1/2
    and every token's base is log10(1).
    """
    spark = docs.sparkSession
    data = common.as_bytes(text_col).alias("data")
    if isinstance(training, Column):
        rows = docs.select(data, F.coalesce(training, F.lit(False)).alias("trains"), F.lit(True).alias("asked"))
        training = docs.where(training)
    else:
        rows = docs.select(data, F.lit(False).alias("trains"), F.lit(True).alias("asked")).unionByName(training.select(data, F.lit(True).alias("trains"), F.lit(False).alias("asked")))
    scores = gram_scores(rows, order, slots)
    counts = common.written(word_counts(training, text_col))
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = int(sums.n or 0), int(sums.v)
    below = tokens + 0.5 * (kinds + 1)
    often = _often(counts, 1 << top_words)
    top = counts.where(F.col("c") >= often).toArrow()
    logs = np.log10((top.column("c").to_numpy() + 0.5) / below)
    mark = common.live()
    lookup = common.broadcast(spark, (top.column("word").combine_chunks() if len(top) else pa.array([], pa.binary()), logs))
    table = common.broadcast(spark, slotted(scores.where("m > 0"), slots))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values = lookup.value
        known = dict(zip(words.to_pylist(), values.tolist(), strict=True))
        held_key, held_log = table.value
        for batch in batches:
            for lo, hi in common.blocks(batch.column(1)):
                streams = [stream(x) for x in batch.column(1)[lo:hi].to_pylist()]
                keys, starts = grams(streams, order)
                at = slot_of(keys, slots)
                hit = held_key[at] == keys
                total = np.add.reduceat(np.where(hit, held_log[at], 0), starts, dtype=np.float64)
                n, frequent, base, rare, times = [], [], [], [], []
                for text in streams:
                    held = Counter(text.split())
                    held[END] = 1
                    sum_, some, others = 0.0, 0, {}
                    for word, k in held.items():
                        value = known.get(word)
                        if value is None:
                            others[word] = k
                        else:
                            sum_ += k * value
                            some += k
                    n.append(some + sum(others.values()))
                    frequent.append(some)
                    base.append(sum_)
                    rare.append(list(others))
                    times.append(list(others.values()))
                sizes = np.array([len(x) for x in streams])
                grams_, met = _rare(keys[~hit].view(np.int64), np.repeat(np.arange(len(streams)), sizes)[~hit], len(streams))
                columns = [pa.array(n, pa.int64()), pa.array(frequent, pa.int64()), pa.array(base, pa.float64()), pa.array(total), pa.array(sizes), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32())), grams_, met]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *columns], ["id", "n_tokens", "frequent", "frequent_base", "score", "n_bytes", "rare", "times", "keys", "met"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), data).mapInArrow(scored, f"id {kind}, n_tokens long, frequent long, frequent_base double, score double, n_bytes long, rare array<binary>, times array<int>, keys array<long>, met array<int>")
    found = common.written(found.withColumn("row", F.monotonically_increasing_id()))
    common.release(mark)
    each = found.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("k")))).toDF("row", "word", "k")
    met = each.join(counts.where(F.col("c") < often), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known"), F.sum(F.col("k") * F.log10((F.col("c") + 0.5) / below)).alias("base"))
    others = found.select("row", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("met").alias("k")))).toDF("row", "key", "k")
    others = others.join(scores.where("m > 0").select("key", "log"), "key").groupBy("row").agg(F.sum(F.col("k") * F.col("log")).alias("more"))
    both = found.drop("rare", "times", "keys", "met").join(rest, "row", "left").join(others, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return both.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("frequent") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("frequent_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score", "n_bytes", (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _rare(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """For each row its distinct keys and how often each is met."""
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]))) if len(keys) else np.zeros(0, np.int64)
    ends = np.searchsorted(row[first], np.arange(rows + 1)).astype(np.int32)
    counts = np.diff(np.append(first, len(keys))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[first])), pa.ListArray.from_arrays(pa.array(ends), pa.array(counts))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the trees and the words of those outside fold 1."""
    docs = common.table(spark, sf_dir, "documents")
    found = score(docs, ~common.is_fold("doc_id", 1))
    return found.select("doc_id", common.is_fold("doc_id", 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
