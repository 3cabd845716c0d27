"""Operator 6, benchmark decontamination: q-gram lemma filtering with banded verification.

Texts are compared as bytes, A-Z folded and each run of ASCII white space one space. A benchmark item is looked for by its
windows: the whole of an item up to WINDOW bytes, else WINDOW bytes from every STRIDE-th on and at its end. A window of m
bytes occurs in a document if some substring is within k = RATE * m edits of it; one with no edits to spend (under 13
bytes) must also stand between white space or the text's ends. By the q-gram lemma an occurrence shares m - q + 1 - k * q
q-grams with the window at least, and all of them lie on diagonals that are no more than k apart. q is chosen by window,
Q or the largest for which that bound is positive, so no occurrence is lost whatever the length. Shared q-grams are
counted in bands of diagonals, twice as wide as that and overlapping by half; bands below the bound cannot hold an
occurrence, and the rest are verified by alignment within the band. Windows without edits are an index of their own, in
which each place of the first q-gram is compared byte by byte, as any of them may be the one that stands alone. A text that
repeats itself shares its q-grams with a window in very many places: it is taken in pieces that overlap by an occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from aerolith.llm import common

#: Longest q-grams.
Q = 10
#: Edits allowed, as a share of a window's bytes.
RATE = 0.08
WINDOW, STRIDE = 160, 80
#: Bytes of benchmark that are indexed and broadcast at once; a larger benchmark is taken in several passes.
INDEX_BYTES = 4 << 20
#: Places of shared q-grams in windows that are counted at once.
PLACES = 1 << 20
_BITS = 22
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = b"\xff"


def normalised(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def windows(text: bytes) -> list[bytes]:
    """Of a normalised item."""
    if len(text) <= WINDOW:
        return [text] if text else []
    return [text[a : a + WINDOW] for a in [*range(0, len(text) - WINDOW, STRIDE), len(text) - WINDOW]]


def budget_of(size: int) -> int:
    return int(RATE * size)


def gram_size(size: int) -> int:
    """q of a window: m - q + 1 - k * q is 1 at least."""
    return min(Q, size // (budget_of(size) + 1))


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from each place on; q is 10 at most."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.concatenate([data, np.zeros(10, np.uint8)])
    low = np.ndarray((n,), "<u8", data, strides=(1,))
    if q < 8:
        low = low & np.uint64((1 << 8 * q) - 1)
    mixed = low * _A
    if q > 8:
        high = np.ndarray((n,), "<u2", data, offset=8, strides=(1,)) & np.uint16((1 << 8 * (q - 8)) - 1)
        mixed = mixed + high.astype(np.uint64) * _B
    return mixed ^ (mixed >> np.uint64(31))


@dataclass
class Index:
    """Windows of one q with their item, edit budget and least number of shared q-grams, and where each q-gram occurs in them."""

    q: int
    segments: list[bytes]
    items: list
    budget: np.ndarray
    least: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    segment: np.ndarray
    place: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, items: list[tuple]) -> list[Index]:
        """One for each q among the windows of the items, (id, text), those without edits by themselves."""
        by_q: dict[tuple[bool, int], list[tuple]] = {}
        for item, text in items:
            for window in windows(normalised(text)):
                by_q.setdefault((budget_of(len(window)) > 0, gram_size(len(window))), []).append((item, window))
        return [cls._of(q, found) for (_, q), found in sorted(by_q.items())]

    @classmethod
    def _of(cls, q: int, found: list[tuple]) -> Index:
        segments = [x for _, x in found]
        sizes = np.array([len(x) for x in segments], np.int64)
        budget = np.array([budget_of(len(x)) for x in segments], np.int64)
        grams = [_grams(np.frombuffer(x, np.uint8), q) for x in segments]
        flat = np.concatenate(grams)
        owner = np.repeat(np.arange(len(segments), dtype=np.int32), [len(x) for x in grams])
        place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in grams])
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        held = np.zeros(1 << _BITS, bool)
        held[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return cls(q, segments, [x for x, _ in found], budget, sizes - q + 1 - budget * q, keys, np.append(first, len(flat)), owner[order], place[order], held)

    @property
    def band(self) -> int:
        return int(self.budget.max(initial=0)) + 1

    @property
    def exact(self) -> bool:
        return not self.budget.any()


def found_in(indexes: list[Index], texts: list[bytes]) -> Iterator[tuple[int, object, int, int, int]]:
    """(text, item, begin, end, edits) of every window that occurs, by matches()."""
    texts = [normalised(x) for x in texts]
    for index in indexes:
        for text, segment, begin, end, edits in matches(index, texts):
            yield text, index.items[segment], begin, end, edits


def matches(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text, segment, begin, end, edits) of every window that occurs, its best occurrence in each normalised text: fewest edits, then first.

    begin and end are places in the normalised text.
    """
    if not index.segments or not texts:
        return []
    data = np.frombuffer(_NONE.join(texts) + _NONE, np.uint8)
    starts = np.cumsum([0, *(len(x) + 1 for x in texts)])
    grams = _grams(data, index.q)
    at = np.flatnonzero(index.held[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
    slot = np.searchsorted(index.keys, grams[at])
    same = index.keys[np.minimum(slot, len(index.keys) - 1)] == grams[at]
    at, slot = at[same], slot[same]
    text = np.searchsorted(starts, at, side="right") - 1
    enough = np.bincount(text, minlength=len(texts))[text] >= index.least.min()
    at, slot, text = at[enough], slot[enough], text[enough]
    if not len(at):
        return []
    if index.exact:
        return _in_place(index, data, starts, at, slot, text)
    longest = max(map(len, index.segments))
    bins = (int(np.diff(starts).max()) + longest) // index.band + 2
    keys = [_bands(index, at[lo:hi], slot[lo:hi], text[lo:hi], starts, longest, bins) for lo, hi in _pieces(index, at, slot, longest + index.band)]
    key = np.unique(np.concatenate(keys))
    segment = (key // bins % len(index.segments)).tolist()
    return _verified(index, texts, (key // bins // len(index.segments)).tolist(), segment, ((key % bins) * index.band - longest).tolist(), 2 * index.band)


def _pieces(index: Index, at: np.ndarray, slot: np.ndarray, reach: int) -> Iterator[tuple[int, int]]:
    """Ranges of hits with about PLACES places in windows each; two that follow overlap by `reach` bytes, more than an occurrence has."""
    upto = np.cumsum(index.first[slot + 1] - index.first[slot])
    lo, n = 0, len(at)
    while True:
        hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PLACES, side="right"))
        hi = max(hi, int(np.searchsorted(at, at[lo] + 2 * reach, side="right")))
        yield lo, min(hi, n)
        if hi >= n:
            return
        lo = int(np.searchsorted(at, at[hi] - reach, side="left"))


def _bands(index: Index, at: np.ndarray, slot: np.ndarray, text: np.ndarray, starts: np.ndarray, longest: int, bins: int) -> np.ndarray:
    """Bands, as numbers of text, window and bin, that share enough q-grams; a row for each place of a shared one in a window."""
    times = index.first[slot + 1] - index.first[slot]
    which = np.repeat(index.first[slot] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
    text, place, segment = np.repeat(text, times), np.repeat(at, times), index.segment[which].astype(np.int64)
    diagonal = place - starts[text] - index.place[which].astype(np.int64) + longest
    key, count = np.unique((text * len(index.segments) + segment) * bins + diagonal // index.band, return_counts=True)
    follows = np.append(np.diff(key) == 1, False)
    both = count + np.where(follows, np.append(count[1:], 0), 0)
    # a band also begins one bin before the first of a run, but what it adds is in the band that begins there
    return key[both >= index.least[key // bins % len(index.segments)]]


def _in_place(index: Index, data: np.ndarray, starts: np.ndarray, at: np.ndarray, slot: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Windows without edits: the first place in each text where one stands between white space or the text's ends."""
    begins = (at == starts[text]) | (data[at - 1] == 32)
    at, slot, text = at[begins], slot[begins], text[begins]
    found: dict[tuple[int, int], int] = {}
    firsts: dict[int, list[int]] = {}
    for place, k, t in zip(at.tolist(), slot.tolist(), text.tolist(), strict=True):
        if k not in firsts:
            held = slice(int(index.first[k]), int(index.first[k + 1]))
            firsts[k] = index.segment[held][index.place[held] == 0].tolist()
        for segment in firsts[k]:
            if (t, segment) not in found:
                end = place + len(index.segments[segment])
                if end < starts[t + 1] and data[end] in (32, _NONE[0]) and data[place:end].tobytes() == index.segments[segment]:
                    found[t, segment] = place - int(starts[t])
    return [(t, s, begin, begin + len(index.segments[s]), 0) for (t, s), begin in sorted(found.items())]


def _verified(index: Index, texts: list[bytes], text: list[int], segment: list[int], diagonal: list[int], wide: int, at_once: int = 256) -> list[tuple[int, int, int, int, int]]:
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    order = sorted(range(len(text)), key=lambda i: len(index.segments[segment[i]]))
    for lo in range(0, len(order), at_once):
        some = order[lo : lo + at_once]
        ends = _aligned([index.segments[segment[i]] for i in some], [texts[text[i]] for i in some], [diagonal[i] for i in some], [int(index.budget[segment[i]]) for i in some], wide)
        for i, (edits, begin, end) in zip(some, ends, strict=True):
            if edits <= index.budget[segment[i]]:
                pair = text[i], segment[i]
                best[pair] = min(best.get(pair, (edits, begin, end)), (edits, begin, end))
    return [(t, s, begin, end, edits) for (t, s), (edits, begin, end) in sorted(best.items())]


def _aligned(patterns: list[bytes], texts: list[bytes], diagonals: list[int], budgets: list[int], wide: int) -> list[tuple[int, int, int]]:
    """Edits, begin and end of the best alignment of each whole pattern within its band of the text.

    The band has `wide` diagonals from the given one on, and the budget's number on either side. A cell holds edits and
    the begin together, so that one minimum settles both; a begin or end is free.
    """
    slack = max(budgets)
    span = wide + 2 * slack + 1
    longest = max(map(len, patterns))
    n = len(patterns)
    pattern = np.full((n, longest), 0xFE, np.uint8)
    window = np.full((n, longest + span), 0xFF, np.uint8)
    origin = [d - slack for d in diagonals]
    for r, (p, t, o) in enumerate(zip(patterns, texts, origin, strict=True)):
        pattern[r, : len(p)] = np.frombuffer(p, np.uint8)
        part = t[max(o, 0) : max(o + longest + span, 0)]
        window[r, max(-o, 0) : max(-o, 0) + len(part)] = np.frombuffer(part, np.uint8)
    one = 1 << 16
    steps = (np.arange(span) * one).astype(np.int64)
    cells = np.broadcast_to(np.arange(span, dtype=np.int64), (n, span)).copy()
    sizes = np.array([len(p) for p in patterns])
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * n
    for i in range(longest):
        cost = np.where(window[:, i : i + span] == pattern[:, i : i + 1], 0, one)
        step = cells + cost
        step[:, :-1] = np.minimum(step[:, :-1], cells[:, 1:] + one)
        cells = np.minimum.accumulate(step - steps, axis=1) + steps
        for r in np.flatnonzero(sizes == i + 1).tolist():
            s = int(cells[r].argmin())
            edits, begin = divmod(int(cells[r, s]), one)
            out[r] = edits, max(origin[r] + begin, 0), min(max(origin[r] + i + 1 + s, 0), len(texts[r]))
    return out


def _source(text: bytes) -> np.ndarray:
    """For each byte of the normalised text the place it has in the text."""
    data = np.frombuffer(text, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    return np.flatnonzero(~space | ~np.concatenate([[True], space[:-1]])) if len(data) else np.zeros(0, np.int64)


def _indexes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[Index]]:
    """The benchmark in blocks of about INDEX_BYTES; null ids and texts are left out."""
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), common.as_bytes(text_col).alias("data"))
    size = rows.agg(F.sum(F.octet_length("data")).alias("n")).first().n or 0
    parts = max(1, math.ceil(size / INDEX_BYTES))
    for k in range(parts):
        block = rows.where(F.pmod(F.xxhash64("item", "data"), F.lit(parts)) == k).toArrow()
        yield Index.of(sorted(zip(block.column("item").to_pylist(), block.column("data").to_pylist(), strict=True)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, begin, end, edits, segments): a row for each document and each item that it holds.

    begin and end are bytes of the original text, of the item's window with the fewest edits, then the first; edits is
    that window's; segments says how many of the item's windows occur. A null or empty text holds nothing, nor is a null
    or empty item found; texts are read whole, several short ones or one long one at a time. Null ids and repeated rows
    are kept, items of equal text are each found. Ids keep their types. An empty benchmark or an empty table gives no
    rows. Other columns are not read.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    rows = docs.select(F.col(id_col).alias("id"), common.as_bytes(text_col).alias("data"))
    found = []
    for indexes in _indexes(benchmark, item_col, item_text_col):
        shared = common.broadcast(docs.sparkSession, indexes)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for lo, hi in common.blocks(batch.column(1)):
                    texts = batch.column(1)[lo:hi].to_pylist()
                    per: dict[tuple, list[tuple[int, int, int]]] = {}
                    for text, item, begin, end, edits in found_in(shared.value, texts):
                        per.setdefault((text, item), []).append((edits, begin, end))
                    for (text, item), hits in per.items():
                        edits, begin, end = min(hits)
                        source = _source(texts[text])
                        out.append((batch.column(0)[lo + text].as_py(), item, int(source[begin]), int(source[end - 1]) + 1, edits, len(hits)))
                columns = list(zip(*out, strict=True)) if out else [()] * 6
                types = [batch.schema.field(0).type, item_type, *[pa.int64()] * 2, pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "item_id", "begin", "end", "edits", "segments"])

        found.append(rows.mapInArrow(searched, f"id {kind}, item_id {item_kind}, begin long, end long, edits int, segments int"))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item, by the rules of contaminated(); all columns stay.

    One narrow pass for each block of items.
    """
    at = docs.columns.index(text_col)
    for indexes in _indexes(benchmark, item_col, item_text_col):
        shared = common.broadcast(docs.sparkSession, indexes)

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                column = batch.column(at).cast(pa.binary()).fill_null(b"")
                for lo, hi in common.blocks(column):
                    for text, *_ in found_in(shared.value, column[lo:hi].to_pylist()):
                        keep[lo + text] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
