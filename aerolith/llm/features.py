"""Hashed word and character n-gram features over the UTF-8 bytes of texts, many texts at a time.

A feature is a whole word, or an n-gram within one word where a white-space byte (any of them, as a space) may stand at
either end only, which marks the word's begin or end. Buckets are the high bits of a multiplied rolling hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_P32 = np.uint32(0x01000193)
_M32 = np.uint32(0x9E3779B1)
_P64 = 0x9E3779B97F4A7C15 | 1
_M64 = np.uint64(0xD6E8FEB86659FD93)
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_SIZE = 1 << 19


@dataclass(frozen=True)
class Spec:
    """orders: lengths of n-grams, rising, of 3 at least. bits: log2 of the number of buckets. lower: fold A-Z to a-z.

    pairs: also pairs of neighbouring words, hashed by the difference of the two words' hashes, so that all pairs of a
    word with itself share one bucket. A pair does not span a cut of packed().
    """

    orders: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    lower: bool = False
    pairs: bool = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P64 and of its inverse, modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        inverse = pow(_P64, -1, 1 << 64)
        _POWERS = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, p, np.uint64)])) for p in (_P64, inverse))
    return _POWERS


_POWERS: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def packed(texts: list[bytes], lower: bool, budget: int = _SIZE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, segment starts, row of each segment): rows between single spaces, at most about budget bytes at a time.

    A row over budget comes in several segments, cut at white space where there is any; as features do not cross white
    space, sums over the segments are the row's own.
    """
    held: list[bytes] = []
    rows: list[int] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b" " + b"  ".join(held) + b" ", np.uint8)
        return data, np.cumsum([0, *(len(x) + 2 for x in held[:-1])]), np.array(rows)

    for row, text in enumerate(texts):
        text = (text.lower() if lower else text).translate(_SPACES)
        at = 0
        while True:
            end = len(text)
            if end - at > budget:
                end = text.rfind(b" ", at + 1, at + budget)
                end = end if end > at else at + budget
            if held and size + end - at > budget:
                yield out()
                held, rows, size = [], [], 0
            held.append(text[at:end])
            rows.append(row)
            size += end - at + 2
            at = end + (text[end : end + 1] == b" ")
            if at >= len(text):
                break
    if held:
        yield out()


def buckets(data: np.ndarray, starts: np.ndarray, spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(bucket, valid, segment) for words, then pairs of words, then each order of n-grams.

    segment is None for n-grams, which are given by their begin and lie in the segment that holds it.
    """
    space = data == 32
    before = np.cumsum(space, dtype=np.int32)
    edge = np.flatnonzero(space[1:] != space[:-1])
    begin, end = edge[~space[edge + 1]] + 1, edge[space[edge + 1]] + 1
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    words = (sums[end] - sums[begin]) * inverse[begin]
    segment = np.searchsorted(starts, begin, side="right") - 1
    slot = lambda h: ((h ^ (h >> np.uint64(29))) * _M64 >> np.uint64(64 - spec.bits)).astype(np.int32)
    yield slot(words), np.ones(len(begin), bool), segment
    if spec.pairs:
        joined = segment[1:] == segment[:-1]
        yield slot((words[1:] - words[:-1])[joined]), np.ones(int(joined.sum()), bool), segment[1:][joined]
    wide = data.astype(np.uint32)
    rolled, order = wide, 1
    for n in spec.orders:
        while order < n:
            rolled = rolled[:-1] * _P32 + wide[order:]
            order += 1
        if not len(rolled):
            return
        valid = before[n - 2 : len(data) - 1] == before[: len(rolled)]
        mixed = (rolled ^ (rolled >> np.uint32(15))) * (_M32 + np.uint32(2 * n))
        yield (mixed >> np.uint32(32 - spec.bits)).astype(np.int32), valid, None


def _group(k: int, spec: Spec) -> int:
    """Words, pairs and n-grams of any order are groups of their own."""
    return min(k, 1 + spec.pairs)


def groups(spec: Spec) -> int:
    return 2 + spec.pairs


def totals(texts: list[bytes], weights: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """For each text and group: the sum of its features' weights, and how many features it has."""
    total, count = np.zeros((groups(spec), len(texts))), np.zeros((groups(spec), len(texts)))
    for data, starts, rows in packed(texts, spec.lower):
        for k, (bucket, valid, segment) in enumerate(buckets(data, starts, spec)):
            g, value = _group(k, spec), weights[bucket]
            if segment is None:
                value = np.where(valid, value, 0)
                at = np.minimum(starts, len(value) - 1)
                held = starts < len(value)
                np.add.at(total[g], rows[held], np.add.reduceat(value, at, dtype=np.float64)[held])
                np.add.at(count[g], rows[held], np.add.reduceat(valid, at, dtype=np.int64)[held])
            else:
                total[g] += np.bincount(rows[segment], value, len(texts))
                count[g] += np.bincount(rows[segment], minlength=len(texts))
    return total.T, count.T


def bags(texts: list[bytes], spec: Spec) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its distinct buckets, rising; each one's share of its group's features, added over groups; its count."""
    found: list[list[list[np.ndarray]]] = [[[] for _ in range(groups(spec))] for _ in texts]
    for data, starts, rows in packed(texts, spec.lower):
        for k, (bucket, valid, segment) in enumerate(buckets(data, starts, spec)):
            g = _group(k, spec)
            if segment is None:
                for row, lo, hi in zip(rows.tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
                    found[row][g].append(bucket[lo:hi][valid[lo:hi]])
            else:
                cuts = np.searchsorted(segment, np.arange(len(starts) + 1))
                for j, row in enumerate(rows.tolist()):
                    found[row][g].append(bucket[cuts[j] : cuts[j + 1]])
    out = []
    for text in found:
        parts = [np.concatenate([*x, np.zeros(0, np.int32)]) for x in text]
        ids, at = np.unique(np.concatenate(parts), return_inverse=True)
        share = np.concatenate([np.full(len(x), 1 / max(len(x), 1)) for x in parts])
        out.append((ids, np.bincount(at, share, len(ids)).astype(np.float32), np.bincount(at, minlength=len(ids)).astype(np.int32)))
    return out
