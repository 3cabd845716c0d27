"""The binary Golay code of length 23: each word lies within three errors of exactly one of its 4096 codewords."""

from __future__ import annotations

import functools

import numpy as np

#: Fixed value: the code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECKS = 23, 11


def remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; by syndrome the patterns to codewords near by, and whether there are several.

    A word's own pattern comes first. The others are those that its 23 neighbours at one error decode by; a word within
    two errors of its codeword has none, a word at three errors has five more.
    """
    low = np.array([remainder(w) for w in range(1 << 12)], np.int32)
    high = np.array([remainder(w << 12) for w in range(1 << 11)], np.int32)
    single = [1 << i for i in range(LENGTH)]
    own = np.zeros(1 << CHECKS, np.int64)
    for i in range(LENGTH):
        own[remainder(single[i])] = single[i]
        for j in range(i):
            own[remainder(single[i] | single[j])] = single[i] | single[j]
            for k in range(j):
                own[remainder(single[i] | single[j] | single[k])] = single[i] | single[j] | single[k]
    near = np.zeros((1 << CHECKS, 6), np.int64)
    several = np.zeros(1 << CHECKS, bool)
    for syndrome in range(1 << CHECKS):
        found = dict.fromkeys([int(own[syndrome]), *(int(own[syndrome ^ remainder(s)]) ^ s for s in single)])
        several[syndrome] = len(found) > 1
        near[syndrome, : len(found)] = list(found)
    return low, high, near, several


def near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices (12 bits) of each word and of its neighbours at one error, in 6 columns; and how many hold: 1 or 6.

    Words at two errors or fewer from each other have a common neighbour or are neighbours, and so share an index.
    """
    low, high, patterns, several = _tables()
    words = words.astype(np.int64)
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ patterns[syndrome]) >> CHECKS, np.where(several[syndrome], 6, 1)
