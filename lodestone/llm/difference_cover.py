"""Suffix arrays by the difference-cover algorithm (modulo 3), in whole-array steps.

Triples at positions 1 and 2 modulo 3 are sorted and named; if names repeat,
the suffixes of the string of names are sorted by recursion; the suffixes at
positions 0 modulo 3 follow from the next position's rank; both sorted lists
are merged by searching the packed keys of the one in those of the other.
"""

from __future__ import annotations

import numpy as np

#: Symbols of one string at most: three ranks are packed into 63 bits.
LIMIT = 1 << 20
BITS = 21


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the sorted suffixes of ``s``, whose symbols are 1 .. 2**20."""
    n = len(s)
    if n > LIMIT:
        raise ValueError("string too long")
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.zeros(n + 4, dtype=np.int64)
    t[:n] = s
    end = n + (n % 3 == 1)  # a dummy triple keeps the two halves of the names apart
    ones, twos = np.arange(1, end, 3), np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    key = (t[sample] << 2 * BITS) | (t[sample + 1] << BITS) | t[sample + 2]
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate(([1], (np.diff(key[order]) != 0).astype(np.int64)))
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(fresh)
    if names[order[-1]] < len(sample):
        order = suffix_array(names)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample] = names
    sorted12 = sample[order]
    sorted12 = sorted12[sorted12 < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort((t[zeros] << BITS) | rank[zeros + 1], kind="stable")]
    first, second = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    before = np.searchsorted((t[first] << BITS) | rank[first + 1], (t[zeros] << BITS) | rank[zeros + 1])
    before += np.searchsorted((t[second] << 2 * BITS) | (t[second + 1] << BITS) | rank[second + 2], (t[zeros] << 2 * BITS) | (t[zeros + 1] << BITS) | rank[zeros + 2])
    out = np.empty(n, dtype=np.int64)
    place = before + np.arange(len(zeros))
    rest = np.ones(n, dtype=bool)
    rest[place] = False
    out[place] = zeros
    out[rest] = sorted12
    return out


def long_prefixes(text: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """For each two adjacent suffixes in ``order`` whether their first ``size`` symbols agree.

    ``text`` holds bytes; all positions in ``order`` have ``size`` bytes after them.
    """
    words = np.zeros(max(len(text) - 7, 0), dtype=np.uint64)
    for k in range(8):
        words |= text[k : len(words) + k].astype(np.uint64) << np.uint64(8 * k)
    same = np.arange(len(order) - 1) if len(order) else np.zeros(0, np.int64)
    for at in [*range(0, size - 7, 8), size - 8]:
        same = same[words[order[same] + at] == words[order[same + 1] + at]]
    out = np.zeros(max(len(order) - 1, 0), dtype=bool)
    out[same] = True
    return out
