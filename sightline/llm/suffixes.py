"""Suffix arrays by Larsson-Sadakane refinement and Kasai common prefixes, in numpy, for the text of one shard."""

from __future__ import annotations

import numpy as np

#: Bytes packed in the first key; 9 bits each, so that the end of the text sorts before any byte.
PACKED = 7


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order.

    Suffixes are sorted by their first bytes; groups of ties are refined by the rank of what follows them, doubling the
    length each round, and only groups that aren't single yet are touched.
    """
    n = len(text)
    padded = np.zeros(n + PACKED, np.int64)
    padded[:n] = text.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for k in range(PACKED):
        key = key << 9 | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    key, todo, rank, length = key[order], np.arange(n), np.zeros(n, np.int64), PACKED
    suffix = order.copy()
    while len(todo):
        first = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(first) - 1
        rank[suffix[todo]] = todo[np.flatnonzero(first)[group]]
        todo = todo[np.bincount(group)[group] > 1]
        here = suffix[todo]
        after = here + length
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[here] * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        key, suffix[todo] = key[order], here[order]
        length *= 2
    return suffix


def common_prefixes(text: np.ndarray, suffix: np.ndarray, most: int, step: int = 32) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, up to ``most``; 0 for the first.

    By Kasai's inequality a suffix shares at least what the one a byte before it in the text shares, less one. So each
    ``step``-th is compared from nothing, and the others from what it leaves them; all of a kind at once.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[suffix[1:]] = suffix[:-1]
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    eight = np.zeros(n + 1, np.uint64)
    for k in range(8):
        eight[:n] |= padded[k : n + k].astype(np.uint64) << np.uint64(8 * k)
    shared = np.zeros(n, np.int64)

    def extend(at: np.ndarray) -> None:
        at = at[before[at] >= 0]
        while len(at):
            a, b, length = at, before[at], shared[at]
            room = np.minimum(n - np.maximum(a, b), most) - length
            differ = eight[np.minimum(a + length, n)] ^ eight[np.minimum(b + length, n)]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            more = np.minimum(same, np.maximum(room, 0))
            shared[at] = length + more
            at = at[(more == 8) & (room > 8)]

    extend(np.arange(0, n, step))
    for k in range(1, step):
        rest = np.arange(k, n, step)
        shared[rest] = np.where(before[rest] >= 0, np.maximum(shared[rest - 1] - 1, 0), 0)
        extend(rest)
    return shared[suffix]
