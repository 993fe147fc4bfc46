"""Repeated strings of a minimum length, by interval expansion on a Burrows-Wheeler transform.

The suffixes of a block of texts are sorted by their first ``length`` bytes. The last column of that order
supports backward extension: the rows that start with a string w are an interval, and
one step maps it to the interval of cw for each byte c before it. Extending breadth first,
intervals of length l end where neighbouring rows share exactly l bytes, so common prefixes come out by
increasing value. The first eight bytes are sort keys, so the intervals of that length are known, and the expansion
starts from those whose end rows share seven bytes. At ``length`` the expansion stops: boundaries that were never reached lie between rows that
share ``length`` bytes or more.
"""

from __future__ import annotations

import numpy as np


#: Bytes of a sort key.
KEY = 8


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All positions, sorted by the ``length`` bytes from there, going round at the end; prefix doubling on ties.

    And how many bytes each row shares with the one before it, at most ``KEY``.
    """
    n = len(text)
    key = np.resize(text, n + 8).astype(np.uint64)
    for have in (1, 2, 4):  # up to KEY bytes
        key = key[:-have] << np.uint64(8 * have) | key[have:]
    key = key[:n]
    order = np.argsort(key)
    placed = key[order]
    differ = placed[1:] ^ placed[:-1]
    shared = np.zeros(n, np.int64)
    for k in range(KEY):
        shared[1:] += differ < np.uint64(1 << 8 * k)
    fresh = np.ones(n, bool)
    fresh[1:] = differ != 0
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    have = 8
    tied = order[~(fresh & np.append(fresh[1:], True))]
    while have < length and len(tied):
        step = min(have, length - have)
        key = (rank[tied] << 32) | rank[(tied + step) % n]
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = key[1:] != key[:-1]
        old = np.ones(len(tied), bool)
        old[1:] = (key[1:] >> 32) != (key[:-1] >> 32)
        at = np.arange(len(tied))
        moved = np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        rank[tied] = (key >> 32) + moved
        have += step
        tied = tied[~(fresh & np.append(fresh[1:], True))]
    # those with a rank of their own have their place; the others follow in order from their rank on
    equal = np.bincount(rank, minlength=n)[rank] > 1
    order[rank[~equal]] = np.flatnonzero(~equal)
    left = np.flatnonzero(equal)
    if len(left):
        left = left[np.argsort(rank[left], kind="stable")]
        ranks = rank[left]
        fresh = np.ones(len(left), bool)
        fresh[1:] = ranks[1:] != ranks[:-1]
        at = np.arange(len(left))
        order[ranks + at - np.maximum.accumulate(np.where(fresh, at, 0))] = left
    return order, shared


def unreached(text: np.ndarray, order: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """Boundaries (row i with row i-1) that share at least ``length`` bytes, as a bool array."""
    n = len(text)
    apart = np.append(shared < min(KEY, length), True)
    apart[0] = True
    ends = np.flatnonzero(apart)
    # intervals of KEY bytes whose last row shares one byte less with the next
    some = np.flatnonzero(np.append(shared, 0)[ends[1:]] == KEY - 1)
    if length <= KEY or not len(some):
        return ~apart[:n]
    low, high = ends[some], ends[some + 1]
    last = text[order - 1]  # the byte before each row's suffix, cyclic
    by_byte = np.argsort(last, kind="stable")  # a radix sort, as these are bytes
    last = last.astype(np.int64)
    keyed = last[by_byte] * n + by_byte  # rank queries are binary searches here
    step = np.empty(n, np.int64)
    step[by_byte] = np.arange(n)  # row to the row of its suffix, one byte longer
    letters = np.unique(last)
    for _ in range(KEY, length):
        if not len(low):
            break
        size = high - low
        one = size == 1
        new_low, new_high = [step[low[one]]], [step[low[one]] + 1]
        wide = size > len(letters)
        few = ~one & ~wide
        if few.any():
            count = size[few]
            ends = np.cumsum(count)
            rows = np.arange(ends[-1]) + np.repeat(low[few] - (ends - count), count)
            to = step[rows]
            # rows of one interval and byte map to neighbours, in order
            group = np.repeat(np.arange(len(count)), count) << 8 | last[rows]
            by = np.argsort(group, kind="stable")
            group, to = group[by], to[by]
            first = np.ones(len(group), bool)
            first[1:] = group[1:] != group[:-1]
            at = np.flatnonzero(first)
            new_low.append(to[at])
            new_high.append(to[np.append(at[1:], len(to)) - 1] + 1)
        if wide.any():
            for c in letters.tolist():
                a = np.searchsorted(keyed, c * n + low[wide])
                b = np.searchsorted(keyed, c * n + high[wide])
                some = b > a
                new_low.append(a[some])
                new_high.append(b[some])
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = ~apart[high]
        low, high = low[fresh], high[fresh]
        apart[high] = True
    return ~apart[:n]


def repeated_starts(texts: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each text, which of its ``length``-byte windows start more than once in the weighted collection.

    A text of weight 2 stands for two equal ones. Windows lie inside one text; texts are set
    apart by zero bytes, which may also occur in them: a window counts only if it ends in its text.
    """
    begins, at = [], 0
    for t in texts:
        begins.append(at)
        at += len(t) + 1
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    order, shared = suffix_order(text, length)
    same = unreached(text, order, shared, length)
    # windows that would cross into the next text don't count, whatever they equal
    weight = np.zeros(len(text), np.int64)
    for b, t, w in zip(begins, texts, weights, strict=True):
        weight[b : b + max(0, len(t) - length + 1)] = w
    group = np.cumsum(~same) - 1
    total = np.bincount(group, weight[order])
    found = np.zeros(len(text), bool)
    found[order] = total[group] >= 2
    return [found[b : b + max(0, len(t) - length + 1)] for b, t in zip(begins, texts, strict=True)]
