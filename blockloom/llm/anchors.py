"""Winnowed anchors: places that equal strings of a given length are sure to share.

The anchor of a window of ``length`` bytes is its ``gram``-byte substring of least hash, the leftmost of equal
ones. Equal windows have equal anchors at equal offsets, and successive windows mostly keep
theirs, so windows fall into runs, one anchor each.
"""

from __future__ import annotations

import numpy as np

GRAM = 120
_LOW = (1 << 24) - 1
#: Bytes handled at a time, at some 130 bytes of memory each; positions must fit 24 bits.
CHUNK = 1 << 19

_BYTES = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = 1 << max(12, n.bit_length())
    if size not in _POWERS:
        both = [np.full(size, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
        for a in both:
            a[0] = 1
        _POWERS[size] = tuple(np.cumprod(a, dtype=np.uint64) for a in both)
    up, down = _POWERS[size]
    return up[:n], down[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes, by prefix sums of a polynomial modulo 2^64."""
    up, down = _powers(len(data))
    sums = np.cumsum(_BYTES[data] * down, dtype=np.uint64)
    h = sums[gram - 1 :].copy()
    h[1:] -= sums[:-gram]
    h *= up[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, anchor place and anchor hash of each run.

    data: texts laid end to end, at most 2^24 bytes; ends: where each text ends. Windows don't cross ends.
    """
    n, w = len(data), length - gram + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(data, gram)
    packed = (h & np.uint64(~_LOW & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
    pad = -len(packed) % w
    block = np.append(packed, np.full(pad, (1 << 64) - 1, np.uint64)).reshape(-1, w)
    left = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(block, axis=1).ravel()
    least = np.minimum(left[: len(packed) - w + 1], right[w - 1 : len(packed)])
    anchor = (least & np.uint64(_LOW)).astype(np.int64)
    # a window is valid if it ends in the text that it starts in
    steps = np.zeros(n + 1, np.int32)
    begins = np.append(0, ends[:-1])
    long = ends - begins >= length
    np.add.at(steps, begins[long], 1)
    np.add.at(steps, ends[long] - length + 1, -1)
    valid = np.cumsum(steps)[: len(anchor)] > 0
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = anchor[1:] != anchor[:-1]
    fresh[begins[begins < len(fresh)]] = True
    # runs end where the anchor changes, a text begins or windows stop being valid
    fresh[1:] |= valid[1:] != valid[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(anchor)) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    return first, last, anchor[first], h[anchor[first]]
