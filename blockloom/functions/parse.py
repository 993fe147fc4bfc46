"""The parse of a block into literals and matches.

Match candidates are found for all positions at once: positions are grouped by the value of their next six (and
eight) bytes, and each knows its predecessors in its group. No match is shorter than six bytes, so positions
without such a predecessor are passed over. Only the greedy walk over the others is sequential.
Nothing is carried from one block to the next, so blocks are independent.
"""

from __future__ import annotations

import numpy as np

from blockloom.functions.tokens import MAX_MATCH, MIN_LENGTH, TokenWriter

#: The last bytes of a block are always literals.
TAIL = 12
#: Least match length for distances below each bound, and beyond them.
TIERS = ((128, 6), (16_384, 8), (2_097_152, 10))
BEYOND = 12
#: Matches at least this long aren't weighed against one a byte or two later.
LAZY_BELOW = 64
#: Candidates looked at for one position.
MOST_CANDIDATES = 36
#: An odd multiplier, 2**64 over the golden ratio, that spreads values over the high bits.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def min_match_length(distance: int) -> int:
    for bound, least in TIERS:
        if distance < bound:
            return least
    return BEYOND


def attempts(level: int) -> int:
    """Search effort of a level; 0 or less means the default, 2."""
    return 32 if level >= 2 or level <= 0 else 4


def previous_same(block: bytes, width: int) -> np.ndarray:
    """For each position the nearest earlier one with the same next ``width`` bytes (at most eight); -1 if none.

    Hashes carry their positions in the low bits, so one plain sort groups equal values in order. Different values with
    one hash can hide a predecessor from each other, never give a wrong one.
    """
    n = len(block) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value = np.ndarray(n, "<u8", block + bytes(8), 0, (1,)) & np.uint64((1 << 8 * width) - 1)
    low = np.uint64((n - 1).bit_length())
    key = (value * SPREAD >> low << low) | np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    value = value[order]
    same = value[1:] == value[:-1]
    before = np.full(n, -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    return before


def common_length(block: bytes, a: int, b: int, most: int) -> int:
    """How many bytes from a and from b agree, at most ``most``; doubling slices."""
    done, step = 0, 16
    while done < most:
        step = min(step, most - done)
        x, y = block[a + done : a + done + step], block[b + done : b + done + step]
        if x != y:
            differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return done + ((differ & -differ).bit_length() - 1) // 8
        done += step
        step *= 2
    return most


def encode(block: bytes, level: int = 2) -> tuple[bytes, bytes, bytes, bytes]:
    """Streams (literals, offsets, lengths, commands) of a block, an empty one included."""
    writer = TokenWriter()
    n = len(block)
    end = n - TAIL
    if end > 0:
        chain, near = previous_same(block, 8).tolist(), previous_same(block, MIN_LENGTH)[:end]
        # the next position that can start a match
        onward = np.minimum.accumulate(np.where(near >= 0, np.arange(end), end)[::-1])[::-1].tolist()
        near = near.tolist()
    effort = min(attempts(level), MOST_CANDIDATES)

    def longest(at: int) -> tuple[int, int]:
        """(length, distance) of the best match at a position; recent distances win ties."""
        most = min(n - at, MAX_MATCH)
        best = found = 0
        first = block[at]
        for distance in writer.recent:
            here = at - distance
            if here >= 0 and block[here] == first and block[here : here + MIN_LENGTH] == block[at : at + MIN_LENGTH]:
                length = common_length(block, at, at - distance, most)
                if length > best:
                    best, found = length, distance
        here, tries = chain[at], effort
        while here >= 0 and tries and best < most:
            tries -= 1
            distance = at - here
            # only a longer match matters, so its last byte is looked at first
            if block[here + best] == block[at + best]:
                length = common_length(block, at, here, most)
                if length > best and length >= min_match_length(distance):
                    best, found = length, distance
            here = chain[here]
        if not best and at - near[at] < TIERS[0][0]:  # six or seven bytes, close by
            best, found = common_length(block, at, near[at], most), at - near[at]
        return best, found

    at = pending = 0
    while at < end:
        at = onward[at]
        if at >= end:
            break
        length, distance = longest(at)
        if not length:
            at += 1
            continue
        for ahead in (1, 2):  # a longer match just after is worth the literals
            if length < LAZY_BELOW and at + ahead < end and chain[at + ahead] >= 0:
                later, back = longest(at + ahead)
                if later > length + ahead and back != writer.recent[0]:
                    at, length, distance = at + ahead, later, back
                    break
        if at > pending:
            writer.literals(block[pending:at])
        writer.match(length, distance)
        at += length
        pending = at
    if n > pending:
        writer.literals(block[pending:])
    return writer.streams()
