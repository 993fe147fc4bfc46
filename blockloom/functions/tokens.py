"""The token grammar of a block: four byte streams, literals, offsets, lengths and commands.

Commands: 0x00-0x7F a run of 1 to 128 literals; 10ssLLLL a match at a recent distance (slot ss); 11LLLLLL a match at a
new distance, which goes to the front of the recent ones; 0xFF resets them. Match lengths
count from 6; a full length field goes on in the length stream. Offsets and lengths are LEB128.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

# Fixed values of the format.
MARKER = 0xFF
LONG_MATCH = 0xFE
MIN_LENGTH = 6
RECENT = (1, 2, 4, 8)
MAX_LITERALS = 128
MAX_MATCH = 65_535


class BadData(ValueError):
    """A stream that is no encoding of a block of the given size."""


class Token(NamedTuple):
    """kind: literal, recent, new or marker; slot: of a recent distance, else -1."""

    kind: str
    length: int
    distance: int
    slot: int


def varint(value: int) -> bytes:
    """Unsigned LEB128 of a 32-bit value."""
    if not 0 <= value < 1 << 32:
        raise ValueError(f"{value} is no unsigned 32-bit value")
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position); rejects truncated and over-long numbers."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 28:
            raise BadData("number cut short or too long")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            if value >= 1 << 32:
                raise BadData("number above 32 bits")
            return value, at
        shift += 7


class TokenWriter:
    """Builds the four streams of one block, and keeps the recent distances."""

    def __init__(self) -> None:
        self.lit, self.off, self.len = bytearray(), bytearray(), bytearray()
        self.cmd = bytearray([MARKER])
        self.recent = list(RECENT)

    def literals(self, data: bytes) -> None:
        self.lit += data
        whole, rest = divmod(len(data), MAX_LITERALS)
        self.cmd += bytes([MAX_LITERALS - 1]) * whole
        if rest:
            self.cmd.append(rest - 1)

    def match(self, length: int, distance: int) -> None:
        extra = length - MIN_LENGTH
        if distance in self.recent:
            slot = self.recent.index(distance)
            self.cmd.append(0x80 | slot << 4 | min(extra, 15))
            if extra >= 15:
                self.len += varint(extra - 15)
            self.recent.insert(0, self.recent.pop(slot))
            return
        if extra < 62:
            self.cmd.append(0xC0 | extra)
        else:
            self.cmd.append(LONG_MATCH)
            self.len += varint(extra)
        self.off += varint(distance)
        self.recent = [distance, *self.recent[:3]]

    def streams(self) -> tuple[bytes, bytes, bytes, bytes]:
        return bytes(self.lit), bytes(self.off), bytes(self.len), bytes(self.cmd)


def tokens(off: bytes, length: bytes, cmd: bytes) -> Iterator[Token]:
    """The tokens of a block; literals themselves aren't needed."""
    recent = list(RECENT)
    at_off = at_len = 0
    for c in cmd:
        if c == MARKER:
            recent = list(RECENT)
            yield Token("marker", 0, 0, -1)
        elif c < 0x80:
            yield Token("literal", c + 1, 0, -1)
        elif c < 0xC0:
            slot, extra = c >> 4 & 3, c & 15
            if extra == 15:
                more, at_len = read_varint(length, at_len)
                extra += more
            recent.insert(0, recent.pop(slot))
            yield Token("recent", extra + MIN_LENGTH, recent[0], slot)
        else:
            extra = c & 63
            if c == LONG_MATCH:
                extra, at_len = read_varint(length, at_len)
            distance, at_off = read_varint(off, at_off)
            recent = [distance, *recent[:3]]
            yield Token("new", extra + MIN_LENGTH, distance, -1)
    if at_off != len(off) or at_len != len(length):
        raise BadData("offsets or lengths are left over")


def repeat_copy(out: bytearray, distance: int, length: int) -> None:
    """Appends ``length`` bytes from ``distance`` back; a copy that overlaps itself repeats."""
    start = len(out) - distance
    if distance >= length:
        out += out[start : start + length]
    else:
        pattern = bytes(out[start:])
        out += (pattern * (length // distance + 1))[:length]


def decode(raw_size: int, lit: bytes, off: bytes, length: bytes, cmd: bytes) -> bytes:
    """The block; raises :class:`BadData` unless the streams give exactly ``raw_size`` bytes and are used up."""
    out = bytearray()
    at = 0
    for kind, n, distance, _ in tokens(off, length, cmd):
        if len(out) + n > raw_size:
            raise BadData("more bytes than the block has")
        if kind == "literal":
            if at + n > len(lit):
                raise BadData("literals cut short")
            out += lit[at : at + n]
            at += n
        elif n:
            if not 0 < distance <= len(out):
                raise BadData(f"distance {distance} with {len(out)} bytes before")
            repeat_copy(out, distance, n)
    if len(out) != raw_size or at != len(lit):
        raise BadData("fewer bytes than the block has, or literals left over")
    return bytes(out)
