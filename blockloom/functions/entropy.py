"""The entropy stage: literals in four Zstandard frames, other streams in frames of 512 KiB.

Literal blob: u64 size with bit 62 set, four u64 frame sizes, the frames. Other blobs: u64 size, a u64 for
each chunk (bit 63: stored raw), the chunks. All numbers are little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from blockloom.functions.tokens import BadData

# Fixed values of the format.
LITERAL_FRAMES, LITERAL_LEVEL = 4, 3
CHUNK, CHUNK_LEVEL = 512 * 1024, 1
FRAMED, RAW = 1 << 62, 1 << 63


def _cuts(size: int, parts: int) -> list[tuple[int, int]]:
    """Slices of equal size rounded up; the last ones may be short or empty."""
    each = -(-size // parts)
    return [(min(size, i * each), min(size, (i + 1) * each)) for i in range(parts)]


def _compress(data: bytes, level: int) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def _expand(frame: bytes, size: int) -> bytes:
    import zstandard

    if not size and not frame:
        return b""
    try:
        data = zstandard.ZstdDecompressor().decompress(frame, max_output_size=max(1, size))
    except zstandard.ZstdError as e:
        raise BadData(str(e)) from e
    if len(data) != size:
        raise BadData("a frame of the wrong size")
    return data


def _numbers(blob: bytes, at: int, count: int) -> tuple[int, ...]:
    if len(blob) < at + 8 * count:
        raise BadData("a blob cut short")
    return struct.unpack_from(f"<{count}Q", blob, at)


def pack_literals(data: bytes) -> bytes:
    frames = [_compress(data[a:b], LITERAL_LEVEL) for a, b in _cuts(len(data), LITERAL_FRAMES)]
    return struct.pack(f"<{1 + LITERAL_FRAMES}Q", len(data) | FRAMED, *map(len, frames)) + b"".join(frames)


def unpack_literals(blob: bytes) -> bytes:
    """Also reads blobs whose literals are in chunks, like the other streams."""
    (head,) = _numbers(blob, 0, 1)
    if not head & FRAMED:
        return unpack_chunks(blob)
    sizes = _numbers(blob, 8, LITERAL_FRAMES)
    at, out = 8 + 8 * LITERAL_FRAMES, []
    for size, (a, b) in zip(sizes, _cuts(head & ~FRAMED, LITERAL_FRAMES), strict=True):
        out.append(_expand(blob[at : at + size], b - a))
        at += size
    if at != len(blob):
        raise BadData("a literal blob of the wrong size")
    return b"".join(out)


def pack_chunks(data: bytes, compress=_compress) -> bytes:
    """``compress`` may fail; the chunk is then stored raw."""
    sizes, out = [], []
    for a in range(0, len(data), CHUNK):
        piece = data[a : a + CHUNK]
        try:
            packed = compress(piece, CHUNK_LEVEL)
            sizes.append(len(packed))
        except Exception:
            packed = piece
            sizes.append(len(piece) | RAW)
        out.append(packed)
    return struct.pack(f"<{1 + len(sizes)}Q", len(data), *sizes) + b"".join(out)


def unpack_chunks(blob: bytes) -> bytes:
    (total,) = _numbers(blob, 0, 1)
    if total > len(blob) << 20:
        raise BadData("a blob that claims too much")
    count = -(-total // CHUNK)
    at, out = 8 + 8 * count, []
    for i, size in enumerate(_numbers(blob, 8, count)):
        want = min(CHUNK, total - i * CHUNK)
        size, raw = size & ~RAW, bool(size & RAW)
        piece = blob[at : at + size]
        if raw and len(piece) != want:
            raise BadData("a raw chunk of the wrong size")
        out.append(piece if raw else _expand(piece, want))
        at += size
    if at != len(blob):
        raise BadData("a blob of the wrong size")
    return b"".join(out)


def pack_streams(streams: tuple[bytes, bytes, bytes, bytes]) -> tuple[bytes, bytes, bytes, bytes]:
    lit, off, length, cmd = streams
    return pack_literals(lit), pack_chunks(off), pack_chunks(length), pack_chunks(cmd)


def unpack_streams(blobs: tuple[bytes, bytes, bytes, bytes]) -> tuple[bytes, bytes, bytes, bytes]:
    lit, off, length, cmd = blobs
    return unpack_literals(lit), unpack_chunks(off), unpack_chunks(length), unpack_chunks(cmd)


def _covering(read: Callable, at: int, sizes: list[int], cuts: list[tuple[int, int]], raw: list[bool], a: int, b: int) -> bytes:
    """Bytes a..b of a stream cut at ``cuts``, whose packed pieces of ``sizes`` follow each other from ``at``."""
    out, begin = [], 0
    for size, (first, end), plain in zip(sizes, cuts, raw, strict=True):
        if first < b and end > a:
            packed = read(at, size)
            piece = packed if plain else _expand(packed, end - first)
            if len(piece) != end - first:
                raise BadData("a raw chunk of the wrong size")
            begin = first if not out else begin
            out.append(piece)
        at += size
    return b"".join(out)[a - begin : b - begin]


def slice_blob(read: Callable, a: int, b: int) -> bytes:
    """Bytes a..b of the stream in a blob, of which ``read(at, n)`` gives n bytes from ``at``; frames beside them stay unread."""
    if a >= b:
        return b""
    (head,) = _numbers(read(0, 8), 0, 1)
    total = head & ~FRAMED
    if b > total:
        raise BadData("a block that points outside its streams")
    if head & FRAMED:
        sizes = list(_numbers(read(8, 8 * LITERAL_FRAMES), 0, LITERAL_FRAMES))
        return _covering(read, 8 + 8 * LITERAL_FRAMES, sizes, _cuts(total, LITERAL_FRAMES), [False] * LITERAL_FRAMES, a, b)
    count = -(-total // CHUNK)
    table = _numbers(read(8, 8 * count), 0, count)
    cuts = [(i * CHUNK, min(total, (i + 1) * CHUNK)) for i in range(count)]
    return _covering(read, 8 + 8 * count, [x & ~RAW for x in table], cuts, [bool(x & RAW) for x in table], a, b)
