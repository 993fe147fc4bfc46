"""Container files: a header and either global streams with an index, or self-contained chunks.

``indexed``: header, one index entry a block, then four blobs, each over the whole object.
``interleaved``: the same header and index, but each block has blobs of its own, and entries point at those.
``chunked``: a header, then a record a chunk with blobs of its own.
All numbers are little-endian. The checksum of a chunked file, whose header has no room for one, stands in a
trailer after the payload; readers that don't know it never look there.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

from blockloom.functions.entropy import pack_chunks, pack_literals, pack_streams, slice_blob, unpack_streams
from blockloom.functions.tokens import BadData, decode
from blockloom.operators.codec import checksum

#: First eight bytes of our files. Files of other writers of these layouts are read by giving theirs.
MAGIC_INDEXED, MAGIC_INTERLEAVED, MAGIC_CHUNKED, TRAILER = b"BLKLOOM2", b"BLKLOOMI", b"BLKLOOM3", b"BLKLOOMX"


class Form:
    """A fixed binary record (struct.Struct can't be sent to the executors)."""

    def __init__(self, form: str):
        self.form, self.size = form, struct.calcsize(form)

    def pack(self, *values) -> bytes:
        return struct.pack(self.form, *values)

    def unpack_from(self, data: bytes, at: int = 0) -> tuple:
        return struct.unpack_from(self.form, data, at)


# Fixed values of the layouts.
HEADER = Form("<8sIQII8s4Q")
ENTRY = Form("<8Q")
CHUNKED = Form("<8sIIQII")
RECORD = Form("<II5Q")
RECORD_MAGIC = 0x434B4E48
VERSION_INDEXED, VERSION_CHUNKED = 2, 3

Streams = tuple[bytes, bytes, bytes, bytes]


class Block(NamedTuple):
    """A block as stored: raw size, packed or plain streams, checksum or None, whether packed."""

    raw_size: int
    streams: Streams
    xxh3: bytes | None
    packed: bool


def _sums(sizes: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    at, out = [0] * 4, []
    for row in sizes:
        out.append(tuple(at))
        at = [a + s for a, s in zip(at, row, strict=True)]
    return out


def write_indexed(payload: bytes, block_size: int, blocks: list[Streams], magic: bytes = MAGIC_INDEXED) -> bytes:
    """``blocks``: the plain streams of each block, in order."""
    sizes = [tuple(map(len, b)) for b in blocks]
    index = b"".join(ENTRY.pack(*off, *size) for off, size in zip(_sums(sizes), sizes, strict=True))
    whole = [b"".join(b[i] for b in blocks) for i in range(4)]
    blobs = [pack_literals(whole[0]), *map(pack_chunks, whole[1:])]
    # the stored checksum is the number in the machine's order
    head = HEADER.pack(magic, VERSION_INDEXED, len(payload), block_size, len(blocks), checksum(payload)[::-1], *map(len, blobs))
    return head + index + b"".join(blobs)


def write_interleaved(payload: bytes, block_size: int, blocks: list[Streams], magic: bytes = MAGIC_INTERLEAVED) -> bytes:
    packed = [pack_streams(b) for b in blocks]
    at, index = 0, []
    for b in packed:
        sizes = list(map(len, b))
        index.append(ENTRY.pack(*(at + sum(sizes[:i]) for i in range(4)), *sizes))
        at += sum(sizes)
    head = HEADER.pack(magic, VERSION_INDEXED, len(payload), block_size, len(blocks), checksum(payload)[::-1], at, 0, 0, 0)
    return head + b"".join(index) + b"".join(b"".join(b) for b in packed)


def write_chunked(payload: bytes, chunk_size: int, blocks: list[Streams], magic: bytes = MAGIC_CHUNKED) -> bytes:
    out = [CHUNKED.pack(magic, VERSION_CHUNKED, 0, len(payload), len(blocks), chunk_size)]
    for i, b in enumerate(blocks):
        packed = pack_streams(b)
        out.append(RECORD.pack(RECORD_MAGIC, 0, min(chunk_size, len(payload) - i * chunk_size), *map(len, packed)))
        out += packed
    return b"".join(out) + TRAILER + checksum(payload)[::-1]


class Manifest(NamedTuple):
    """What a header tells; xxh3 is None if the file has no checksum."""

    layout: str
    orig_size: int
    block_size: int
    num_blocks: int
    xxh3: bytes | None


def _trailer(data: bytes, at: int) -> bytes | None:
    return data[at + 8 : at + 16][::-1] if data[at : at + 8] == TRAILER and len(data) >= at + 16 else None


def _take(data: bytes, at: int, form: Form) -> tuple:
    if len(data) < at + form.size:
        raise BadData("a file cut short")
    return form.unpack_from(data, at)


class Magic(NamedTuple):
    """First bytes of each layout."""

    indexed: bytes = MAGIC_INDEXED
    interleaved: bytes = MAGIC_INTERLEAVED
    chunked: bytes = MAGIC_CHUNKED


OURS = Magic()


def manifest(data: bytes, magic: Magic = OURS) -> Manifest:
    if data[:8] in (magic.indexed, magic.interleaved):
        _, version, size, block, count, xxh3, *_ = _take(data, 0, HEADER)
        if version != VERSION_INDEXED or block < 1 or count != -(-size // block):
            raise BadData("a header that contradicts itself")
        # some writers leave the checksum of interleaved files out
        layout = "indexed" if data[:8] == magic.indexed else "interleaved"
        return Manifest(layout, size, block, count, xxh3[::-1] if layout == "indexed" or any(xxh3) else None)
    if data[:8] == magic.chunked:
        _, version, _, size, count, block = _take(data, 0, CHUNKED)
        if version != VERSION_CHUNKED or block < 1 or count != -(-size // block):
            raise BadData("a header that contradicts itself")
        return Manifest("chunked", size, block, count, _trailer(data, len(data) - 16))
    raise BadData("no container")


def decoded_size(data: bytes, magic: Magic = OURS) -> int:
    """Size of the object in a container; 0 if it is none."""
    try:
        return manifest(data, magic).orig_size
    except BadData:
        return 0


def read_blocks(data: bytes, wanted: range | None = None, magic: Magic = OURS) -> list[tuple[int, Block]]:
    """(block_id, block) of the ``wanted`` blocks, all by default; raises :class:`BadData` on damage.

    Interleaved and chunked files give up single blocks without the others being expanded.
    """
    m = manifest(data, magic)
    wanted = range(m.num_blocks) if wanted is None else wanted
    raw = lambda i: min(m.block_size, m.orig_size - i * m.block_size)
    out = []
    if m.layout == "chunked":
        at = CHUNKED.size
        for i in range(m.num_blocks):
            mark, _, size, *sizes = _take(data, at, RECORD)
            if mark != RECORD_MAGIC or size != raw(i):
                raise BadData(f"chunk {i} has a bad record")
            at += RECORD.size
            if i in wanted:
                cuts = [at + sum(sizes[:k]) for k in range(5)]
                out.append((i, Block(size, tuple(data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), None, True)))
            at += sum(sizes)
        return out
    base = HEADER.size + m.num_blocks * ENTRY.size
    entries = {i: _take(data, HEADER.size + i * ENTRY.size, ENTRY) for i in wanted}
    if m.layout == "interleaved":
        for i, e in entries.items():
            out.append((i, Block(raw(i), tuple(data[base + o : base + o + s] for o, s in zip(e[:4], e[4:], strict=True)), None, True)))
        return out
    sizes = HEADER.unpack_from(data)[6:]
    cuts = [base + sum(sizes[:k]) for k in range(5)]
    whole = unpack_streams(tuple(data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))) if m.num_blocks else (b"",) * 4
    for i, e in entries.items():
        if any(o + s > len(w) for o, s, w in zip(e[:4], e[4:], whole, strict=True)):
            raise BadData(f"block {i} points outside its streams")
        out.append((i, Block(raw(i), tuple(w[o : o + s] for o, s, w in zip(e[:4], e[4:], whole, strict=True)), None, False)))
    return out


def record_places(read: Callable, count: int, every: int) -> list[int]:
    """Where the records of chunks 0, ``every``, 2 * ``every``, ... of a chunked file begin; only record heads are read."""
    places, at = [], CHUNKED.size
    for i in range(count):
        if i % every == 0:
            places.append(at)
        mark, _, _, *sizes = _take(read(at, RECORD.size), 0, RECORD)
        if mark != RECORD_MAGIC:
            raise BadData(f"chunk {i} has a bad record")
        at += RECORD.size + sum(sizes)
    return places


def read_range(read: Callable, first: int, last: int, place: int | None = None, magic: Magic = OURS) -> Iterator[tuple[int, int, Block | None]]:
    """(block_id, raw_size, block) of the blocks first to last - 1 of a file, of which ``read(at, n)`` gives n bytes from ``at``.

    Only the header, the blocks' own index entries, and their bytes are read; of an indexed file, whose streams are
    packed as a whole, the frames that hold them. ``place``: where the record of ``first`` begins in a chunked
    file; see :func:`record_places`. A block that can't be read is None.
    """
    m = manifest(read(0, HEADER.size), magic)
    raw = lambda i: min(m.block_size, m.orig_size - i * m.block_size)
    if m.layout == "chunked":
        at = record_places(read, first + 1, 1)[first] if place is None else place
        for i in range(first, last):
            mark, _, size, *sizes = _take(read(at, RECORD.size), 0, RECORD)
            if mark != RECORD_MAGIC or size != raw(i):
                yield from ((j, raw(j), None) for j in range(i, last))  # nothing tells where the next record is
                return
            data = read(at + RECORD.size, sum(sizes))
            cuts = [sum(sizes[:k]) for k in range(5)]
            yield i, size, Block(size, tuple(data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), None, True)
            at += RECORD.size + sum(sizes)
        return
    base = HEADER.size + m.num_blocks * ENTRY.size
    index = read(HEADER.size + first * ENTRY.size, (last - first) * ENTRY.size)
    entries = [_take(index, k * ENTRY.size, ENTRY) for k in range(last - first)]
    if m.layout == "interleaved":
        for i, e in enumerate(entries, first):
            yield i, raw(i), Block(raw(i), tuple(read(base + o, s) for o, s in zip(e[:4], e[4:], strict=True)), None, True)
        return
    sizes = HEADER.unpack_from(read(0, HEADER.size))[6:]
    begins = [base + sum(sizes[:k]) for k in range(4)]
    bounds = [(min(e[k] for e in entries), max(e[k] + e[4 + k] for e in entries)) for k in range(4)]
    try:
        parts = [slice_blob(lambda at, n, b=b: read(b + at, n), lo, hi) for b, (lo, hi) in zip(begins, bounds, strict=True)]
    except BadData:
        yield from ((i, raw(i), None) for i in range(first, last))
        return
    for i, e in enumerate(entries, first):
        yield i, raw(i), Block(raw(i), tuple(p[o - lo : o - lo + s] for o, s, p, (lo, _) in zip(e[:4], e[4:], parts, bounds, strict=True)), None, False)


def read_object(data: bytes, magic: Magic = OURS) -> bytes:
    """The object of a container, verified where it has a checksum."""
    m = manifest(data, magic)
    parts = [decode(b.raw_size, *(unpack_streams(b.streams) if b.packed else b.streams)) for _, b in read_blocks(data, None, magic)]
    whole = b"".join(parts)
    if m.xxh3 is not None and checksum(whole) != m.xxh3:
        raise BadData("checksum differs")
    return whole
