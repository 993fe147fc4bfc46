"""The decoder against streams put together by hand, so that encoder and decoder can't be wrong together."""

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.functions import entropy, parse, tokens
from blockloom.functions.tokens import BadData, decode


def test_literals():
    assert decode(3, b"abc", b"", b"", bytes([0xFF, 2])) == b"abc"
    assert decode(129, b"x" * 129, b"", b"", bytes([0xFF, 127, 0])) == b"x" * 129


def test_recent_matches_move_to_the_front():
    # abcd, slot 2 is distance 4: six bytes; then slot 0 is 4 again
    assert decode(16, b"abcd", b"", b"", bytes([0xFF, 3, 0x80 | 2 << 4, 0x80])) == b"abcd" * 4
    # slot 3 is 8, which then stands first, and 1 second
    assert decode(20, b"abcdefgh", b"", b"", bytes([0xFF, 7, 0x80 | 3 << 4, 0x80 | 1 << 4])) == b"abcdefgh" + b"abcdef" + b"ffffff"


def test_new_matches_and_long_lengths():
    assert decode(9, b"xyz", bytes([3]), b"", bytes([0xFF, 2, 0xC0])) == b"xyzxyzxyz"
    assert decode(1 + 6 + 15 + 200, b"a", b"", bytes([200, 1]), bytes([0xFF, 0, 0x8F])) == b"a" * 222
    assert decode(2 + 6 + 300, b"ab", bytes([2]), bytes([0xAC, 2]), bytes([0xFF, 1, 0xFE])) == b"ab" * 154


def test_marker_resets_the_recent_distances():
    cmd = bytes([0xFF, 2, 0xC0, 0xFF, 0x80])
    assert decode(15, b"xyz", bytes([3]), b"", cmd) == b"xyzxyzxyz" + b"z" * 6


@pytest.mark.parametrize(
    "size,lit,off,length,cmd",
    [
        (10, b"xyz", bytes([4]), b"", bytes([0xFF, 2, 0xC0])),  # distance beyond what there is
        (9, b"xyz", bytes([0]), b"", bytes([0xFF, 2, 0xC0])),  # distance zero
        (8, b"xyz", bytes([3]), b"", bytes([0xFF, 2, 0xC0])),  # more than the block
        (10, b"xyz", bytes([3]), b"", bytes([0xFF, 2, 0xC0])),  # less than the block
        (3, b"xy", b"", b"", bytes([0xFF, 2])),  # literals cut short
        (2, b"xyz", b"", b"", bytes([0xFF, 1])),  # literals left over
        (9, b"xyz", bytes([0x83]), b"", bytes([0xFF, 2, 0xC0])),  # number cut short
        (3, b"xyz", bytes([3]), b"", bytes([0xFF, 2])),  # offsets left over
        (1, b"", b"", b"", b""),
    ],
)
def test_malformed_streams_are_refused(size, lit, off, length, cmd):
    with pytest.raises(BadData):
        decode(size, lit, off, length, cmd)


@pytest.mark.parametrize("value", [0, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, 1 << 28, (1 << 32) - 1])
def test_varints(value):
    data = tokens.varint(value)
    assert tokens.read_varint(b"\x7f" + data + b"\x01", 1) == (value, 1 + len(data))
    for cut in range(len(data)):
        with pytest.raises(BadData):
            tokens.read_varint(data[:cut], 0)
    with pytest.raises(BadData):
        tokens.read_varint(b"\xff\xff\xff\xff\x7f", 0)
    with pytest.raises(ValueError):
        tokens.varint(1 << 32)


def roundtrip(data, level=2):
    streams = parse.encode(data, level)
    assert decode(len(data), *streams) == data
    assert entropy.unpack_streams(entropy.pack_streams(streams)) == streams
    return streams


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=400), st.integers(-1, 5))
def test_any_bytes_come_back(data, level):
    roundtrip(data, level)


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=12), st.integers(1, 60), st.binary(max_size=20))
def test_periodic_data_comes_back(pattern, times, tail):
    roundtrip(pattern * times + tail + pattern * (times // 2))


@pytest.mark.parametrize("n", [*range(17), 1000, 65541, 65542, 1 << 20])
def test_runs(n):
    lit, *_ = roundtrip(b"a" * n)
    assert n < 20 or len(lit) < 20


@pytest.mark.parametrize("period", [2, 3, 4, 7, 8, 127, 128, 129])
def test_periods(period):
    data = bytes((i * 37 + 11) % 251 for i in range(period))
    roundtrip(data * (3000 // period))


@pytest.mark.parametrize("n", range(12))
def test_literal_slices_of_any_size(n):
    blob = entropy.pack_literals(b"q" * n)
    assert entropy.unpack_literals(blob) == b"q" * n
    assert entropy.unpack_literals(entropy.pack_chunks(b"q" * n)) == b"q" * n  # the older form
    for cut in range(len(blob)):
        with pytest.raises(BadData):
            entropy.unpack_literals(blob[:cut])


def test_chunks_that_fail_to_compress_are_raw():
    def fail(data, level):
        raise RuntimeError

    data = bytes(range(256)) * 5000
    blob = entropy.pack_chunks(data, fail)
    assert len(blob) == len(data) + 8 + 8 * 3 and entropy.unpack_chunks(blob) == data


def test_tiers_and_levels():
    assert [parse.min_match_length(d) for d in (1, 127, 128, 16383, 16384, 2097151, 2097152)] == [6, 6, 8, 8, 10, 10, 12]
    assert [parse.attempts(level) for level in (-1, 0, 1, 2, 9)] == [32, 32, 4, 32, 32]


@pytest.mark.parametrize("distance,least", [(100, 6), (127, 6), (128, 8), (5000, 8), (16384, 10)])
def test_matches_keep_to_their_tier(distance, least):
    import random

    rnd = random.Random(distance)
    for size in (least - 1, least):
        data = bytearray(rnd.randrange(256) for _ in range(distance + 200))
        data[distance : distance + size] = data[:size]
        off, length, cmd = parse.encode(bytes(data))[1:]
        found = [t for t in tokens.tokens(off, length, cmd) if t.kind == "new" and t.distance == distance]
        assert bool(found) == (size >= least)


def test_matches_never_leave_their_block():
    text = b"the same text either side of a block edge, long enough to match"
    for _, n, distance, _ in tokens.tokens(*parse.encode(text)[1:]):
        assert not distance or distance <= len(text)
    assert parse.encode(text)[0] == text


def test_checksum_vectors():
    assert xxhash.xxh3_64_digest(b"").hex() == "2d06800538d394c2"
    assert xxhash.xxh3_64_digest(b"abc").hex() == "78af5f94892f3950"
