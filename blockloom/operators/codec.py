"""Encoding and decoding of block rows, in Arrow kernels; a block is a row and needs no other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions import parse, tokens
from blockloom.functions.entropy import pack_streams, unpack_streams
from blockloom.operators.blocks import BLOCK_SIZE, STREAMS, split_blocks, spread

OK, BAD_DATA, BAD_CHECKSUM, NULL, MISSING = "OK", "BAD_DATA", "BAD_CHECKSUM", "NULL", "MISSING"


def checksum(data: bytes) -> bytes:
    """XXH3-64, seed 0, big-endian."""
    import xxhash

    return xxhash.xxh3_64_digest(data)


def _encode(level: int, entropy: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for payload in batch.column("payload").to_pylist():
                if payload is None:
                    row = (None, None, None, None, None, NULL)
                else:
                    streams = parse.encode(payload, level)
                    row = (*(pack_streams(streams) if entropy else streams), checksum(payload), OK)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.binary()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("object_id", "block_id", "raw_size")), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["object_id", "block_id", "raw_size", *STREAMS, "xxh3", "status"])

    return run


def encode_blocks(blocks: DataFrame, level: int = 2, entropy: bool = True) -> DataFrame:
    """(object_id, block_id, raw_size, lit, off, len, cmd, xxh3, status) of (object_id, block_id, raw_size, payload).

    ``entropy`` compresses each stream of each block for itself, so that blocks stay independent.
    Works on streaming frames too. A null payload has null streams and status NULL.
    """
    kind = blocks.schema["object_id"].dataType.simpleString()
    return blocks.select("object_id", "block_id", "raw_size", "payload").mapInArrow(_encode(level, entropy), f"object_id {kind}, block_id long, raw_size long, lit binary, off binary, len binary, cmd binary, xxh3 binary, status string")


def decode_one(raw_size: int, streams: tuple[bytes, bytes, bytes, bytes], xxh3: bytes | None, entropy: bool) -> tuple[bytes | None, str]:
    """(payload, status); the payload is null unless it is whole and its checksum agrees."""
    if raw_size is None or any(s is None for s in streams):
        return None, NULL
    try:
        data = tokens.decode(raw_size, *(unpack_streams(streams) if entropy else streams))
    except tokens.BadData:
        return None, BAD_DATA
    return (data, OK) if xxh3 is None or checksum(data) == xxh3 else (None, BAD_CHECKSUM)


def _decode(entropy: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("raw_size", *STREAMS, "xxh3")]
            found = [decode_one(n, streams, x, entropy) for n, *streams, x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("object_id"), batch.column("block_id"), batch.column("raw_size"), pa.array([p for p, _ in found], pa.binary()), pa.array([s for _, s in found], pa.string())], names=["object_id", "block_id", "raw_size", "payload", "status"])

    return run


def decode_blocks(encoded: DataFrame, entropy: bool = True) -> DataFrame:
    """(object_id, block_id, raw_size, payload, status). Filter ``encoded`` first to decode a few blocks only.

    Damaged blocks come back with a null payload and a status; see :func:`quarantine`.
    """
    kind = encoded.schema["object_id"].dataType.simpleString()
    return encoded.select("object_id", "block_id", "raw_size", *STREAMS, "xxh3").mapInArrow(_decode(entropy), f"object_id {kind}, block_id long, raw_size long, payload binary, status string")


def quarantine(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): an object with any damaged block is bad as a whole, as (object_id, status)."""
    bad = decoded.filter(F.col("status") != OK).groupBy("object_id").agg(F.min("status").alias("status"))
    return decoded.join(bad, "object_id", "left_anti"), bad


def assembled(decoded: DataFrame) -> DataFrame:
    """(object_id, payload, status): blocks joined in order, in one pass over ``decoded``.

    An object with a damaged block, or with fewer blocks than its last one's number says, has a null payload and that
    status. An object has to fit a row, so its blocks are few.
    """
    kind = decoded.schema["object_id"].dataType.simpleString()
    block = F.struct("block_id", "payload")
    each = decoded.groupBy("object_id").agg(F.min(F.when(F.col("status") != OK, F.col("status"))).alias("bad"), F.count("*").alias("n"), F.max("block_id").alias("last"), F.sort_array(F.collect_list(block)).alias("b"))
    status = F.coalesce("bad", F.when(F.col("n") != F.col("last") + 1, F.lit(MISSING)).otherwise(F.lit(OK)))
    parts = each.select("object_id", status.alias("status"), F.col("b.payload").alias("parts"))
    return parts.select("object_id", "status", F.when(F.col("status") == OK, F.col("parts")).alias("parts")).mapInArrow(_assemble, f"object_id {kind}, payload binary, status string")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        joined = [None if parts is None else b"".join(parts) for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("object_id"), pa.array(joined, pa.binary()), batch.column("status")], names=["object_id", "payload", "status"])


def roundtrip(objs: DataFrame, block_size: int = BLOCK_SIZE, level: int = 2, entropy: bool = True) -> DataFrame:
    """(object_id, payload) after splitting, encoding, decoding and joining; empty objects come back empty."""
    decoded = decode_blocks(encode_blocks(spread(split_blocks(objs, block_size)), level, entropy), entropy)
    empty = objs.filter(F.octet_length("payload") == 0).select("object_id", "payload")
    return assembled(decoded).filter(F.col("status") == OK).select("object_id", "payload").unionByName(empty)


def _tokens(entropy: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, streams in enumerate(zip(*(batch.column(c).to_pylist() for c in STREAMS), strict=True)):
                _, off, length, cmd = unpack_streams(streams) if entropy else streams
                for seq, t in enumerate(tokens.tokens(off, length, cmd)):
                    at.append(i)
                    rows.append((seq, *t))
            index = pa.array(at, pa.int64())
            seq, kind, n, distance, slot = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("object_id").take(index), batch.column("block_id").take(index), pa.array(seq, pa.int64()), pa.array(kind, pa.string()), pa.array(n, pa.int64()), pa.array(distance, pa.int64()), pa.array(slot, pa.int32())],
                names=["object_id", "block_id", "seq", "kind", "length", "distance", "slot"],
            )

    return run


def token_rows(encoded: DataFrame, entropy: bool = True) -> DataFrame:
    """(object_id, block_id, seq, kind, length, distance, slot): the tokens of each block, for statistics."""
    kind = encoded.schema["object_id"].dataType.simpleString()
    return encoded.filter(F.col("status") == OK).select("object_id", "block_id", *STREAMS).mapInArrow(_tokens(entropy), f"object_id {kind}, block_id long, seq long, kind string, length long, distance long, slot int")


def stream_sizes(encoded: DataFrame) -> DataFrame:
    """(object_id, block_id, raw_size, <stream>_sz ...)."""
    return encoded.select("object_id", "block_id", "raw_size", *(F.octet_length(s).cast("long").alias(f"{s}_sz") for s in STREAMS))


def compression_metrics(encoded: DataFrame) -> DataFrame:
    """One row: n_blocks, raw_bytes, <stream>_bytes, ratio (raw / streams), bpb (bits of streams a raw byte)."""
    sums = stream_sizes(encoded).agg(F.count("*").alias("n_blocks"), F.sum("raw_size").alias("raw_bytes"), *(F.sum(f"{s}_sz").alias(f"{s}_bytes") for s in STREAMS))
    packed = sum((F.col(f"{s}_bytes") for s in STREAMS), F.lit(0))
    return sums.withColumns({"ratio": F.col("raw_bytes") / packed, "bpb": 8 * packed / F.col("raw_bytes")})
