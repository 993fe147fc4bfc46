"""Whole objects at once: plain functions on bytes, and the same as column functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from blockloom.functions import container, parse
from blockloom.functions.tokens import BadData

WRITERS = {"indexed": container.write_indexed, "interleaved": container.write_interleaved, "chunked": container.write_chunked}


def compress(data: bytes, level: int = 2, block_size: int = 1 << 20, layout: str = "indexed") -> bytes:
    """A container of ``data``."""
    if block_size < 1:
        raise ValueError("block_size must be positive")
    return WRITERS[layout](data, block_size, [parse.encode(data[a : a + block_size], level) for a in range(0, len(data), block_size)])


def decompress(data: bytes, max_size: int | None = None) -> bytes:
    """The object of a container, verified. Raises ``BadData`` if it is damaged or larger than ``max_size``."""
    if max_size is not None and container.manifest(data).orig_size > max_size:
        raise BadData(f"the object is larger than {max_size} bytes")
    return container.read_object(data)


def compress_column(payload: Column, level: int = 2, block_size: int = 1 << 20, layout: str = "indexed") -> Column:
    """:func:`compress` of a BINARY column; null stays null."""

    @F.arrow_udf("binary")
    def run(data: pa.Array) -> pa.Array:
        return pa.array([None if x is None else compress(x, level, block_size, layout) for x in data.to_pylist()], pa.binary())

    return run(payload)


def decompress_column(packed: Column) -> Column:
    """:func:`decompress` of a BINARY column; null where the container is null or damaged."""

    @F.arrow_udf("binary")
    def run(data: pa.Array) -> pa.Array:
        out = []
        for x in data.to_pylist():
            try:
                out.append(None if x is None else decompress(x))
            except BadData:
                out.append(None)
        return pa.array(out, pa.binary())

    return run(packed)
