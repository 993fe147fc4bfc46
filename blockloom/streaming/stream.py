"""Encoding and decoding of streams. Blocks are independent, so no state is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from blockloom.operators.blocks import split_blocks
from blockloom.operators.codec import decode_blocks, encode_blocks

CHUNK = 4 << 20


def encode_stream(objs: DataFrame, chunk: int = CHUNK, level: int = 2, entropy: bool = True) -> DataFrame:
    """Encoded chunk rows of a streaming (object_id, payload); append mode."""
    return encode_blocks(split_blocks(objs, chunk), level, entropy)


def decode_stream(encoded: DataFrame, entropy: bool = True) -> DataFrame:
    """Decoded chunk rows of a streaming frame of encoded ones."""
    return decode_blocks(encoded, entropy)


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now to Parquet at ``path``, exactly once, and ends."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
