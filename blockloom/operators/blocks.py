"""Objects to blocks and back: splitting, batches, ranges, the offset index. All but the joining is SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SIZE = 1 << 20
STREAMS = ("lit", "off", "len", "cmd")


def objects(table: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(object_id, payload BINARY); text is taken as UTF-8."""
    return table.select(F.col(id_col).alias("object_id"), F.col(payload_col).cast("binary").alias("payload"))


def split_blocks(objs: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(object_id, block_id, raw_size, payload): block i holds bytes [i*B, min((i+1)*B, n)).

    Null and empty objects have no blocks.
    """
    if block_size < 1:
        raise ValueError("block_size must be positive")
    n = F.octet_length("payload")
    last = F.floor((n - 1) / block_size).cast("long")
    ids = F.when(n > 0, F.sequence(F.lit(0).cast("long"), last))
    found = objs.select("object_id", "payload", F.explode(ids).alias("block_id"))
    piece = F.substring(F.col("payload"), (F.col("block_id") * block_size + 1).cast("int"), F.lit(block_size))
    return found.select("object_id", "block_id", piece.alias("payload")).select("object_id", "block_id", F.octet_length("payload").cast("long").alias("raw_size"), "payload")


def spread(blocks: DataFrame) -> DataFrame:
    """The blocks dealt over all tasks; for few or large objects, where the scan alone gives too few tasks."""
    return blocks.repartition("object_id", "block_id")


def split_chunks(objs: DataFrame, chunk: int = 4 << 20, history: int = 1 << 20) -> DataFrame:
    """Blocks of ``chunk`` bytes with history_size: how many bytes before a chunk a window would still hold.

    Matches never reach into the history, so chunks are as independent as blocks.
    """
    return split_blocks(objs, chunk).withColumn("history_size", F.least(F.lit(history).cast("long"), F.col("block_id") * chunk))


def encode_batches(blocks: DataFrame, threads: int) -> DataFrame:
    """(object_id, batch_id, n_blocks, raw_bytes): batches of 2*threads blocks, 16 if threads is 0 or less."""
    size = 2 * threads if threads > 0 else 16
    return blocks.groupBy("object_id", F.floor(F.col("block_id") / size).alias("batch_id")).agg(F.count("*").alias("n_blocks"), F.sum("raw_size").alias("raw_bytes"))


def decode_ranges(blocks: DataFrame, threads: int = 8) -> DataFrame:
    """(object_id, worker, first_block, last_block, n_blocks): ceil(n / min(threads, n)) blocks a worker."""
    threads = threads if threads > 0 else 8
    per_object = blocks.groupBy("object_id").agg((F.max("block_id") + 1).alias("n"))
    per = F.ceil(F.col("n") / F.least(F.lit(threads), F.col("n")))
    each = per_object.select("object_id", "n", per.alias("per")).select("object_id", "n", "per", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("per")))).alias("worker"))
    first = F.col("worker") * F.col("per")
    last = F.least(first + F.col("per"), F.col("n")) - 1
    return each.select("object_id", "worker", first.alias("first_block"), last.alias("last_block"), (last - first + 1).alias("n_blocks"))


def offset_index(sizes: DataFrame, streams: tuple[str, ...] = STREAMS) -> DataFrame:
    """(object_id, block_id, <stream>_off, <stream>_sz ...): exclusive running sums of the block sizes of each stream."""
    before = Window.partitionBy("object_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    columns = [c for s in streams for c in (F.coalesce(F.sum(f"{s}_sz").over(before), F.lit(0)).alias(f"{s}_off"), F.col(f"{s}_sz"))]
    return sizes.select("object_id", "block_id", *columns)


def slice_by_index(streams: DataFrame, index: DataFrame, stream: str = "lit") -> DataFrame:
    """(object_id, block_id, payload): the block's part of its object's concatenated ``payload``."""
    both = index.select("object_id", "block_id", f"{stream}_off", f"{stream}_sz").join(streams, "object_id")
    return both.select("object_id", "block_id", F.substring(F.col("payload"), (F.col(f"{stream}_off") + 1).cast("int"), F.col(f"{stream}_sz").cast("int")).alias("payload"))


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        joined = [b"".join(parts) for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("object_id"), pa.array(joined, pa.binary())], names=["object_id", "payload"])


def concat_blocks(blocks: DataFrame) -> DataFrame:
    """(object_id, payload): blocks joined in order. An object has to fit a row, so its blocks are few."""
    kind = blocks.schema["object_id"].dataType.simpleString()
    gathered = blocks.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("block_id", "payload"))).alias("b")).select("object_id", F.col("b.payload").alias("parts"))
    return gathered.mapInArrow(_join, f"object_id {kind}, payload binary")
