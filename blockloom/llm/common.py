"""What the operators share: input columns, the shared folder, materialised tables."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.shared import shared_dir

#: `[\x20\x09-\x0D]`, the white space of every contract here.
WHITE = b" \t\n\x0b\x0c\r"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Cuts the lineage; the files outlive any executor. Read it as often as needed, then :func:`drop` it.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for kept in _SCOPES:
        kept.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._blockloom_path = path
    return table


#: Paths written inside each open :func:`scratch`.
_SCOPES: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of :func:`materialize` that nothing reads any more; what was made from them must be written already."""
    for table in tables:
        _delete(table.sparkSession, table._blockloom_path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the tables that :func:`materialize` wrote inside, but for those whose path is taken off the list."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            _delete(spark, path)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) alone: other columns, whatever their names, go no further."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def row_key() -> Column:
    """Names a document beside its doc_id, which may be null or repeated: hash of id and text.

    Repeated rows (same id, same text) get the same key and so the same results.
    """
    return F.xxhash64(F.col("doc_id"), F.col("text"))


#: Rows, and bytes of strings, of a table that may still be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20


def broadcast_if_small(table: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``table`` with a broadcast hint if it has at most ``most`` rows and ``most_bytes`` of strings, else as it is (a shuffled join)."""
    texts = [f.name for f in table.schema.fields if f.dataType.typeName() in ("string", "binary")]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(0).cast("long"))
    rows, n_bytes = table.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(table) if rows <= most and n_bytes <= most_bytes else table


#: A key is hot if it holds more than 1/HOT_PARTS of all rows (and HOT_LEAST rows); so there are fewer than HOT_PARTS of them.
HOT_PARTS, HOT_LEAST = 1000, 500


def hot_keys(counts: DataFrame, on: list[str], total: int, parts: int = HOT_PARTS) -> DataFrame | None:
    """(``on``, salts) of the keys of ``counts`` (``on``, n) that hold over 1/``parts`` of ``total`` rows; None if there are none.

    All salts together are fewer than twice ``parts``, so the table may be broadcast whatever the corpus.
    """
    least = max(HOT_LEAST, total // parts)
    found = [tuple(r) for r in counts.filter(F.col("n") > least).select(*on, F.ceil(F.col("n") / least).cast("int")).collect()]
    kinds = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in on)
    return counts.sparkSession.createDataFrame(found, f"{kinds}, salts int") if found else None


def join_split(rows: DataFrame, table: DataFrame, on: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key; the rows of each hot key go to several tasks.

    A hot key's row of ``table`` is repeated under each salt, and its rows in ``rows`` are dealt over the salts.
    """
    if hot is None:
        return rows.join(table, on, how)
    h = F.broadcast(hot.withColumnRenamed("salts", "_salts"))
    by = [c for c in hot.columns if c != "salts"]
    dealt = rows.join(h, by, "left").withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    each = table.join(h, by, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(each, [*on, "_salt"], how).drop("_salt")


def hot_documents(texts: DataFrame) -> DataFrame | None:
    """The hot keys of ``texts`` (doc_id, rid, ...): rows repeated so often that no task should take all their copies."""
    return hot_keys(texts.groupBy("rid").agg(F.count("*").alias("n")), ["rid"], texts.count())


def join_documents(texts: DataFrame, found: DataFrame, hot: DataFrame | None, how: str = "left") -> DataFrame:
    """``texts`` (doc_id, rid, ...) with the other columns of ``found``, which has one row a document; see :func:`hot_documents`.

    A null doc_id equals a null one.
    """
    same = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.xxhash64("doc_id"))
    theirs, ours = found.withColumn("_same", same).drop("doc_id"), texts.withColumn("_same", same)
    return join_split(ours, theirs, ["rid", "_same"], hot, how).drop("_same")


def process_cache() -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    import sys
    import types

    return sys.modules.setdefault("_blockloom_worker_cache", types.ModuleType("_blockloom_worker_cache")).__dict__


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps, which a long job would else keep."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(function: Callable, rows: int | None = None, keep: bool = False) -> Callable:
    """``function`` of Arrow batches, fed at most ``rows`` rows at a time, giving memory back when its task ends.

    Python workers outlive their tasks; what their allocators keep would count against the executor. So would what
    another operator left in :func:`process_cache`: it goes when the task starts, unless ``keep``.
    """

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        def trim() -> None:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

        cache = process_cache()
        left = [k for k in cache if isinstance(k, tuple)]
        if left and not keep:
            for k in left:
                del cache[k]
            trim()
        try:
            yield from function(sliced(batches) if rows else batches)
        finally:
            trim()

    return run
