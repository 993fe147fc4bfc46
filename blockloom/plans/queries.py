"""The codec's operators as queries over the driver's tables, each with the SQL it must equal.

Blocks hold 4096 bytes here, so that many objects have several. Queries whose figures depend on the parse (sizes,
ratios, containers written) have no SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import columns as cols
from blockloom.functions import container, entropy, tokens
from blockloom.functions.api import compress_column, decompress_column
from blockloom.operators import blocks as B
from blockloom.operators import codec
from blockloom.operators.shared import shared_dir
from blockloom.sources.container import ContainerSource, from_containers, read_files, to_containers
from blockloom.sources.ranges import RangeSource
from blockloom.streaming.stream import decode_stream, encode_stream, write_stream

BLOCK = 4096
CHUNK, HISTORY = 16_384, 4096

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, and its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.objects(table(spark, sf_dir, "documents"), "doc_id", "text")


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects over all tasks, for kernels that take whole objects."""
    return texts(spark, sf_dir).repartition("object_id")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.split_blocks(texts(spark, sf_dir), BLOCK)


def encoded(spark: SparkSession, sf_dir: str, entropy: bool = True) -> DataFrame:
    return codec.encode_blocks(B.spread(split(spark, sf_dir)), entropy=entropy)


def named(frame: DataFrame, *columns: str | Column) -> DataFrame:
    return frame.select(F.col("object_id").alias("doc_id"), *columns)


def sha(payload: str = "payload") -> Column:
    return F.sha2(F.col(payload), 256).alias("sha256")


D = "(SELECT doc_id, encode(text) AS x, octet_length(encode(text)) AS n FROM documents)"
#: Block rows: doc_id, b, raw (its bytes), n_blocks.
BLOCKS = f"(SELECT doc_id, n, (n + {BLOCK - 1}) // {BLOCK} AS n_blocks, b, array_slice(x, b * {BLOCK} + 1, (b + 1) * {BLOCK}) AS raw FROM (SELECT *, unnest(range(0, (n + {BLOCK - 1}) // {BLOCK})) AS b FROM {D}))"
WHOLE = f"SELECT doc_id, n::BIGINT AS n_bytes, sha256(x) AS sha256 FROM {D}"


# Sources and partitioning


@query("""SELECT 'documents' AS source, doc_id AS id, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS sha256 FROM documents
UNION ALL SELECT 'pages', page_id, octet_length(encode(html))::BIGINT, sha256(html) FROM pages
UNION ALL SELECT 'conversations', conv_id * 1000 + turn, octet_length(encode(text))::BIGINT, sha256(text) FROM conversations
UNION ALL SELECT 'benchmark', item_id, octet_length(encode(text))::BIGINT, sha256(text) FROM benchmark
UNION ALL SELECT 'events', event_id, octet_length(encode(props))::BIGINT, sha256(props) FROM events""")
def scan_bytes(spark, sf_dir):
    parts = []
    for name, key, text in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id * 1000 + turn", "text"), ("benchmark", "item_id", "text"), ("events", "event_id", "props")):
        source = table(spark, sf_dir, name).select(F.expr(key).alias("id"), F.col(text).alias("text"))
        parts.append(B.objects(source, "id", "text").select(F.lit(name).alias("source"), F.col("object_id").alias("id"), F.octet_length("payload").cast("long").alias("n_bytes"), sha()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"SELECT doc_id, b AS block_id, octet_length(raw)::BIGINT AS raw_size, sha256(raw) AS sha256 FROM {BLOCKS}")
def block_split(spark, sf_dir):
    return named(split(spark, sf_dir), "block_id", "raw_size", sha())


@query(f"SELECT doc_id, ((n + {BLOCK - 1}) // {BLOCK})::BIGINT AS n_blocks FROM {D} WHERE n > 0")
def block_count(spark, sf_dir):
    return named(split(spark, sf_dir).groupBy("object_id").agg(F.count("*").alias("n_blocks")), "n_blocks")


@query(f"""SELECT page_id, b AS block_id, least({CHUNK}, n - b * {CHUNK})::BIGINT AS raw_size, least({HISTORY}, b * {CHUNK})::BIGINT AS history_size,
sha256(array_slice(x, b * {CHUNK} + 1, (b + 1) * {CHUNK})) AS sha256
FROM (SELECT *, unnest(range(0, (n + {CHUNK - 1}) // {CHUNK})) AS b FROM (SELECT page_id, encode(html) AS x, octet_length(encode(html)) AS n FROM pages))""")
def chunk_split(spark, sf_dir):
    pages = B.objects(table(spark, sf_dir, "pages"), "page_id", "html")
    return B.split_chunks(pages, CHUNK, HISTORY).select(F.col("object_id").alias("page_id"), "block_id", "raw_size", "history_size", sha())


@query(f"SELECT doc_id, (b // 6)::BIGINT AS batch_id, count(*)::BIGINT AS n_blocks, sum(octet_length(raw))::BIGINT AS raw_bytes FROM {BLOCKS} GROUP BY 1, 2")
def encode_batches(spark, sf_dir):
    return named(B.encode_batches(split(spark, sf_dir), 3), "batch_id", "n_blocks", "raw_bytes")


@query(f"""SELECT doc_id, (b // per)::BIGINT AS worker, min(b)::BIGINT AS first_block, max(b)::BIGINT AS last_block, count(*)::BIGINT AS n_blocks
FROM (SELECT *, (n_blocks + least(3, n_blocks) - 1) // least(3, n_blocks) AS per FROM {BLOCKS}) GROUP BY 1, 2""")
def decode_ranges(spark, sf_dir):
    return named(B.decode_ranges(split(spark, sf_dir), 3), "worker", "first_block", "last_block", "n_blocks")


@query(f"""SELECT doc_id, b AS block_id, coalesce(sum(s) OVER w, 0)::BIGINT AS lit_off, s::BIGINT AS lit_sz, coalesce(sum(s // 3) OVER w, 0)::BIGINT AS off_off, (s // 3)::BIGINT AS off_sz,
coalesce(sum(s % 7) OVER w, 0)::BIGINT AS len_off, (s % 7)::BIGINT AS len_sz, coalesce(sum(s // 128 + 1) OVER w, 0)::BIGINT AS cmd_off, (s // 128 + 1)::BIGINT AS cmd_sz
FROM (SELECT doc_id, b, octet_length(raw) AS s FROM {BLOCKS}) WINDOW w AS (PARTITION BY doc_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def offset_index(spark, sf_dir):
    """The index over stream sizes that SQL can follow: made up from the raw size; :func:`stream_slices` has real ones."""
    n = F.col("raw_size")
    sizes = split(spark, sf_dir).select("object_id", "block_id", n.alias("lit_sz"), F.floor(n / 3).alias("off_sz"), (n % 7).alias("len_sz"), (F.floor(n / 128) + 1).alias("cmd_sz"))
    index = B.offset_index(sizes)
    return named(index, *(c for c in index.columns if c != "object_id"))


@query(f"SELECT doc_id, b AS block_id, sha256(raw) AS sha256 FROM {BLOCKS}")
def index_slice(spark, sf_dir):
    index = B.offset_index(split(spark, sf_dir).select("object_id", "block_id", F.col("raw_size").alias("lit_sz")), ("lit",))
    return named(B.slice_by_index(texts(spark, sf_dir), index), "block_id", sha())


@query(WHOLE + " WHERE n > 0")
def stream_concat(spark, sf_dir):
    return named(B.concat_blocks(split(spark, sf_dir)), F.octet_length("payload").cast("long").alias("n_bytes"), sha())


def _stored(spark, frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written to the shared folder and read again."""
    path = _folder(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query(f"SELECT doc_id, b AS block_id, sha256(raw) AS sha256 FROM {BLOCKS} WHERE b = 1")
def random_access(spark, sf_dir):
    """One block of each object, of stored blocks: the filter reaches the scan, and only those blocks are decoded."""
    blocks = codec.encode_blocks(split(spark, sf_dir).repartitionByRange("block_id", "object_id").sortWithinPartitions("block_id", "object_id"))
    stored = _stored(spark, blocks, "blocks")
    return named(codec.decode_blocks(stored.filter("block_id = 1")).filter("status = 'OK'"), "block_id", sha())


@query(f"SELECT doc_id, b AS block_id, octet_length(raw)::BIGINT AS raw_size, sha256(raw) AS sha256 FROM {BLOCKS}")
def stream_slices(spark, sf_dir):
    """Streams joined for each object, cut by the index of their real sizes, and decoded block by block."""
    plain = _stored(spark, encoded(spark, sf_dir, entropy=False), "streams")
    index = B.offset_index(codec.stream_sizes(plain))
    cut = plain.select("object_id", "block_id", "raw_size", "xxh3")
    for s in B.STREAMS:
        whole = B.concat_blocks(plain.select("object_id", "block_id", F.col(s).alias("payload")))
        cut = cut.join(B.slice_by_index(whole, index, s).withColumnRenamed("payload", s), ["object_id", "block_id"])
    return named(codec.decode_blocks(cut, entropy=False).filter("status = 'OK'"), "block_id", "raw_size", sha())


@query(f"SELECT doc_id, (n * 8192)::BIGINT AS size, (CASE WHEN n * 8192 < 16777216 THEN 13 WHEN n * 8192 < 134217728 THEN 15 ELSE 17 END)::INT AS hash_log FROM {D}")
def hash_log(spark, sf_dir):
    sized = texts(spark, sf_dir).select("object_id", (F.octet_length("payload").cast("long") * 8192).alias("size"))
    return named(sized, "size", cols.table_log(F.col("size")).cast("int").alias("hash_log"))


@query("SELECT range AS level, (CASE WHEN range BETWEEN 1 AND 1 THEN 4 ELSE 32 END)::INT AS effort FROM range(-3, 10)")
def level_effort(spark, sf_dir):
    return spark.range(-3, 10).select(F.col("id").alias("level"), cols.effort(F.col("id")).cast("int").alias("effort"))


# Scalars of the parse


@query(f"""SELECT doc_id, u AS u32, (((u::HUGEINT * 2654435761) % 4294967296)::BIGINT >> 10) & 8191 AS hash4 FROM (SELECT doc_id,
('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT AS u FROM (SELECT doc_id, hex(array_slice(x, 1, 4)) AS h FROM {D} WHERE n >= 4))""")
def hash4(spark, sf_dir):
    found = texts(spark, sf_dir).filter(F.octet_length("payload") >= 4).select("object_id", cols.u32(F.col("payload")).alias("u32"))
    return named(found, "u32", cols.hash4(F.col("u32"), 13).alias("hash4"))


@query("""SELECT d AS distance, (CASE WHEN d < 128 THEN 6 WHEN d < 16384 THEN 8 WHEN d < 2097152 THEN 10 ELSE 12 END)::INT AS min_length, count(*)::BIGINT AS n
FROM (SELECT unnest([l_partkey + 1, (l_partkey + 1) * 100, (l_partkey + 1) * 5000]) AS d FROM lineitem) GROUP BY d""")
def min_match_len(spark, sf_dir):
    p = F.col("l_partkey") + 1
    far = table(spark, sf_dir, "lineitem").select(F.explode(F.array(p, p * 100, p * 5000)).alias("distance"))
    return far.groupBy("distance", cols.min_match_length(F.col("distance")).cast("int").alias("min_length")).agg(F.count("*").alias("n"))


V = "(SELECT DISTINCT (l_orderkey * (l_partkey + 1)) % 4294967296 AS v FROM lineitem)"
VLEN = "CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END"


def _values(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * (F.col("l_partkey") + 1)) % 4294967296).alias("v")).distinct()


@query(f"SELECT v, ({VLEN})::INT AS n FROM {V}")
def varint_len(spark, sf_dir):
    return _values(spark, sf_dir).select("v", cols.varint_length(F.col("v")).cast("int").alias("n"))


@query(f"""SELECT v, left(lower(printf('%02x', (v & 127) | 128) || printf('%02x', ((v >> 7) & 127) | 128) || printf('%02x', ((v >> 14) & 127) | 128) || printf('%02x', ((v >> 21) & 127) | 128)), 2 * (n - 1))
|| printf('%02x', (v >> (7 * (n - 1))) & 127) AS leb128 FROM (SELECT v, {VLEN} AS n FROM {V})""")
def varint_encode(spark, sf_dir):
    return _values(spark, sf_dir).select("v", F.lower(F.hex(cols.varint_encode(F.col("v")))).alias("leb128"))


def _read_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [tokens.read_varint(x, 0) for x in batch.column("leb128").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int32())], names=["v", "n"])


@query(f"SELECT v, ({VLEN})::INT AS n FROM {V}")
def varint_decode(spark, sf_dir):
    return _values(spark, sf_dir).select(cols.varint_encode(F.col("v")).alias("leb128")).mapInArrow(_read_numbers, "v long, n int")


def _literal_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, sizes = [], []
        for payload in batch.column("payload").to_pylist():
            w = tokens.TokenWriter()
            w.literals(payload)
            counts.append(len(w.cmd) - 1)
            sizes.append(len(tokens.decode(len(payload), *w.streams())))
        yield pa.RecordBatch.from_arrays([batch.column("object_id"), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "n_commands", "n_bytes"])


@query(f"SELECT doc_id, ((n + 127) // 128)::BIGINT AS n_commands, n::BIGINT AS n_bytes FROM {D}")
def literal_cmd_count(spark, sf_dir):
    """Every object as literals alone."""
    return texts(spark, sf_dir).mapInArrow(_literal_runs, "doc_id long, n_commands long, n_bytes long")


def _expand_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id in batch.column("doc_id").to_pylist():
            w, pattern, more = tokens.TokenWriter(), f"x{doc_id}".encode(), 6 + doc_id % 1000
            w.literals(pattern)
            w.match(more, len(pattern))
            out.append(tokens.decode(len(pattern) + more, *w.streams()).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "expanded"])


@query("SELECT doc_id, left(repeat('x' || doc_id, 600), (length('x' || doc_id) + 6 + doc_id % 1000)::INT) AS expanded FROM documents")
def run_expand(spark, sf_dir):
    """A pattern and one match that overlaps itself."""
    return table(spark, sf_dir, "documents").select("doc_id").mapInArrow(_expand_runs, "doc_id long, expanded string")


# Blocks through the codec


@query(f"SELECT doc_id, 'OK' AS status, ((n + {BLOCK - 1}) // {BLOCK})::BIGINT AS n_blocks FROM {D} WHERE n > 0")
def encode_status(spark, sf_dir):
    return named(encoded(spark, sf_dir).groupBy("object_id", "status").agg(F.count("*").alias("n_blocks")), "status", "n_blocks")


@query(f"SELECT doc_id, b AS block_id, 1::BIGINT AS n_markers FROM {BLOCKS}")
def block_markers(spark, sf_dir):
    rows = codec.token_rows(encoded(spark, sf_dir, entropy=False), entropy=False)
    return named(rows.groupBy("object_id", "block_id").agg(F.count_if(F.col("kind") == "marker").alias("n_markers")), "block_id", "n_markers")


@query(f"SELECT doc_id, b AS block_id, octet_length(raw)::BIGINT AS covered FROM {BLOCKS}")
def size_conservation(spark, sf_dir):
    """Literals and matches of a block add up to its size."""
    rows = codec.token_rows(encoded(spark, sf_dir, entropy=False), entropy=False)
    return named(rows.groupBy("object_id", "block_id").agg(F.sum("length").alias("covered")), "block_id", "covered")


@query(WHOLE)
def roundtrip_sha256(spark, sf_dir):
    done = codec.roundtrip(texts(spark, sf_dir), BLOCK)
    return named(done, F.octet_length("payload").cast("long").alias("n_bytes"), sha())


@query("SELECT conv_id, turn, text FROM conversations")
def roundtrip_text(spark, sf_dir):
    source = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    keyed = B.objects(source.select(F.to_json("id").alias("id"), "text"), "id", "text")
    done = codec.roundtrip(keyed, BLOCK, level=1)
    key = F.from_json("object_id", "conv_id long, turn long")
    return done.select(key.alias("k"), F.col("payload").cast("string").alias("text")).select("k.conv_id", "k.turn", "text")


def _entropy_both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lit, other = [], []
        for payload in batch.column("payload").to_pylist():
            lit.append(entropy.unpack_literals(entropy.pack_literals(payload)))
            other.append(entropy.unpack_chunks(entropy.pack_chunks(payload)))
        yield pa.RecordBatch.from_arrays([batch.column("object_id"), pa.array(lit, pa.binary()), pa.array(other, pa.binary())], names=["object_id", "lit", "other"])


@query(f"SELECT doc_id, sha256(x) AS lit_sha256, sha256(x) AS other_sha256 FROM {D}")
def entropy_roundtrip(spark, sf_dir):
    done = dealt(spark, sf_dir).mapInArrow(_entropy_both_ways, "object_id long, lit binary, other binary")
    return named(done, F.sha2("lit", 256).alias("lit_sha256"), F.sha2("other", 256).alias("other_sha256"))


def _fail(data: bytes, level: int) -> bytes:
    raise RuntimeError("no compression today")


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [entropy.pack_chunks(p, _fail) for p in batch.column("payload").to_pylist()]
        same = [entropy.unpack_chunks(b) == p for b, p in zip(blobs, batch.column("payload").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("object_id"), pa.array([len(b) for b in blobs], pa.int64()), pa.array(same)], names=["doc_id", "n_stored", "same"])


@query(f"SELECT doc_id, (n + 8 + 8 * ((n + 524287) // 524288))::BIGINT AS n_stored, true AS same FROM {D}")
def raw_fallback(spark, sf_dir):
    """Chunks whose compression fails are stored raw."""
    return texts(spark, sf_dir).mapInArrow(_raw, "doc_id long, n_stored long, same boolean")


# Checksums and validation


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256(spark, sf_dir):
    return named(texts(spark, sf_dir), sha())


def _xxh3(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("object_id"), pa.array([codec.checksum(p).hex() for p in batch.column("payload").to_pylist()], pa.string())], names=["doc_id", "xxh3"])


@query()
def xxh3(spark, sf_dir):
    """XXH3-64, seed 0; DuckDB lacks it, unit tests pin it."""
    return texts(spark, sf_dir).mapInArrow(_xxh3, "doc_id long, xxh3 string")


@query(f"SELECT doc_id, b AS block_id, 'OK' AS status, sha256(raw) AS sha256 FROM {BLOCKS}")
def verify_ok(spark, sf_dir):
    return named(codec.decode_blocks(encoded(spark, sf_dir)), "block_id", "status", sha())


def _flip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Damages one byte in a stream of the blocks of odd objects."""
    for batch in batches:
        ids, lits = batch.column("object_id").to_pylist(), batch.column("lit").to_pylist()
        at = batch.schema.get_field_index("lit")
        hurt = [bytes([x[0] ^ 1]) + x[1:] if i % 2 and x else x for i, x in zip(ids, lits, strict=True)]
        yield batch.set_column(at, "lit", pa.array(hurt, pa.binary()))


@query(f"SELECT doc_id, doc_id % 2 = 1 AS quarantined, CASE WHEN doc_id % 2 = 0 THEN sha256(x) END AS sha256 FROM {D} WHERE n > 0")
def corruption_detect(spark, sf_dir):
    plain = encoded(spark, sf_dir, entropy=False)
    decoded = codec.decode_blocks(plain.mapInArrow(_flip, plain.schema), entropy=False)
    whole = codec.assembled(decoded)
    return named(whole, (F.col("status") != codec.OK).alias("quarantined"), sha())


def _damaged(frame: DataFrame, at: int, every: int) -> DataFrame:
    """Containers with a zero at byte ``at`` (from 1), for ids divisible by ``every``."""
    c = F.col("container")
    hurt = F.concat(F.substring(c, 1, at - 1), F.unhex(F.lit("00")), F.substring(c, at + 1, 2**31 - 1 - at))
    return frame.select("object_id", F.when(F.col("object_id") % every == 0, hurt).otherwise(c).alias("container"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'BAD_DATA' ELSE 'OK' END AS status, (CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n END)::BIGINT AS orig_size FROM {D}")
def bad_magic(spark, sf_dir):
    return named(from_containers(_damaged(to_containers(dealt(spark, sf_dir), "indexed", BLOCK), 1, 3)), "status", "orig_size")


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND n > 0 THEN 'BAD_DATA' ELSE 'OK' END AS status, CASE WHEN doc_id % 4 <> 0 OR n = 0 THEN sha256(x) END AS sha256 FROM {D}")
def bad_chunk(spark, sf_dir):
    filled = to_containers(dealt(spark, sf_dir), "chunked", BLOCK)
    return named(from_containers(_damaged(filled, container.CHUNKED.size + 1, 4)), "status", sha())


@query(f"SELECT doc_id, n::BIGINT AS orig_size FROM {D}")
def decoded_size(spark, sf_dir):
    """Sizes from headers alone, without decoding."""
    filled = to_containers(dealt(spark, sf_dir), "interleaved", BLOCK)
    low, high = cols.u32(F.col("container"), 13), cols.u32(F.col("container"), 17)
    return named(filled, (low + high * (1 << 32)).alias("orig_size"))


@query(f"SELECT doc_id, (n + n // 8 + 1024)::BIGINT AS bound FROM {D}")
def compress_bound(spark, sf_dir):
    return named(texts(spark, sf_dir), cols.compress_bound(F.octet_length("payload")).alias("bound"))


@query(f"SELECT doc_id, (CASE WHEN doc_id % 7 = 0 THEN -2 WHEN n + n // 8 + 1024 > 3000 THEN -1 ELSE 0 END)::INT AS status FROM {D}")
def capacity_status(spark, sf_dir):
    size = F.when(F.col("object_id") % 7 != 0, F.octet_length("payload"))
    return named(texts(spark, sf_dir), cols.capacity_status(size, F.lit(3000)).cast("int").alias("status"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'NULL' ELSE 'OK' END AS status FROM documents")
def null_input(spark, sf_dir):
    some = texts(spark, sf_dir).select("object_id", F.lit(0).cast("long").alias("block_id"), F.when(F.col("object_id") % 5 != 0, F.col("payload")).alias("payload"))
    rows = some.select("object_id", "block_id", F.octet_length("payload").cast("long").alias("raw_size"), "payload")
    return named(codec.decode_blocks(codec.encode_blocks(rows)), "status")


# Containers


def _container_query(layout: str):
    def run(spark, sf_dir):
        done = from_containers(to_containers(dealt(spark, sf_dir), layout, BLOCK))
        return named(done, "layout", "status", F.col("orig_size").alias("n_bytes"), sha())

    return run


for _layout, _key in (("indexed", "container_v2_read"), ("chunked", "container_v3_read"), ("interleaved", "container_interleaved_read")):
    QUERIES[_key] = _container_query(_layout)
    ORACLES[_key] = f"SELECT doc_id, '{_layout}' AS layout, 'OK' AS status, n::BIGINT AS n_bytes, sha256(x) AS sha256 FROM {D}"


def _written(spark, sf_dir, layout: str) -> DataFrame:
    return named(to_containers(dealt(spark, sf_dir), layout, BLOCK), F.octet_length("container").cast("long").alias("n_stored"), F.lower(F.hex(F.substring("container", 1, 8))).alias("magic"))


@query()
def container_v2_write(spark, sf_dir):
    return _written(spark, sf_dir, "indexed")


@query()
def container_v3_write(spark, sf_dir):
    return _written(spark, sf_dir, "chunked")


@query()
def container_interleaved_write(spark, sf_dir):
    return _written(spark, sf_dir, "interleaved")


ITEMS = "(SELECT item_id, encode(text) AS x, octet_length(encode(text)) AS n FROM benchmark)"


def _files(spark, sf_dir, layout: str) -> str:
    """A file for each text of ``benchmark``, written by the data source; the folder that holds them."""
    spark.dataSource.register(ContainerSource)
    folder = _folder(spark, "files")
    items = B.objects(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("object_id", F.col("object_id").cast("string"))
    items.write.format("blockloom").option("layout", layout).option("block_size", SMALL).mode("append").save(folder)
    return folder


#: Bytes of a block where objects are short.
SMALL = 64


def _item() -> Column:
    """The id in a file's name."""
    return F.regexp_extract("object_id", "([0-9]+)$", 1).cast("long").alias("item_id")


def _file_query(layout: str):
    def run(spark, sf_dir):
        """Files written and read through the data source, a few blocks a partition."""
        rows = spark.read.format("blockloom").option("blocks_per_partition", 3).load(_files(spark, sf_dir, layout))
        return rows.select(_item(), "block_id", "raw_size", "status", sha())

    return run


for _layout in ("indexed", "chunked", "interleaved"):
    QUERIES[f"container_file_{_layout}"] = _file_query(_layout)
    ORACLES[f"container_file_{_layout}"] = f"SELECT item_id, b AS block_id, least({SMALL}, n - b * {SMALL})::BIGINT AS raw_size, 'OK' AS status, sha256(array_slice(x, b * {SMALL} + 1, (b + 1) * {SMALL})) AS sha256 FROM (SELECT *, unnest(range(0, (n + {SMALL - 1}) // {SMALL})) AS b FROM {ITEMS})"


@query(f"SELECT item_id, b AS block_id, least({SMALL}, n - b * {SMALL})::BIGINT AS raw_size, sha256(array_slice(x, b * {SMALL} + 1, (b + 1) * {SMALL})) AS sha256 FROM (SELECT *, unnest(range(0, (n + {SMALL - 1}) // {SMALL})) AS b FROM {ITEMS})")
def raw_files(spark, sf_dir):
    """Bytes written by the raw sink and read by byte ranges."""
    spark.dataSource.register(RangeSource)
    rows = spark.read.format("blockloom_bytes").option("block_size", SMALL).option("blocks_per_partition", 3).load(_files(spark, sf_dir, "raw"))
    return rows.select(_item(), "block_id", "raw_size", sha())


@query(f"SELECT item_id, 'chunked' AS layout, 'OK' AS status, n::BIGINT AS n_bytes, sha256(x) AS sha256 FROM {ITEMS}")
def whole_files(spark, sf_dir):
    """Container files through Spark's own reader, verified as a whole."""
    found = from_containers(read_files(spark, _files(spark, sf_dir, "chunked")))
    return found.select(_item(), "layout", "status", F.col("orig_size").alias("n_bytes"), sha())


@query("SELECT item_id, text FROM benchmark")
def column_functions(spark, sf_dir):
    """Compression and back as functions of a column."""
    packed = table(spark, sf_dir, "benchmark").select("item_id", compress_column(F.col("text").cast("binary"), block_size=BLOCK).alias("packed"))
    return packed.select("item_id", decompress_column(F.col("packed")).cast("string").alias("text"))


# Metrics and streams


@query()
def ratio(spark, sf_dir):
    return codec.compression_metrics(encoded(spark, sf_dir)).select("n_blocks", "raw_bytes", "ratio")


@query()
def bpb(spark, sf_dir):
    return codec.compression_metrics(encoded(spark, sf_dir)).select("raw_bytes", "bpb")


@query()
def stream_totals(spark, sf_dir):
    return codec.compression_metrics(encoded(spark, sf_dir)).select("raw_bytes", *(f"{s}_bytes" for s in B.STREAMS))


@query(f"SELECT doc_id, b AS block_id, 'OK' AS status, octet_length(raw)::BIGINT AS raw_size, sha256(raw) AS sha256 FROM {BLOCKS}")
def stream_encode(spark, sf_dir):
    """Documents as a stream of files, encoded and decoded in micro-batches, written once."""
    source = table(spark, sf_dir, "documents")
    base = _folder(spark, "stream")
    arriving = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/documents.parquet*")
    rows = decode_stream(encode_stream(B.objects(arriving, "doc_id", "text"), BLOCK))
    write_stream(named(rows, "block_id", "status", "raw_size", sha()), f"{base}/rows", f"{base}/state").awaitTermination()
    return spark.read.schema("doc_id long, block_id long, status string, raw_size long, sha256 string").parquet(f"{base}/rows")
