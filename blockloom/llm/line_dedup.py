"""Line dedup: range-partitioned line hashes, secondary sort, per-document keep bitmaps.

Every line becomes (128-bit key hash, document, position). The hashes are range-partitioned
*with* the document, so a key that a third of all rows carry spreads over many ranges;
each task then streams its sorted range and holds at most ``HELD`` rows of one key. A row that is repeated
itself is one document: its copies are passed over, first where they are read, then in the stream.
A key's documents are known inside its range, except for the first and last key of each range: these name
``min_docs`` documents at most (whatever the corpus), which are counted together afterwards.

What comes back are compressed bitmaps of the lines to keep, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import WHITE, broadcast_if_small, documents, hot_documents, hot_keys, join_documents, join_split, lean, materialize, row_key

_NAMES = ["h1", "h2", "who", "rid", "doc_id", "pos", "n_lines"]
_LINES = "h1 long, h2 long, who long, rid long, doc_id long, pos int, n_lines int"
_FOUND = "kind byte, " + _LINES
_DROPPED, _PENDING, _COUNT = 0, 1, 2
#: Rows of a key that a task holds before it knows whether they go.
HELD = 50_000
#: Documents that a task remembers, to pass over their copies.
SEEN = 1 << 16


def line_keys(text: bytes) -> list[bytes]:
    """A key for each line: white space off both ends, A-Z lowered (bytes.lower is ASCII only)."""
    return [line.strip(WHITE) for line in text.lower().split(b"\n")]


def _lines(min_chars: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            digests, at, pos, sizes = [], [], [], []
            rids = batch.column("rid").to_pylist()
            for row, (rid, text) in enumerate(zip(rids, batch.column("text"), strict=True)):
                if rid in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(rid)
                keys = line_keys(text.as_py() or b"")
                for i, key in enumerate(keys):
                    if len(key) >= min_chars and (min_chars == 1 or len(key.decode()) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        at.append(row)
                        pos.append(i)
                        sizes.append(len(keys))
            if at:
                halves = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
                rows = pa.array(at, pa.int64())
                own = [batch.column(c).take(rows) for c in ("who", "rid", "doc_id")]
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), *own, pa.array(pos, pa.int32()), pa.array(sizes, pa.int32())], names=_NAMES)

    return emit


def _without_copies(batch: pa.RecordBatch, last: tuple | None) -> tuple[pa.RecordBatch, tuple | None]:
    """Sorted rows, each line of each document once; and the last of them."""
    if not batch.num_rows:
        return batch, last
    columns = [batch.column(c).to_numpy() for c in ("h1", "h2", "who", "rid", "pos")]
    same = np.ones(batch.num_rows, bool)
    for c in columns:
        same[1:] &= c[1:] == c[:-1]
    same[0] = last == tuple(int(c[0]) for c in columns)
    last = tuple(int(c[-1]) for c in columns)
    return (batch.filter(pa.array(~same)) if same.any() else batch), last


def _stream(min_docs: int):
    """Streams one sorted range. Holds the rows of the current key until it has ``min_docs`` documents."""

    def flagged(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, kind, np.int8)), *rows.columns], names=["kind", *_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the open key, while it has too few documents
        whos: list[int] = []  # documents of the open key, min_docs at most
        key, n_held, spilled, first, last = None, 0, False, True, None

        def close(boundary: bool) -> Iterator[pa.RecordBatch]:
            """The open key has ended in this range; a boundary key may go on in another."""
            if boundary or (spilled and len(whos) >= min_docs):
                n = len(whos)
                columns = [np.full(n, key[0]), np.full(n, key[1]), np.array(whos, np.int64), *([np.zeros(n, np.int64)] * 2), *([np.zeros(n, np.int32)] * 2)]
                yield flagged(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NAMES), _COUNT)
            if boundary:
                for rows in held:
                    yield flagged(rows, _PENDING)

        for batch in batches:
            batch, last = _without_copies(batch, last)
            if not batch.num_rows:
                continue
            h1, h2, who = (batch.column(c).to_numpy() for c in ("h1", "h2", "who"))
            fresh = np.ones(len(h1), bool)
            fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            starts = np.flatnonzero(fresh)
            ends = np.append(starts[1:], len(h1))
            other = fresh.copy()
            other[1:] |= who[1:] != who[:-1]
            upto = np.append(0, np.cumsum(other))
            docs = upto[ends] - upto[starts]
            # only the run at the front can go on with the open key; only the one at the back stays open
            for k in sorted({0, len(starts) - 1}):
                now = (int(h1[starts[k]]), int(h2[starts[k]]))
                if now != key:
                    if key is not None:
                        yield from close(first)
                        first = False
                    key, whos, held, n_held, spilled = now, [], [], 0, False
                if len(whos) < min_docs:
                    some = who[starts[k] : ends[k]][other[starts[k] : ends[k]]].tolist()
                    whos += [w for w in some[: min_docs + 1] if not whos or w != whos[-1]]
                    whos = whos[:min_docs]
                held.append(batch.slice(int(starts[k]), int(ends[k] - starts[k])))
                n_held += held[-1].num_rows
                if len(whos) >= min_docs or n_held > HELD:
                    # too many rows of too few documents: what becomes of them is decided after
                    spilled |= len(whos) < min_docs
                    for rows in held:
                        yield flagged(rows, _DROPPED if len(whos) >= min_docs else _PENDING)
                    held, n_held = [], 0
            take = np.repeat((docs >= min_docs) & ~np.isin(np.arange(len(docs)), (0, len(docs) - 1)), ends - starts)
            if take.any():
                yield flagged(batch.filter(pa.array(take)), _DROPPED)
        if key is not None:
            yield from close(True)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, drop in zip(batch.column("n_lines").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            keep = np.ones(n, np.uint8)
            keep[drop] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        dropped = [len(d) for d in batch.column("drop").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("rid"), pa.array(batch.column("n_lines").to_pylist(), pa.int64()), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())],
            names=["doc_id", "rid", "n_lines", "n_dropped", "keep_bitmap"],
        )


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep bitmaps of the documents that lose lines: doc_id, rid, n_lines, n_dropped, keep_bitmap.

    A line whose key (see :func:`line_keys`) has at least ``min_chars`` code points and stands in
    at least ``min_docs`` documents is dropped wherever it stands. ``keep_bitmap`` is zlib over
    one bit a line, first line in the highest bit. Documents absent from the result keep all.

    A null or empty text is one empty line, whose key is too short to be dropped. Documents are
    counted by doc_id; rows without one are told apart by their text. Repeated rows count once and get the same
    bitmap. A text may have any number of lines. An empty table gives an empty result; other columns are ignored.
    """
    own = documents(docs, id_col, text_col).withColumn("rid", row_key())
    who = F.when(F.col("doc_id").isNull(), F.col("rid")).otherwise(F.xxhash64("doc_id"))
    texts = own.select("doc_id", "rid", who.alias("who"), F.col("text").cast("binary").alias("text"))
    lines = texts.mapInArrow(lean(_lines(max(1, min_chars)), 1000), _LINES)
    by = ["h1", "h2", "who", "rid"]
    found = materialize(lines.repartitionByRange(*by).sortWithinPartitions(*by, "pos").mapInArrow(lean(_stream(min_docs)), _FOUND), "lines")
    split = found.filter(F.col("kind") == _COUNT).groupBy("h1", "h2").agg(F.countDistinct("who").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")
    # at most two keys for each range partition, and those with more rows than a task holds
    pending, small = found.filter(F.col("kind") == _PENDING), broadcast_if_small(split)
    hot = hot_keys(pending.groupBy("h1", "h2").agg(F.count("*").alias("n")), ["h1", "h2"], pending.count()) if small is split else None
    late = join_split(pending, small, ["h1", "h2"], hot)
    columns = ["rid", "doc_id", "pos", "n_lines"]
    gone = found.filter(F.col("kind") == _DROPPED).select(columns).unionByName(late.select(columns))
    each = gone.groupBy("rid", "doc_id").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("drop"))
    return each.mapInArrow(_bitmaps, "doc_id long, rid long, n_lines long, n_dropped long, keep_bitmap binary")


def kept_lines(text: bytes, keep_bitmap: bytes | None) -> tuple[list[bytes], int]:
    """The lines that stay, and how many there were."""
    lines = text.split(b"\n")
    if keep_bitmap is None:
        return lines, len(lines)
    keep = np.unpackbits(np.frombuffer(zlib.decompress(keep_bitmap), np.uint8), count=len(lines))
    return [line for line, stays in zip(lines, keep, strict=True) if stays], len(lines)


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_lines, n_dropped = [], [], []
            for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep_bitmap").to_pylist(), strict=True):
                lines, n = kept_lines(text or b"", keep)
                data = b"\n".join(lines)
                out.append(data.decode() if with_text else hashlib.sha256(data).hexdigest())
                n_lines.append(n)
                n_dropped.append(n - len(lines))
            rest = [batch.column(c) for c in batch.schema.names if c not in ("text", "keep_bitmap")]
            names = [c for c in batch.schema.names if c not in ("text", "keep_bitmap")]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(out, pa.string())],
                names=[*names, "n_lines", "n_dropped", "kept_text" if with_text else "kept_sha256"],
            )

    return run


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its bitmap applied: doc_id, n_lines, n_dropped and kept_text, or kept_sha256 if ``digest``.

    Kept lines are joined by \\n. One row comes out for each row of ``docs``.
    """
    texts = documents(docs, id_col, text_col).withColumn("rid", row_key())
    maps = bitmaps.select("doc_id", "rid", "keep_bitmap")
    both = join_documents(texts, maps, hot_documents(texts)).select("doc_id", F.col("text").cast("binary").alias("text"), "keep_bitmap")
    what = "kept_sha256" if digest else "kept_text"
    return both.mapInArrow(lean(_apply(not digest), 1000), f"doc_id long, n_lines long, n_dropped long, {what} string")


def without_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, the dropped lines gone from the text; a null text stays null."""
    own = {f.name: f"_own{i}" for i, f in enumerate(docs.schema.fields)}
    texts = docs.select(*(docs[c].alias(own[c]) for c in docs.columns), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    texts = texts.withColumn("rid", row_key())
    both = join_documents(texts, bitmaps.select("doc_id", "rid", "keep_bitmap"), hot_documents(texts))
    rest = [own[c] for c in docs.columns if c != text_col]
    found = both.select(*rest, F.col("text").isNull().alias("_null"), F.col("text").cast("binary").alias("text"), "keep_bitmap")
    kinds = ", ".join(f"{own[f.name]} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col)
    done = found.mapInArrow(lean(_apply(True), 1000), f"{kinds}, _null boolean, n_lines long, n_dropped long, kept_text string")
    return done.select(*(F.when(~F.col("_null"), F.col("kept_text")).alias(c) if c == text_col else F.col(own[c]).alias(c) for c in docs.columns))
