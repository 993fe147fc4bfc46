"""Suffix-array dedup: bytes covered by strings of ``length`` bytes that start anywhere else too.

1. Winnowing (:mod:`blockloom.llm.anchors`) cuts each text's windows into runs with one anchor each. Equal
   windows have equal anchors at equal offsets, so only runs whose anchor occurs twice can matter: nothing is lost.
2. Runs with equal text collapse to one, which carries their number as a weight.
3. The runs of an anchor go to one block (those with an anchor for themselves to the block of the stretch of text that they
   are in): its Burrows-Wheeler transform and threshold-bounded interval expansion
   (:mod:`blockloom.llm.interval`) tell which windows start twice, weights counted. Every decision is made there.
4. An anchor with more distinct text than a block may hold (say, a passage that a third of all documents
   wrap in text of their own) is dealt again: its windows are parted by how far they reach to the left of the anchor,
   and those of a part by the bytes that all windows of the part have around the anchor. Equal windows stay together, as
   they reach as far and have equal bytes. The finer groups collapse and go to transforms as before; groups still
   too large are parted once more, down to single windows, whose groups hold one text alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import anchors
from blockloom.llm.common import documents, drop, hot_documents, hot_keys, join_documents, join_split, lean, materialize, release, row_key
from blockloom.llm.interval import repeated_starts

#: Bytes of a transform; small enough to stay in cache.
BLOCK = 1 << 19
#: Bytes of distinct text of one group that a block may hold; larger groups are dealt again.
MOST = 1 << 18
#: Parts that the windows of an oversize group are dealt to.
PARTS = 4
#: A longer text is cut into pieces that overlap by a window; a piece is handled at once, like :data:`anchors.CHUNK`.
PIECE = 1 << 19

_RUNS = "ah long, sh long, doc_id long, rid long, loc long"
#: What a transform decides: spans of windows (from the text's start) of a run, and whether it is one of several equal ones.
_SPANS = "ah long, sh long, n long, doc_id long, rid long, a int, b int"
#: A run with its text: n equal ones; the windows a text may hold reach lo to hi bytes to the left of the anchor.
_PIECES = "ah long, sh long, n long, loc long, lo int, hi int, doc_id long, rid long, text binary"


def _signed64(x) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _runs(length: int, gram: int):
    """loc packs a run's first window (from the text's start), its windows less one, and its anchor from there."""

    def flush(ids, rids, pieces, offsets) -> pa.RecordBatch | None:
        data = b"".join(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        first, last, anchor, hashes = anchors.runs(np.frombuffer(data, np.uint8), ends, length, gram)
        if not len(first):
            return None
        owner = np.searchsorted(ends, first, side="right")
        begins = np.append(0, ends[:-1])
        start = first - begins[owner] + np.array(offsets)[owner]
        digest = xxhash.xxh3_64_intdigest
        sh = _signed64([digest(data[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)])
        loc = start << 32 | (last - first) << 16 | (anchor - first)
        rows = pa.array(owner)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(sh), pa.array(ids, pa.int64()).take(rows), pa.array(rids, pa.int64()).take(rows), pa.array(loc)],
            names=["ah", "sh", "doc_id", "rid", "loc"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            for doc_id, rid, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rid", "text")), strict=True):
                text = text or b""
                for at in range(0, max(1, len(text) - length + 1), PIECE):
                    piece = text[at : at + PIECE + length - 1]
                    for column, value in zip(held, (doc_id, rid, piece, at), strict=True):
                        column.append(value)
                    size += len(piece)
                    if size >= anchors.CHUNK:
                        if (out := flush(*held)) is not None:
                            yield out
                        held, size = ([], [], [], []), 0
        if size and (out := flush(*held)) is not None:
            yield out

    return run


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.binary()]
    names = ["ah", "sh", "n", "loc", "lo", "hi", "doc_id", "rid", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _stretches(asked: list[dict], length: int) -> list[tuple[int, int, list[dict]]]:
    """First and last byte, and runs, of each stretch of runs whose windows follow each other."""
    out: list[tuple[int, int, list[dict]]] = []
    for r in sorted(asked, key=lambda r: r["loc"]):
        first, last = r["loc"] >> 32, (r["loc"] >> 32) + (r["loc"] >> 16 & 0xFFFF)
        if out and first <= out[-1][1] - length + 1 and last + length - (at := out[-1])[0] <= BLOCK:
            out[-1] = (at[0], last + length, [*at[2], r])
        else:
            out.append((first, last + length, [r]))
    return out


def _texts(length: int, gram: int):
    """The text of each requested run. Copies of a row, which come to the same tasks, are passed over.

    A run that is the only one of its anchor, but stands for several, shares windows with no other: its weight decides.
    Stretches of such runs go through a transform at once, with that weight; those decided come back without a text.
    """

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(9)]
        for (doc_id, rid, begin, runs, _), found in zip(rows, repeated_starts([r[4] for r in rows], [2] * len(rows), length), strict=True):
            for r in runs:
                first, more = (r["loc"] >> 32) - begin, r["loc"] >> 16 & 0xFFFF
                if found[first : first + more + 1].all():
                    for column, value in zip(cols, (r["ah"], r["sh"], r["n"], r["loc"], 0, length - gram, doc_id, rid, None), strict=True):
                        column.append(value)
        return _batch(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for doc_id, rid, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rid", "text", "asked")), strict=True):
                if rid in seen:
                    continue
                if len(seen) >= 1 << 16:
                    seen.clear()
                seen.add(rid)
                for begin, end, runs in _stretches([r for r in asked if r["n_kinds"] == 1], length):
                    held.append((doc_id, rid, begin, runs, text[begin:end]))
                    size += end - begin
                    if size >= BLOCK:
                        yield solve(held)
                        held, size = [], 0
                for r in asked:
                    if r["n_kinds"] > 1:
                        start, more = r["loc"] >> 32, r["loc"] >> 16 & 0xFFFF
                        for column, value in zip(cols, (r["ah"], r["sh"], r["n"], r["loc"], 0, length - gram, doc_id, rid, text[start : start + more + length]), strict=True):
                            column.append(value)
            yield _batch(cols)
        if held:
            yield solve(held)

    return run


def _finer(length: int):
    """The runs of oversize groups, each cut into runs whose windows reach about as far to the left of the anchor.

    The new group is a hash of the old one, the reach, and the bytes that all windows of that reach have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for ah, _, n, loc, lo, hi, doc_id, rid, text in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                start, more, anchor = loc >> 32, loc >> 16 & 0xFFFF, loc & 0xFFFF
                step = -(-(hi - lo + 1) // PARTS)
                for l in range(lo, hi + 1, step):  # noqa: E741
                    h = min(hi, l + step - 1)
                    first, last = max(0, anchor - h), min(more, anchor - l)
                    if first <= last:
                        core = text[anchor - l : anchor - h + length]
                        part = text[first : last + length]
                        group = xxhash.xxh3_64_digest(b"%d %d %d " % (ah, l, h) + core)
                        row = (int.from_bytes(group, "big", signed=True), int.from_bytes(xxhash.xxh3_64_digest(part), "big", signed=True), n, start + first << 32 | last - first << 16 | anchor - first, l, h, doc_id, rid, part)
                        for column, value in zip(cols, row, strict=True):
                            column.append(value)
            yield _batch(cols)

    return run


def _ranges(found: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each stretch of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], found.astype(np.int8), [0]))))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def _transform(length: int, alone: bool):
    """Blocks of whole groups, in order; the windows that start twice, as spans. ``alone``: each run is a group of its own."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        out: list[list] = [[] for _ in range(7)]
        for (ah, sh, n, loc, doc_id, rid, _), found in zip(rows, repeated_starts([r[6] for r in rows], [min(2, r[2]) for r in rows], length), strict=True):
            if found.any():
                for a, b in zip(*_ranges(found), strict=True):
                    for column, value in zip(out, (ah, sh, n, doc_id, rid, (loc >> 32) + a, (loc >> 32) + b), strict=True):
                        column.append(value)
        if not out[1]:
            return None
        kinds = [pa.int64()] * 5 + [pa.int32()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["ah", "sh", "n", "doc_id", "rid", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("ah", "sh", "n", "loc", "doc_id", "rid", "text")), strict=True):
                if row[:2] == last:
                    continue  # the same run, of a copy of its row
                if size >= BLOCK and (alone or row[0] != last[0]):
                    if (out := solve(rows)) is not None:
                        yield out
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
                last = row[:2]
        if rows and (out := solve(rows)) is not None:
            yield out

    return run


def _solved(pieces: DataFrame, length: int, alone: bool = False) -> DataFrame:
    """What transforms decide for ``pieces`` whose groups all fit a block, or which are groups by themselves."""
    dealt = pieces.repartition("ah", "sh") if alone else pieces.repartition("ah")
    return dealt.sortWithinPartitions("ah", "sh").select("ah", "sh", "n", "loc", "doc_id", "rid", "text").mapInArrow(lean(_transform(length, alone)), _SPANS)


def _spans_of(pieces: DataFrame, length: int, most: int) -> DataFrame:
    """(doc_id, rid, a, b) of the windows that start twice, and (ah, sh, n) of the runs decided, from the first groups on.

    ``pieces``: one row for each distinct run, n how many there are. A run of n >= 2 stands for rows elsewhere, which the
    caller knows by (ah, sh).
    """
    sizes = lambda rows: rows.groupBy("ah").agg(F.sum("bytes").alias("bytes"))
    sized = pieces.withColumn("bytes", F.octet_length("text").cast("long"))
    large = materialize(sizes(sized).filter(F.col("bytes") > most), "large")
    if not large.limit(1).count():
        return materialize(_solved(pieces, length), "spans")
    # few groups are large: each has over `most` bytes
    hot = hot_keys(large.select("ah", F.col("bytes").alias("n")), ["ah"], large.agg(F.sum("bytes")).first()[0])
    marked = join_split(pieces, large.withColumn("large", F.lit(True)).select("ah", "large"), ["ah"], hot, "left")
    rest = materialize(marked.filter("large").select(pieces.columns), "large")
    # a run of an oversize group that stands for several is decided by its weight; single ones by what they share
    spans = materialize(_solved(marked.filter("large IS NULL").drop("large"), length).unionByName(_solved(rest.filter("n >= 2"), length, alone=True)), "spans")
    while True:
        parts = rest.mapInArrow(lean(_finer(length), 1000), _PIECES)
        # equal parts collapse; those of single runs are remembered, as each may be a span
        parts = materialize(parts, "parts")
        kinds = materialize(parts.groupBy("ah", "sh").agg(F.sum("n").alias("total"), F.count("*").alias("n_rows"), *(F.first(c).alias(c) for c in ("loc", "lo", "hi", "doc_id", "rid", "text"))), "kinds")
        groups = kinds.groupBy("ah").agg(F.sum("total").alias("n_all"), F.count("*").alias("n_kinds"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.max("lo").alias("lo"), F.max("hi").alias("hi")).filter("n_all >= 2")
        live = materialize(groups.withColumn("large", F.expr(f"bytes > {most} AND hi > lo AND n_kinds > 1")).select("ah", "large", "n_kinds"), "groups")
        some = hot_keys(live.select("ah", F.col("n_kinds").alias("n")), ["ah"], live.agg(F.coalesce(F.sum("n_kinds"), F.lit(0))).first()[0])
        own = join_split(kinds.withColumnRenamed("total", "n"), live.drop("n_kinds"), ["ah"], some)
        columns = ["ah", "sh", "n", "loc", "lo", "hi", "doc_id", "rid", "text"]
        found = materialize(_solved(own.filter("NOT large").select(columns), length), "spans")
        rest = materialize(own.filter("large").select(columns), "large")
        # a kind of weight 1 is a single row; the rows of others are looked up
        single = found.filter("n = 1")
        whole = found.filter("n >= 2").unionByName(_solved(rest.filter("n >= 2"), length, alone=True))
        decided = whole.select("ah", "sh").distinct().join(kinds.filter("n_rows > 1").select("ah", "sh", F.col("n_rows").alias("n")), ["ah", "sh"])
        decided = materialize(decided, "decided")
        heat = hot_keys(decided, ["ah", "sh"], parts.count())
        start, more = F.shiftright("loc", 32).cast("int"), F.shiftright("loc", 16).bitwiseAND(F.lit(0xFFFF)).cast("int")
        members = join_split(parts.filter("n = 1").select("ah", "sh", "doc_id", "rid", "loc"), decided.select("ah", "sh"), ["ah", "sh"], heat)
        now = single.select("doc_id", "rid", "a", "b").unionByName(members.select("doc_id", "rid", start.alias("a"), (start + more).alias("b")))
        now = now.select(F.lit(0).cast("long").alias("ah"), F.lit(0).cast("long").alias("sh"), F.lit(1).cast("long").alias("n"), "doc_id", "rid", "a", "b")
        spans = spans.unionByName(materialize(now, "spans"))
        drop(parts, found, kinds)
        release(pieces.sparkSession)
        if not rest.limit(1).count():
            return spans


def repeated_spans(docs: DataFrame, length: int = 400, gram: int | None = None, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, rid, spans): ranges a..b of windows of ``length`` bytes that start anywhere else too.

    Window ``a`` is the ``length`` UTF-8 bytes from offset ``a``. Ranges of one document may overlap or touch;
    documents without any are absent. And the hot rows of ``docs``; see :func:`blockloom.llm.common.hot_documents`.
    """
    spark = docs.sparkSession
    gram = gram or min(anchors.GRAM, max(1, length // 3))
    if not 0 < gram <= length or length - gram > 0xFFFF:
        raise ValueError("the anchor must be at least a byte long, fit a window, and be at most 65,535 bytes shorter")
    texts = documents(docs, id_col, text_col).select("doc_id", row_key().alias("rid"), F.col("text").cast("binary").alias("text"))
    hot_rows = hot_documents(texts)
    runs = materialize(texts.mapInArrow(lean(_runs(length, gram), 1000), _RUNS), "runs")
    # equal runs collapse in the partial aggregate, so a hot anchor's copies are never gathered
    kinds = materialize(runs.groupBy("ah", "sh").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rid", "loc")).alias("at")).select("ah", "sh", "n", "at.*"), "kinds")
    groups = kinds.groupBy("ah").agg(F.sum("n").alias("total"), F.count("*").alias("n_kinds")).filter("total >= 2")
    wide = hot_keys(groups.select("ah", F.col("n_kinds").alias("n")), ["ah"], kinds.count())
    live = materialize(join_split(kinds, groups.select("ah", "n_kinds"), ["ah"], wide).select("ah", "sh", "n", "n_kinds", "doc_id", "rid", "loc"), "live")
    drop(kinds)
    release(spark)
    asked = live.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("ah", "sh", "n", "n_kinds", "loc")).alias("asked"))
    wanted = join_documents(texts, asked, hot_rows, "inner").select("doc_id", "rid", "text", "asked")
    pieces = materialize(wanted.mapInArrow(lean(_texts(length, gram), 1000), _PIECES), "pieces")
    drop(live)
    release(spark)
    spans = _spans_of(pieces.filter("text IS NOT NULL"), length, most)
    release(spark)
    # the rows of a run that stands for several; all of its windows start twice, as a transform found with its weight
    decided = spans.filter("n >= 2").select("ah", "sh", "n").unionByName(pieces.filter("text IS NULL").select("ah", "sh", "n"))
    decided = materialize(decided.groupBy("ah", "sh").agg(F.first("n").alias("n")), "decided")
    heat = hot_keys(decided, ["ah", "sh"], runs.count())
    start, more = F.shiftright("loc", 32).cast("int"), F.shiftright("loc", 16).bitwiseAND(F.lit(0xFFFF)).cast("int")
    members = join_split(runs, decided.select("ah", "sh"), ["ah", "sh"], heat).select("doc_id", "rid", start.alias("a"), (start + more).alias("b"))
    found = spans.filter("n = 1").select("doc_id", "rid", "a", "b").unionByName(members)
    # the spans of a row that is repeated are those of any of its copies
    return found.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("a", "b")).alias("spans")), hot_rows


def covered(n: int, spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal stretches (from, to) of the ``n`` bytes that the windows of ``spans`` cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"] + length) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _remove(length: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, kept = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = text or b""
                cut = covered(len(text), spans or [], length)
                rest = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(text)], strict=True))
                sizes.append(len(text))
                removed.append(len(text) - len(rest))
                counts.append(len(cut))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, removed, counts)), pa.array(kept, pa.string() if digest else pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"],
            )

    return run


def suffix_dedup(docs: DataFrame, length: int = 400, digest: bool = False, gram: int | None = None, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes), or kept_sha256 if ``digest``; one row for each row of ``docs``.

    Texts are UTF-8 bytes, null is empty. Each byte of a ``length``-byte string that also starts
    anywhere else, in the same text or another, is removed; strings are judged on the input. What is kept may be
    cut inside a character, hence bytes. Repeated rows count as texts of their own, and so lose
    all such strings; a null doc_id is a doc_id; texts shorter than ``length`` are kept; an empty table gives
    an empty result; other columns are ignored.
    """
    found, hot = repeated_spans(docs, length, gram, most, id_col, text_col)
    texts = documents(docs, id_col, text_col).withColumn("rid", row_key())
    both = join_documents(texts, found, hot).select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    what = "kept_sha256 string" if digest else "kept binary"
    return both.mapInArrow(lean(_remove(length, digest), 1000), f"doc_id long, n_bytes long, n_removed long, n_spans long, {what}")
