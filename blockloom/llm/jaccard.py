"""Near copies by SimHash, decided by the Jaccard similarity of word shingles: fingerprints propose, exact sets decide.

Documents of equal shingle sets collapse to one node with a fingerprint of 1024 bits. Blocks of bits deal the nodes to buckets, Hamming
distances part a bucket into clusters (:func:`blockloom.llm.simhash.near_clusters`). Nodes of a
cluster are first compared with its least one, which links groups of copies at a linear cost. Where
a cluster still holds several components, its nodes are compared across them by all bits of their fingerprints,
in blocks; pairs not clearly below the threshold are decided there on whole shingle sets, and only links that connect
something leave the block. Every link is verified on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import documents, hot_keys, join_split, lean, materialize, release, row_key
from blockloom.llm.graph import connected_components
from blockloom.llm.simhash import BUCKET, SEED, WIDE, apart, first_of_each, most_apart, near_clusters, wide_simhash

#: Members of a cluster that are compared in one block.
BLOCK = 1024
#: Parts in which a node's partners are dealt for verification.
SALTS = 64


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; A-Z lowered, cut at white space as for SimHash.

    Fewer words make one shingle of all; none make the empty one, which only such texts have.
    """
    parts = (text or b"").lower().split()
    shingles = {b" ".join(parts)} if len(parts) < words else set(map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)))
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles]), ">u8").astype(np.uint64))


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            sids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            prints = pa.array([f.tobytes() for f in wide_simhash(sets)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(sids), prints], names=["doc_id", "rid", "sid", "fp"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("fp"), pa.array(sets, pa.binary())], names=["sid", "fp", "shingles"])

    return run


def _similar(num: int, den: int):
    """Pairs (u, v) whose sets a, b have a Jaccard similarity of num/den or more, counted in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if den * min(len(a), len(b)) >= num * max(len(a), len(b)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if den * both >= num * (len(a) + len(b) - both):
                        keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("u", "v")], names=["u", "v"])

    return run


def _similar_sets(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of num/den or more, counted in whole numbers."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _across(most: int, num: int, den: int):
    """Links of a block: pairs in different components whose fingerprints differ in at most ``most`` bits and whose sets are similar enough.

    A pair that the links found before it connect is passed over, so fewer links than nodes come out.
    """

    def solved(rows: list[tuple], same_chunk: bool) -> tuple[list[int], list[int]]:
        sid, root, first = (np.array([r[c] for r in rows]) for c in range(3))
        prints = np.frombuffer(b"".join([r[3] for r in rows]), np.uint64).reshape(len(rows), -1)
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        left = np.arange(len(rows)) if same_chunk else np.flatnonzero(first)
        right = left if same_chunk else np.flatnonzero(~first)
        _, group = np.unique(root, return_inverse=True)
        us, vs = [], []
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            near = apart(prints[some], prints[right]) <= most
            near &= group[some][:, None] != group[right][None, :]
            if same_chunk:
                near &= sid[some][:, None] < sid[right][None, :]
            for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                a, b = int(some[i]), int(right[j])
                if group[a] != group[b] and _similar_sets(sets[a], sets[b], num, den):
                    group[group == group[b]] = group[a]
                    us.append(int(sid[a]))
                    vs.append(int(sid[b]))
        return us, vs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                us, vs = solved(rows, held[1] == held[2])
                if us:
                    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "sid", "root", "chunk", "fp", "shingles")]
            for key, i, j, sid, root, chunk, fp, shingles in zip(*columns, strict=True):
                if (key, i, j) != held:
                    yield from flush()
                    held, rows = (key, i, j), []
                rows.append((sid, root, chunk == i, fp, shingles))
        yield from flush()

    return run


def _sets_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(sid, fp, shingles) of the nodes in ``wanted`` (sid)."""
    named = wanted.distinct().join(nodes.select("sid", "rid", "fp"), "sid")
    found = texts.join(named, "rid").select("sid", "fp", F.col("text").cast("binary").alias("text"))
    return materialize(found.mapInArrow(lean(_sets(words), 1000), "sid long, fp binary, shingles binary").dropDuplicates(["sid"]), "sets")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The ``pairs`` (u, v) of nodes that are similar enough. Shingle sets are made for the nodes of pairs alone."""
    sets = _sets_of(pairs.select(F.col("u").alias("sid")).union(pairs.select(F.col("v").alias("sid"))), nodes, texts, words)
    # a node with many partners is dealt in parts
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    left = salted.select("u", "salt").distinct().join(sets.select(F.col("sid").alias("u"), F.col("shingles").alias("a")), "u")
    one = salted.join(left, ["u", "salt"]).select("u", "v", "a")
    both = one.join(sets.select(F.col("sid").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")
    return materialize(both.mapInArrow(lean(_similar(num, den), 1000), "u long, v long"), "similar")


def _links_across(members: DataFrame, nodes: DataFrame, roots: DataFrame, texts: DataFrame, hot: DataFrame | None, words: int, num: int, den: int) -> DataFrame:
    """Links (u, v) between the components of ``roots``, of clusters that hold several; see :func:`_across`."""
    rooted = members.join(roots, members["sid"] == roots["node"], "left").select("key", "n", "sid", F.coalesce("root", "sid").alias("root"))
    rooted = materialize(rooted, "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("key")
    chunks = F.expr(f"n div {BLOCK} + 1")
    placed = materialize(join_split(rooted, mixed, ["key"], hot).withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks"))), "placed")
    sets = _sets_of(placed.select("sid"), nodes, texts, words)
    # each pair of a cluster's chunks meets in one block
    blocks = placed.withColumn("k", F.explode(F.expr("sequence(0L, chunks - 1)"))).join(sets, "sid")
    blocks = blocks.select("key", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"), "sid", "root", "chunk", "fp", "shingles")
    by = ["key", "i", "j"]
    across = _across(most_apart(num / den, WIDE), num, den)
    return materialize(blocks.repartition(*by).sortWithinPartitions(*by).mapInArrow(lean(across, 1000), "u long, v long"), "across")


def jaccard_groups(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, rid, sid, root; one row for each row of ``docs``.

    Documents whose shingle sets have a Jaccard similarity of num/den or more are linked; rows that chains of links
    reach have the same ``root``. ``bucket``: nodes that are compared by fingerprints at once, on average. Null and texts without words are alike. An empty table gives an empty result.
    """
    texts = documents(docs, id_col, text_col).withColumn("rid", row_key())
    kinds = "doc_id long, rid long, sid long, fp binary"
    prints = materialize(texts.select("doc_id", "rid", F.col("text").cast("binary").alias("text")).mapInArrow(lean(_prints(words), 250), kinds), "prints")
    nodes = materialize(prints.groupBy("sid").agg(F.count("*").alias("copies"), F.min("rid").alias("rid"), F.first("fp").alias("fp")), "nodes")
    members = materialize(near_clusters(nodes, num / den, bucket), "members")
    hot = hot_keys(members.filter("sid = least").select("key", "n"), ["key"], members.count())
    stars = materialize(members.filter("sid != least").select(F.col("least").alias("u"), F.col("sid").alias("v")).distinct(), "stars")
    links = _verified(stars, nodes, texts, words, num, den)
    release(docs.sparkSession)
    roots = materialize(connected_components(links), "roots")
    links = links.unionByName(_links_across(members, nodes, roots, texts, hot, words, num, den))
    release(docs.sparkSession)
    roots = materialize(connected_components(links), "roots")
    joined = nodes.select("sid").join(roots, F.col("sid") == roots["node"], "left").select("sid", F.coalesce("root", "sid").alias("root"))
    hot = hot_keys(nodes.select("sid", F.col("copies").alias("n")), ["sid"], prints.count())
    return materialize(join_split(prints.select("doc_id", "rid", "sid"), joined, ["sid"], hot).select("doc_id", "rid", "sid", "root"), "groups")


def one_of_each(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, one row of each group of near copies; see :func:`first_of_each`."""
    return first_of_each(docs, jaccard_groups(docs, words, num, den, id_col, text_col), id_col, text_col)
