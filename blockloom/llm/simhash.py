"""SimHash near-dedup: pigeonhole blocks, Hamming verification, components.

Two 64-bit fingerprints that differ in at most d bits differ in at most d of the blocks they
are cut into, so with d+6 blocks they agree in some six. Every distinct fingerprint is dealt once
under each choice of six agreeing blocks; a bucket then holds at most 2^(free bits) distinct
values (65,536 for d=2), however many near copies the corpus has. A bucket is never paired off:
each value looks its few neighbours up in the bucket's sorted values, and only the edges of a
spanning forest leave the task.

A wider distance, such as that of texts alike by four fifths, leaves no blocks long enough to select. For it
:func:`near_clusters` takes a fingerprint of 1024 bits, blocks of bits drawn at random, in so many draws that a pair
at that distance agrees in some, and Hamming verification inside the buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import documents, hot_keys, join_split, lean, materialize, row_key
from blockloom.llm.graph import connected_components

SEED = 42


def simhash(text: bytes | None, words: int = 3) -> bytes:
    """Eight bytes: a bit is 1 if set in over half the shingles' XXH64 (seed 42), repeats included.

    A-Z lowered, words are runs of anything but ``[\\x20\\x09-\\x0D]``, shingles are ``words`` of them
    joined by a space; fewer words make one shingle, none make zero.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return bytes(8)
    shingles = [b" ".join(parts)] if len(parts) < words else map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_digest
    bits = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    half, total = len(bits) / 2, np.zeros(64, np.int64)
    for at in range(0, len(bits), 1 << 16):
        total += np.unpackbits(bits[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total > half).tobytes()


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = b"".join([simhash(t, words) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(np.frombuffer(data, ">i8").astype(np.int64))], names=["doc_id", "rid", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, fp long), one row for each row of ``docs``; null and empty texts have fp 0."""
    texts = documents(docs, id_col, text_col)
    return texts.select("doc_id", row_key().alias("rid"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(_fingerprints(words), 1000), "doc_id long, rid long, fp long")


def _bounds(n_blocks: int) -> list[int]:
    return [round(i * 64 / n_blocks) for i in range(n_blocks + 1)]


def block_masks(distance: int) -> list[int]:
    """The bits that stay, for each choice of ``distance`` blocks that may differ."""
    at = _bounds(distance + 6)
    masks = []
    for free in combinations(range(distance + 6), distance):
        mask = (1 << 64) - 1
        for b in free:
            mask &= ~(((1 << (at[b + 1] - at[b])) - 1) << at[b])
        masks.append(mask)
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(values: np.ndarray, distance: int, mask: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs within ``distance`` among sorted distinct ``values`` of a bucket."""
    n = len(values)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(pairs) -> Iterator[tuple[int, int]]:
        for i, j in pairs:
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield int(values[i]), int(values[j])

    if n <= 256:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
        yield from join(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True))
        return
    free = [b for b in range(64) if not mask >> b & 1]
    for k in range(1, distance + 1):
        for flip in combinations(free, k):
            other = values ^ np.uint64(sum(1 << b for b in flip))
            at = np.minimum(np.searchsorted(values, other), n - 1)
            hit = np.flatnonzero((values[at] == other) & (values < other))
            yield from join(zip(hit.tolist(), at[hit].tolist(), strict=True))


def _bucket_edges(distance: int, masks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_t = held_k = held_f = None

        def solved(t, k, f, starts, ends) -> pa.RecordBatch | None:
            us, vs = [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                for u, v in _links(np.unique(f[a:b]), distance, masks[int(t[a])]):
                    us.append(u)
                    vs.append(v)
            if us:
                return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)], names=["u", "v"])
            return None

        def cut(last: bool):
            nonlocal held_t, held_k, held_f
            fresh = np.ones(len(held_t), bool)
            fresh[1:] = (held_t[1:] != held_t[:-1]) | (held_k[1:] != held_k[:-1])
            starts = np.flatnonzero(fresh)
            ends = np.append(starts[1:], len(held_t))
            done = len(starts) if last else len(starts) - 1
            many = np.flatnonzero(ends[:done] - starts[:done] > 1)
            out = solved(held_t, held_k, held_f, starts[many], ends[many])
            rest = ends[-1] if last else starts[-1]
            held_t, held_k, held_f = held_t[rest:], held_k[rest:], held_f[rest:]
            return out

        for batch in batches:
            t, k, f = (batch.column(c).to_numpy() for c in ("choice", "block", "fp"))
            f = f.view(np.uint64)
            held_t, held_k, held_f = (t, k, f) if held_t is None else (np.append(held_t, t), np.append(held_k, k), np.append(held_f, f))
            if len(held_t) and (out := cut(False)) is not None:
                yield out
        if held_t is not None and len(held_t) and (out := cut(True)) is not None:
            yield out

    return run


def near_pairs(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (u, v) that connect every two of the distinct ``fp`` values within ``distance`` bits.

    Each edge is a pair that close; edges that a bucket's other edges imply are left out.
    """
    masks = block_masks(distance)
    dealt = distinct.select(F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("choice", "block"), "fp")
    return dealt.repartition("choice", "block").sortWithinPartitions("choice", "block").mapInArrow(lean(_bucket_edges(distance, masks)), "u long, v long").distinct()


#: Bits of a wide fingerprint; the first of them verify, blocks are drawn from the rest.
WIDE, VERIFY = 1024, 192
#: Distinct nodes of a bucket, on average.
BUCKET = 1000
#: Draws of blocks are made until a pair misses all with a probability of e to the minus this, its bits taken as independent.
MISS = 11
#: Standard deviations that a pair's distance may exceed the expected one, and the share of bits by which texts of few shingles do so
#: (four of five shingles alike differ by 3/16, where many differ by 0.15).
SIGMAS, FEW = 4, 0.04

_RNG = np.random.default_rng(SEED)
_SEEDS = _RNG.integers(0, 1 << 64, WIDE // 64, np.uint64)
_LOW = np.uint64(0x0101010101010101)


def wide_simhash(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints (set x WIDE/64, uint64): a bit is 1 if set in over half of the set's hashes, mixed anew for each 64 bits.

    Eight counters of a byte go through one addition, at most 255 hashes at a time.
    """
    h, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    parts = -(-sizes // 255)
    firsts = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(sizes) - sizes - 255 * firsts, parts) + 255 * np.arange(parts.sum())
    out = np.zeros((len(sets), WIDE // 64), np.uint64)
    for w, seed in enumerate(_SEEDS):
        x = (h ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        for k in range(8):
            counts = np.add.reduceat(x >> np.uint64(k) & _LOW, starts).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(counts, firsts, axis=0, dtype=np.int64) * 2 > sizes[:, None]
            out[:, w] |= np.ascontiguousarray(ones).view(np.uint64).ravel() << np.uint64(k)
    return out


def expected_share(similarity: float) -> float:
    """The share of bits in which sets of this Jaccard similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_apart(similarity: float, bits: int) -> int:
    """The bits of ``bits`` that sets of this Jaccard similarity may differ in; see SIGMAS and FEW."""
    p = expected_share(similarity)
    return int(bits * (p + FEW) + SIGMAS * (bits * p * (1 - p)) ** 0.5)


def drawn_blocks(n: int, similarity: float, bucket: int = BUCKET) -> np.ndarray:
    """Positions of the bits (draw x bits) that name the buckets of ``n`` nodes."""
    bits = max(0, round(math.log2(max(1, n) / bucket)))
    draws = math.ceil(MISS / (1 - expected_share(similarity)) ** bits) if bits else 1
    rng = np.random.default_rng(SEED)
    return np.stack([VERIFY + rng.choice(WIDE - VERIFY, bits, replace=False) for _ in range(draws)])


def _drawn(blocks: np.ndarray):
    draws, n_bits = blocks.shape
    weight = 1 << np.arange(n_bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
            buckets = np.stack([bits[:, b] @ weight + (k << n_bits) for k, b in enumerate(blocks)], axis=1).astype(np.int64)
            each = np.repeat(np.arange(batch.num_rows), draws)
            verify = [pa.array(wide[each, i].view(np.int64)) for i in range(VERIFY // 64)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel()), batch.column("sid").take(pa.array(each)), *verify], names=["bucket", "sid", "f0", "f1", "f2"])

    return run


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each of ``a`` and each of ``b`` (both node x words)."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return out


def _labels(prints: np.ndarray, most: int) -> np.ndarray:
    """A label for each of ``prints`` (node x words): the same for those that chains of steps of at most ``most`` bits reach."""
    n = len(prints)
    label = np.arange(n)
    if n <= 2048:
        found = []
        for at in range(0, n, 64):
            i, j = np.nonzero(apart(prints[at : at + 64], prints[at:]) <= most)
            found.append(np.stack([i, j])[:, i < j] + at)
        i, j = np.concatenate(found, axis=1)
        while (label[i] != label[j]).any():
            least = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], least)
            np.minimum.at(label, label[j], least)
            label = label[label]
        return label
    # many nodes alike: what a node reaches is compared with the rest only, not with each other
    left = np.arange(n)
    while len(left):
        front, seed, left = left[:1], left[0], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            some = max(1, min(64, (1 << 20) // len(left)))
            for at in range(0, len(front), some):
                rest = np.flatnonzero(~hit)
                hit[rest] = (apart(prints[front[at : at + some]], prints[left[rest]]) <= most).any(axis=0)
            front, left = left[hit], left[~hit]
            label[front] = seed
    return label


def _clusters(most: int):
    """Clusters of the nodes of each bucket, of two members or more; a cluster's key is a hash of its members."""

    def solved(sid: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        label = _labels(prints, most)
        order = np.lexsort((sid, label))
        sid, label = sid[order], label[order]
        starts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        sizes = np.diff(np.append(starts, len(sid)))
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        if not len(starts):
            return
        keys = np.array([xxhash.xxh64_intdigest(sid[a : a + n].tobytes(), SEED) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)], np.uint64).view(np.int64)
        rows = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(keys, sizes), np.repeat(sizes, sizes), np.repeat(sid[starts], sizes), sid[rows])], names=["key", "n", "least", "sid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the bucket that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in ("bucket", "sid", "f0", "f1", "f2")], axis=1)
            cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            for piece in np.split(rows, cuts):
                if held and held[-1][-1, 0] != piece[0, 0]:
                    whole = np.concatenate(held)
                    yield from solved(whole[:, 1], whole[:, 2:].view(np.uint64))
                    held = []
                held.append(piece)
        if held:
            whole = np.concatenate(held)
            yield from solved(whole[:, 1], whole[:, 2:].view(np.uint64))

    return run


def near_clusters(nodes: DataFrame, similarity: float, bucket: int = BUCKET) -> DataFrame:
    """(key, n, least, sid) of clusters of ``nodes`` (sid, fp of :func:`wide_simhash`, both distinct), equal clusters once.

    Nodes whose sets have this Jaccard similarity or more are in one cluster of some key, but for a few in ten thousand at the
    bound, fewer above it; n is the members of a cluster and ``least`` the least of them.
    """
    blocks = drawn_blocks(nodes.count(), similarity, bucket)
    dealt = nodes.select("sid", "fp").mapInArrow(lean(_drawn(blocks), 1000), "bucket long, sid long, f0 long, f1 long, f2 long")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lean(_clusters(most_apart(similarity, VERIFY))), "key long, n long, least long, sid long").dropDuplicates(["key", "sid"])


def simhash_groups(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rid, fp long, fingerprint (16 hex digits), root, component_id; one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id that chains of links reach. Null and empty texts have
    fingerprint zero and are linked like any other; a null doc_id is in a component but names none
    (a component of null ids alone has a null id). Equal fingerprints collapse to one before any
    blocks are dealt, so groups of copies cost one row. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, words, id_col, text_col), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    roots = connected_components(near_pairs(distinct.select("fp"), distance))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    # of a component of many fingerprints, and of a fingerprint of many documents, no task takes all
    of_print = join_split(rooted, named.drop("n"), ["root"], hot_keys(named, ["root"], distinct.count())).select("fp", "root", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    both = join_split(prints, of_print, ["fp"], hot_keys(distinct, ["fp"], prints.count()))
    return both.select("doc_id", "rid", "fp", hexed, "root", "component_id")


def first_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, one row of each ``root`` of ``groups`` (doc_id, rid, root): its least doc_id (a null id only if all are).

    Rows that share that id go by a hash of the row; of rows with equal id and text, the one whose columns hash
    least stays. ``groups`` has to be a written table, as it is read more than once. Rows that go are no part of any
    shuffle but that of the join.
    """
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("f")).select("f.doc_id", "f.rid")
    repeated = groups.groupBy("doc_id", "rid").agg(F.count("*").alias("n")).filter("n > 1")
    none = F.col("doc_id").isNull()
    both = first.alias("a").join(repeated.alias("b"), (F.col("a.rid") == F.col("b.rid")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    chosen = materialize(both.select("a.doc_id", "a.rid", F.coalesce("n", F.lit(1)).alias("n")).select("rid", F.when(none, F.lit(0)).otherwise(F.xxhash64("doc_id")).alias("same"), "n"), "first")
    own = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    doc_id, text = F.col(own[id_col]).cast("long"), F.col(own[text_col]).cast("string")
    keyed = docs.toDF(*own.values()).withColumns({"rid": F.xxhash64(doc_id, text), "same": F.when(doc_id.isNull(), F.lit(0)).otherwise(F.xxhash64(doc_id))})
    hot = hot_keys(chosen.select("rid", "n"), ["rid"], groups.count())
    kept = join_split(keyed, chosen, ["rid", "same"], hot)
    back = [F.col(f"{o}").alias(c) for c, o in own.items()]
    single = kept.filter("n = 1").select(back)
    if not chosen.filter("n > 1").limit(1).count():
        return single
    row = F.struct(*own.values())
    # partial aggregates leave one row a task
    several = kept.filter("n > 1").groupBy("rid", "same").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return single.unionByName(several.select("row.*").select(back))


def one_of_each(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns, one row of each component; see :func:`first_of_each`."""
    groups = materialize(simhash_groups(docs, words, distance, id_col, text_col).select("doc_id", "rid", "root"), "groups")
    return first_of_each(docs, groups, id_col, text_col)
