"""Approximate nearest neighbours: NN-descent builds a graph by joins, queries walk it greedily.

Equal vectors collapse to one node first. A start comes from sorting the nodes along random
hyperplane codes and comparing neighbours in blocks. In each round of NN-descent a node meets with its neighbours
and with those that have it as one, as far as both ends drew each other: at most ``REVERSE`` of either kind, however many
have a hub as their neighbour. Vectors that meet are compared with each other, and each node keeps its ``k`` best. Rounds
go on until few entries change. A query keeps a pool of its ``pool`` best nodes, asks for the neighbours of those not asked
yet, and stops when none is left. The best nodes are scored again on the original vectors in double precision.

Nearness is compared as the squared distance of unit vectors, computed in double precision on single-precision components,
so that members of a dense group of near copies are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import drop, hot_keys, join_split, materialize, release

#: Neighbours a node keeps, and neighbours-of that it hears from in a round.
K, REVERSE = 24, 24
#: Random orders of the start, and vectors compared with each other there.
ORDERS, BLOCK, PLANES = 6, 256, 14
#: Rounds end when less than this part of all entries is new; so many rounds are an error.
SETTLED, MOST_ROUNDS = 0.01, 60
#: Candidates that a meeting proposes to each vector.
PROPOSALS = 8
#: Nodes in a query's pool.
POOL = 256
#: Vectors that are scored again: so many beyond those asked for, and all whose squared distance is within this part
#: of the last of them (single precision moves it by far less).
SLACK, MARGIN = 16, 0.001
#: Ids of equal vectors that are thinned together.
IDS_AT_ONCE = 50_000

_ENTRY = np.dtype([("id", "<i8"), ("sim", "<f4")])
_ROW = "node long, kind int, other long, data binary"
_KIND_VECTOR, _KIND_GRAPH, _KIND_BACK, _KIND_TOLD, _KIND_NEW = 0, 1, 2, 3, 4
#: Below any negated squared distance of unit vectors.
_NOTHING = -5.0


def _table(node, kind, other, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(kind, pa.int32()), pa.array(other, pa.int64()), pa.array(data, pa.binary())], names=["node", "kind", "other", "data"])


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The sorted input in pieces that don't cut a group."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        keys = held.column(key).to_numpy()
        other = np.flatnonzero(keys != keys[-1])
        if len(other):
            yield held.slice(0, int(other[-1]) + 1).combine_chunks()
            held = held.slice(int(other[-1]) + 1)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.append(starts[1:], len(keys))


def pack_vectors(vectors: np.ndarray) -> list[bytes]:
    """The vectors at unit length, in single precision."""
    return [a.tobytes() for a in (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype("<f4")]


def unpack_vectors(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<f4").reshape(len(data), -1).astype(np.float64)


def nearness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Negated squared distances of all rows of ``a`` from all rows of ``b``."""
    return 2 * (a @ b.T) - (a * a).sum(axis=1)[:, None] - (b * b).sum(axis=1)[None, :]


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node rows: the vector in double precision and packed; unusable vectors are left out."""
    for batch in batches:
        keep, exact, packed = [], [], []
        for i, v in enumerate(batch.column("v").to_pylist()):
            if v is None or not len(v) or any(x is None for x in v):
                continue
            a = np.array(v, np.float64)
            with np.errstate(over="ignore"):
                norm = np.linalg.norm(a)
            if np.isfinite(a).all() and norm > 0:
                a = a if np.isfinite(norm) and norm > 1e-150 else a / np.abs(a).max()
                keep.append(i)
                exact.append(a.tobytes())
                packed += pack_vectors(a[None, :])
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), pa.array(exact, pa.binary()), pa.array(packed, pa.binary())], names=["id", "exact", "packed"])


def make_nodes(vectors: DataFrame, members: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(node, exact, packed, ids): distinct usable vectors under their least id, with their ``members`` least ids.

    Vectors of each dimension are nodes by themselves.
    """
    own = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).filter("id IS NOT NULL")
    ready = own.mapInArrow(_prepare, "id long, exact binary, packed binary")
    # a hot vector's ids are thinned in salted parts first: no task gathers them all
    salts = vectors.count() // IDS_AT_ONCE + 1
    least = lambda c: F.slice(F.array_sort(c), 1, members)
    parts = ready.groupBy("exact", "packed", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(least(F.collect_set("id")).alias("ids"))
    return materialize(parts.groupBy("exact", "packed").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.col("ids")[0].alias("node"), "exact", "packed", "ids"), "nodes")


def _deal(orders: int, planes: int):
    """Each node once in each random order: by the sides of random planes, then along another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column("packed").to_pylist()
            x = unpack_vectors(data)
            for order in range(orders):
                rng = np.random.default_rng(order + 1)
                side = (x @ rng.standard_normal((x.shape[1], planes)).astype(np.float32) > 0) @ (1 << np.arange(planes))
                place = side + 1 / (1 + np.exp(-4 * (x @ rng.standard_normal(x.shape[1]).astype(np.float32))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), order), pa.int32()), pa.array(place.astype(np.float64)), batch.column("node"), batch.column("packed")], names=["o", "place", "node", "data"])

    return run


def _best(sims: np.ndarray, ids: np.ndarray, most: int, over: np.ndarray | None = None) -> list[bytes]:
    """For each row of ``sims``, its greatest entries, as bytes; those not over ``over`` are left out."""
    m = min(most, sims.shape[1])
    at = np.argpartition(-sims, m - 1, axis=1)[:, :m]
    got = np.take_along_axis(sims, at, 1)
    found = np.empty(got.shape, _ENTRY)
    found["id"], found["sim"] = ids[at], got
    least = np.full(len(sims), _NOTHING) if over is None else over
    return [row[row["sim"] > t].tobytes() for row, t in zip(found, least, strict=True)]


def _compare_blocks(block: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, data = batch.column("node").to_numpy(), batch.column("data").to_pylist()
            for first, end in zip(*_bounds(batch.column("o").to_numpy()), strict=True):
                for a in range(first, end, block):
                    some = ids[a : min(end, a + block)]
                    if len(some) > 1:
                        x = unpack_vectors(data[a : a + len(some)])
                        sims = nearness(x, x)
                        np.fill_diagonal(sims, _NOTHING)
                        yield _table(some, np.full(len(some), _KIND_NEW), some, _best(sims, some, min(k, len(some) - 1)))

    return run


def _merge(k: int):
    """(node, entries) rows to one row a node with its ``k`` best distinct entries; ``other`` is how many are new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches, "node"):
            nodes, data = group.column("node").to_numpy(), group.column("data").to_pylist()
            sizes = [len(d) // _ENTRY.itemsize for d in data]
            entries = np.frombuffer(b"".join(data), _ENTRY)
            owner, fresh = np.repeat(nodes, sizes), np.repeat(group.column("kind").to_numpy() == _KIND_NEW, sizes)
            if not len(owner):
                continue
            by = np.lexsort((fresh, entries["id"], owner))  # what is known already stands first
            owner, entries, fresh = owner[by], entries[by], fresh[by]
            keep = np.ones(len(owner), bool)
            keep[1:] = (owner[1:] != owner[:-1]) | (entries["id"][1:] != entries["id"][:-1])
            owner, entries, fresh = owner[keep], entries[keep], fresh[keep]
            by = np.lexsort((entries["id"], -entries["sim"], owner))
            owner, entries, fresh = owner[by], entries[by], fresh[by]
            starts, ends = _bounds(owner)
            ends = np.minimum(ends, starts + k)
            yield _table(owner[starts], np.full(len(starts), _KIND_GRAPH), [int(fresh[a:b].sum()) for a, b in zip(starts, ends, strict=True)], [entries[a:b].tobytes() for a, b in zip(starts, ends, strict=True)])

    return run


def _draw(node: np.ndarray, other: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each edge."""
    x = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + other.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt + 1)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x.view(np.int64)


def _back(most: int, salt: int):
    """Each edge turned round, in a drawn order ``o``. A node's first ``most`` of a batch go on: the first of all are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column("data").to_pylist()
            other = np.repeat(batch.column("node").to_numpy(), [len(d) // _ENTRY.itemsize for d in data])
            ids = np.frombuffer(b"".join(data), _ENTRY)["id"]
            if not len(ids):
                continue
            o = _draw(ids, other, salt)
            by = np.lexsort((o, ids))
            ids, other, o = ids[by], other[by], o[by]
            starts, ends = _bounds(ids)
            few = np.arange(len(ids)) - np.repeat(starts, ends - starts) < most
            yield pa.RecordBatch.from_arrays([pa.array(c[few]) for c in (ids, other, o)], names=["node", "other", "o"])

    return run


def _first(most: int):
    """The first ``most`` of each node's turned edges, as ids; and to each of those, that this node drew it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, drawn = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if node is not None:
                back = np.array(drawn, "<i8")
                yield _table([node], [_KIND_BACK], [node], [back.tobytes()])
                yield _table(back, np.full(len(back), _KIND_TOLD), np.full(len(back), node), [b""] * len(back))

        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, other = batch.column("node").to_numpy(), batch.column("other").to_numpy()
            starts, ends = _bounds(nodes)
            out = []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if nodes[a] != node:
                    out += close()
                    node, drawn = int(nodes[a]), []
                drawn += other[a : min(b, a + most - len(drawn))].tolist()
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        yield from close()

    return run


def _reverse(graph: DataFrame, most: int, salt: int) -> DataFrame:
    """Rows of kind back (a node's drawn neighbours-of) and told (who drew the node)."""
    turned = graph.select("node", "data").mapInArrow(_back(most, salt), "node long, other long, o long")
    return turned.repartition("node").sortWithinPartitions("node", "o").select("node", "other").mapInArrow(_first(most), _ROW)


def _known(rows) -> tuple[bytes | None, np.ndarray, np.ndarray, list[int]]:
    """A node's packed vector, its entries, its drawn neighbours-of, and who drew it."""
    vector, entries, back, told = None, np.zeros(0, _ENTRY), np.zeros(0, np.int64), []
    for kind, other, data in rows:
        if kind == _KIND_VECTOR:
            vector = data
        elif kind == _KIND_GRAPH:
            entries = np.frombuffer(data, _ENTRY)
        elif kind == _KIND_BACK:
            back = np.frombuffer(data, "<i8")
        else:
            told.append(other)
    return vector, entries, back, told


def _by_node(table: pa.Table):
    nodes, kinds, others, data = table.column("node").to_numpy(), table.column("kind").to_pylist(), table.column("other").to_pylist(), table.column("data").to_pylist()
    for a, b in zip(*_bounds(nodes), strict=True):
        yield int(nodes[a]), _known(zip(kinds[a:b], others[a:b], data[a:b], strict=True))


def _send(k: int):
    """A node's vector, and what a new neighbour must beat, to those that it drew and that drew it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "node"):
            to, who, what = [], [], []
            for node, (vector, entries, back, told) in _by_node(table):
                around = np.union1d(back, np.array(told, np.int64))
                if vector is not None and len(around):
                    beat = np.float32(entries["sim"].min() if len(entries) >= k else _NOTHING).tobytes()
                    to.append(around)
                    who.append(np.full(len(around), node))
                    what += [beat + vector] * len(around)
            if to:
                to, who = np.concatenate(to), np.concatenate(who)
                yield _table(to, np.full(len(to), _KIND_VECTOR), who, what)

    return run


def _meet(most: int):
    """Vectors that meet at a node, at most twice ``REVERSE``, propose themselves to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "node"):
            nodes, who, data = table.column("node").to_numpy(), table.column("other").to_numpy(), table.column("data").to_pylist()
            to, what = [], []
            for a, b in zip(*_bounds(nodes), strict=True):
                if b - a > 1:
                    x = unpack_vectors([d[4:] for d in data[a:b]])
                    beat = np.frombuffer(b"".join([d[:4] for d in data[a:b]]), "<f4")
                    sims = nearness(x, x)
                    np.fill_diagonal(sims, _NOTHING)
                    for node, found in zip(who[a:b].tolist(), _best(sims, who[a:b], most, beat), strict=True):
                        if found:
                            to.append(node)
                            what.append(found)
            if to:
                yield _table(to, np.full(len(to), _KIND_NEW), to, what)

    return run


def _streamed(rows: DataFrame) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node")


def build_graph(nodes: DataFrame, k: int = K, reverse: int = REVERSE, settled: float = SETTLED, orders: int = ORDERS) -> DataFrame:
    """(node, kind, other, data): each node's ``k`` best neighbours found, as entries (id, negated squared distance)."""
    spark = nodes.sparkSession
    vectors = nodes.select("node", F.lit(_KIND_VECTOR).alias("kind"), F.col("node").alias("other"), F.col("packed").alias("data"))
    dealt = nodes.select("node", "packed").mapInArrow(_deal(orders, PLANES), "o int, place double, node long, data binary")
    placed = dealt.repartitionByRange("o", "place").sortWithinPartitions("o", "place", "node")
    graph = materialize(_streamed(placed.mapInArrow(_compare_blocks(BLOCK, k), _ROW)).mapInArrow(_merge(k), _ROW), "graph")
    for turn in range(MOST_ROUNDS):
        sent = _streamed(vectors.union(graph).union(_reverse(graph, reverse, turn))).mapInArrow(_send(k), _ROW)
        proposed = _streamed(sent).mapInArrow(_meet(PROPOSALS), _ROW)
        now = materialize(_streamed(graph.union(proposed)).mapInArrow(_merge(k), _ROW), "graph")
        drop(graph)
        graph = now
        release(spark)
        fresh, entries = graph.agg(F.coalesce(F.sum("other"), F.lit(0)), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)) / _ENTRY.itemsize).first()
        if fresh <= settled * entries:
            return graph
    raise RuntimeError(f"the neighbour graph did not settle in {MOST_ROUNDS} rounds")


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_groups(batches, "node"):
        nodes, data = [], []
        for node, (_, entries, back, _) in _by_node(table):
            nodes.append(node)
            data.append(np.union1d(entries["id"], back).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], names=["node", "around"])


_STATE = np.dtype([("id", "<i8"), ("sim", "<f4"), ("asked", "i1")])


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each pool whose neighbours aren't known yet."""
    for batch in batches:
        data = batch.column("data").to_pylist()
        pools = np.frombuffer(b"".join(data), _STATE)
        query = np.repeat(batch.column("node").to_numpy(), [len(d) // _STATE.itemsize for d in data])
        some = pools["asked"] == 0
        yield pa.RecordBatch.from_arrays([pa.array(pools["id"][some]), pa.array(query[some])], names=["asked", "query"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column("around").to_pylist()
        found = np.frombuffer(b"".join(data), "<i8")
        query = np.repeat(batch.column("query").to_numpy(), [len(d) // 8 for d in data])
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(query)], names=["found", "query"])


def _answer(pool: int):
    """Pools after the vectors that were asked for have come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "node"):
            nodes, kinds, other, data = table.column("node").to_numpy(), table.column("kind").to_numpy(), table.column("other").to_numpy(), table.column("data").to_pylist()
            queries, pools = [], []
            for a, b in zip(*_bounds(nodes), strict=True):
                vector, state, new = None, np.zeros(0, _STATE), []
                for i in range(a, b):
                    if kinds[i] == _KIND_VECTOR:
                        vector = data[i]
                    elif kinds[i] == _KIND_GRAPH:
                        state = np.frombuffer(data[i], _STATE)
                    else:
                        new.append(i)
                if vector is None:
                    continue
                state = state.copy()
                state["asked"] = 1
                new = [i for i in new if other[i] not in set(state["id"].tolist())] if len(new) < 2 else np.array(new)[~np.isin(other[new], state["id"])].tolist()
                if new:
                    fresh = np.zeros(len(new), _STATE)
                    fresh["id"] = other[new]
                    fresh["sim"] = nearness(unpack_vectors([data[i] for i in new]), unpack_vectors([vector]))[:, 0]
                    state = np.concatenate([state, fresh])
                state = state[np.lexsort((state["id"], -state["sim"]))[:pool]]
                queries.append(int(nodes[a]))
                pools.append(state.tobytes())
            if queries:
                yield _table(queries, np.full(len(queries), _KIND_GRAPH), queries, pools)

    return run


def _seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A query that is a node starts from itself."""
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        state = np.zeros(len(nodes), _STATE)
        state["id"], state["sim"] = nodes, 0
        yield _table(nodes, np.full(len(nodes), _KIND_GRAPH), nodes, [s.tobytes() for s in state])


def greedy_search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, pool: int = POOL, reverse: int = REVERSE) -> DataFrame:
    """(node, data): the pool of each distinct query node; ``queries`` has column ``node``.

    A pool only gets better, so a node that left it doesn't come back, and the questions end.
    """
    spark = nodes.sparkSession
    packed = nodes.select("node", "packed")
    turned = _reverse(graph, reverse, MOST_ROUNDS).filter(F.col("kind") == _KIND_BACK)
    around = materialize(_streamed(graph.union(turned)).mapInArrow(_around, "node long, around binary"), "around")
    asking = materialize(packed.join(queries.select("node").distinct(), "node", "left_semi"), "asking")
    vectors = asking.select("node", F.lit(_KIND_VECTOR).alias("kind"), F.col("node").alias("other"), F.col("packed").alias("data"))
    pools = materialize(asking.select("node").mapInArrow(_seed, _ROW), "pools")
    while True:
        wanted = materialize(pools.select("node", "data").mapInArrow(_ask, "asked long, query long"), "wanted")
        counts = wanted.groupBy("asked").agg(F.count("*").alias("n")).withColumnRenamed("asked", "node")
        total = wanted.count()
        if not total:
            return pools.select("node", "data")
        # many queries ask the same hubs, and find the same nodes there
        near = join_split(wanted.withColumnRenamed("asked", "node"), around, ["node"], hot_keys(counts, ["node"], total))
        near = materialize(near.select("query", "around").mapInArrow(_spread, "found long, query long").distinct().withColumnRenamed("found", "node"), "near")
        hot = hot_keys(near.groupBy("node").agg(F.count("*").alias("n")), ["node"], near.count())
        came = join_split(near, packed, ["node"], hot).select(F.col("query").alias("node"), F.lit(_KIND_BACK).alias("kind"), F.col("node").alias("other"), F.col("packed").alias("data"))
        now = materialize(_streamed(vectors.union(pools).union(came)).mapInArrow(_answer(pool), _ROW), "pools")
        drop(wanted, near, pools)
        pools = now
        release(spark)


def _finalists(top: int):
    """The nodes of each pool that may be among the ``top``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, found = [], []
            for node, data in zip(batch.column("node").to_pylist(), batch.column("data").to_pylist(), strict=True):
                pool = np.frombuffer(data, _STATE)  # best first
                least = pool["sim"][min(top + 1, len(pool)) - 1] * (1 + MARGIN) - 1e-12
                n = max(top + SLACK, int((pool["sim"] >= least).sum()))
                found.append(pool["id"][:n])
                query.append(np.full(len(found[-1]), node))
            if query:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), pa.array(np.concatenate(found))], names=["query", "found"])

    return run


def _cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float64).reshape(batch.num_rows, -1) for c in ("q_exact", "exact"))
        # summed in the order of the components, so that the score doesn't hang on the width of vector instructions
        ab, aa, bb = (np.add.accumulate(x, axis=1)[:, -1] for x in (a * b, a * a, b * b))
        score = ab / (np.sqrt(aa) * np.sqrt(bb))
        rest = [c for c in batch.schema.names if c not in ("q_exact", "exact")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(np.clip(score, -1, 1))], names=[*rest, "score"])


def nearest(vectors: DataFrame, is_query: Column, top: int = 5, k: int = K, settled: float = SETTLED, pool: int = POOL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``top`` nearest found for each row where ``is_query`` (a condition on ``id_col``).

    Nearness is the largest cosine, computed on the original vectors in double precision; ties go to the smaller id;
    a row isn't its own neighbour, but its copies are. Null ids, and vectors that are null, empty, zero, or hold a null or
    non-finite component, take no part; vectors of different dimensions are searched apart. Rows repeated with the same id
    count once. With fewer candidates than ``top``, all are returned; an empty table gives an empty result; other columns
    are ignored.
    """
    nodes = make_nodes(vectors, top + 1, id_col, vector_col)
    ids = vectors.filter(is_query).select(vectors[id_col].cast("long").alias("query_id"), vectors[vector_col].cast("array<double>").alias("v"))
    ready = ids.select(F.col("query_id").alias("id"), "v").filter("id IS NOT NULL").mapInArrow(_prepare, "id long, exact binary, packed binary")
    ready = materialize(ready.select("id", "exact").dropDuplicates(["id", "exact"]), "ready")
    hot = hot_keys(ready.groupBy("exact").agg(F.count("*").alias("n")), ["exact"], ready.count())
    asked = materialize(join_split(ready, nodes.select("node", "exact"), ["exact"], hot).select(F.col("id").alias("query_id"), "node"), "asked")
    sizes = [r.n for r in nodes.select(F.octet_length("packed").alias("n")).distinct().orderBy("n").collect()]
    found = [_ranked(nodes.filter(F.octet_length("packed") == n), asked, top, k, settled, pool) for n in sizes] or [_ranked(nodes, asked, top, k, settled, pool)]
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    heat = hot_keys(asked.groupBy("node").agg(F.count("*").alias("n")), ["node"], asked.count())
    listed = join_split(asked, best, ["node"], heat)
    own = listed.select("query_id", F.slice(F.filter("l", lambda x: x["vec_id"] != F.col("query_id")), 1, top).alias("l"))
    return own.select("query_id", F.posexplode("l").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _ranked(nodes: DataFrame, asked: DataFrame, top: int, k: int, settled: float, pool: int) -> DataFrame:
    """(node, l): for each node that is asked for, the ``top`` + 1 nearest ids and their negated scores, its own ids among them."""
    queries = materialize(nodes.join(asked.select("node").distinct(), "node", "left_semi"), "queries")
    pools = greedy_search(nodes, build_graph(nodes, k=k, settled=settled), queries, pool=pool)
    best = materialize(pools.mapInArrow(_finalists(top), "query long, found long"), "best")
    hot = hot_keys(best.groupBy(F.col("found").alias("node")).agg(F.count("*").alias("n")), ["node"], best.count())
    scored = join_split(best.withColumnRenamed("found", "node"), nodes.select("node", "exact", "ids"), ["node"], hot).drop("node")
    # a query has a bounded number of finalists, each with a bounded number of ids
    both = scored.join(queries.select(F.col("node").alias("query"), F.col("exact").alias("q_exact")), "query").select("query", "ids", "q_exact", "exact")
    rated = both.mapInArrow(_cosine, "query long, ids array<long>, score double")
    each = rated.select("query", "score", F.explode("ids").alias("vec_id"))
    return each.groupBy(F.col("query").alias("node")).agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), F.col("vec_id")))), 1, top + 1).alias("l"))
