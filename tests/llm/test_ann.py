import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, node string, data int"


def brute(rows, queries, top):
    ids = [i for i, v in rows]
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    norms = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries:
        at = ids.index(q)
        s = x @ x[at] / norms / norms[at]
        out[q] = sorted(((-s[j], i) for j, i in enumerate(ids) if i != q))[:top]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x[100:160] = x[50]  # copies
    rows = [(i, x[i].tolist()) for i in range(3000)]
    found = ann.nearest(spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA), F.col("vec_id") % 50 == 0).collect()
    want = brute(rows, range(0, 3000, 50), 5)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 5 for q in want])
    assert hits >= 0.95
    for q, pairs in got.items():
        assert pairs == sorted(pairs, key=lambda p: (-p[0], p[1]))
        for score, i in pairs:
            a, b = x[q].astype(np.float64), x[i].astype(np.float64)
            assert abs(score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert [i for _, i in got[50]] == [100, 101, 102, 103, 104] and [i for _, i in got[100]] == [50, 101, 102, 103, 104]


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few_vectors(spark, n):
    rows = [(i, [float(i + 1), 1.0, 0.5], "n", 1) for i in range(n)]
    found = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(0, i, i) for i in range(1, n)]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "n", 1), (1, [1.0, 0.1], "n", 1), (2, None, "n", 1), (3, [0.0, 0.0], "n", 1), (4, [nan, 1.0], "n", 1), (5, [inf, 1.0], "n", 1), (6, [None, 1.0], "n", 1), (7, [], "n", 1), (8, [1.0, 2.0, 3.0], "n", 1), (None, [1.0, 0.0], "n", 1), (1, [1.0, 0.1], "n", 1), (50, None, "n", 1), (100, [1.0, 0.0], "n", 1), (150, [2.0, 0.2], "n", 1)]
    found = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    by = {}
    for r in sorted(found, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {0, 100, 150} and by[0][0] == 100 and set(by[0]) == {1, 100, 150} and by[150][0] == 1


def recall(spark, x, step, top=5):
    rows = [(i, v.tolist(), "n", 1) for i, v in enumerate(x)]
    found = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % step == 0, top=top).collect()
    want = brute([(i, v) for i, v in enumerate(x)], range(0, len(x), step), top)
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(got[q] & {i for _, i in want[q]}) / top for q in want])


@pytest.mark.parametrize("noise", [0.03, 0.00001])
def test_a_dense_group_larger_than_a_pool(spark, noise):
    """A third of the vectors are near copies, closer to each other than to all others."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[::3] = x[0] + noise * x[::3]
    assert recall(spark, x, 60) >= 0.95


def test_a_hub_meets_a_bounded_number(spark, monkeypatch):
    """Points around a centre all have it as a neighbour; no meeting grows with them."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 200))
    x = (1 + 0.3 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[0] = 1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    nodes = ann.make_nodes(frame, 6)
    graph = ann.build_graph(nodes)
    degree = {}
    for r in graph.collect():
        for i in np.frombuffer(r.data, ann._ENTRY)["id"].tolist():
            degree[i] = degree.get(i, 0) + 1
    assert max(degree.values()) > 1000
    kinds = {}
    for r in ann._reverse(graph, ann.REVERSE, 0).collect():
        n = len(r.data) // 8 if r.kind == ann._KIND_BACK else 1
        kinds[r.node, r.kind] = kinds.get((r.node, r.kind), 0) + n
    assert max(n for (_, k), n in kinds.items() if k == ann._KIND_BACK) == ann.REVERSE
    assert max(n for (_, k), n in kinds.items() if k == ann._KIND_TOLD) <= ann.K


def test_a_hot_vector_and_two_dimensions(spark, monkeypatch):
    from blockloom.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 5)
    monkeypatch.setattr(ann, "IDS_AT_ONCE", 50)
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 3000, 5)] + [(i, rng.standard_normal(3).tolist()) for i in range(1, 3000, 5)] + [(10_000 + i, rng.standard_normal(2).tolist()) for i in range(300)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {*range(0, 3000, 50), *range(10_000, 10_300, 50)}
    for q, pairs in got.items():
        if q < 3000:
            assert [i for i, _ in pairs] == [i for i in range(0, 35, 5) if i != q][:5] and all(abs(s - 1) < 1e-12 for _, s in pairs)
        else:
            assert len(pairs) == 5 and all(i >= 10_000 for i, _ in pairs)
    vectors = {i: np.array(v) for i, v in rows if i >= 10_000}
    for q in range(10_000, 10_300, 50):
        a = vectors[q]
        want = sorted((-float(a @ v) / np.linalg.norm(a) / np.linalg.norm(v), i) for i, v in vectors.items() if i != q)[:5]
        assert [i for i, _ in got[q]] == [i for _, i in want]
