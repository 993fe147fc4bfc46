"""The SQL of operators beside SQL of their own, on the corpus with every edge case, and XXH64 against its library."""

import random

import duckdb
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from blockloom.llm import simhash, sketch, sql, suffix_dedup
from blockloom.llm.ann import nearest
from blockloom.llm.queries import ORACLES


def test_xxh64_of_any_length_and_seed():
    rnd = random.Random(3)
    rows = [(rnd.choice([0, 42, (1 << 64) - 1, rnd.getrandbits(64)]), rnd.randbytes(n)) for n in range(1, 140) for _ in range(2)]
    con = duckdb.connect()
    con.register("given", pa.table({"seed": pa.array([s for s, _ in rows], pa.uint64()), "x": [b.hex().upper() for _, b in rows]}))
    got = con.sql(f"WITH s AS (SELECT seed::UHUGEINT AS seed, x FROM given), {sql.xxh64('s', 'z')} SELECT seed, x, h FROM z").fetchall()
    assert {(int(s), bytes.fromhex(x)): h for s, x, h in got} == {(s, b): xxhash.xxh64_intdigest(b, s) for s, b in rows}


@pytest.mark.parametrize(
    "run,text",
    [
        (lambda d: suffix_dedup.suffix_dedup(d, length=40, digest=True), sql.repeats(40)),
        (lambda d: simhash.simhash_groups(d, words=3, distance=2).select("doc_id", "fingerprint", "component_id"), sql.simhash(3, 2)),
        (sketch.edited_fingerprints, sql.sketches(128, 5)),
    ],
    ids=["repeats", "simhash", "sketches"],
)
def test_operators_equal_sql(docs, corpus, run, text):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in corpus], pa.int64()), "text": pa.array([r[1] for r in corpus], pa.string())}))
    found, want = run(docs), con.sql(text)
    columns = sorted(want.columns)
    assert columns == sorted(found.columns)
    rows = sorted(str(tuple(r)) for r in found.select(columns).collect())
    assert len(rows) == len(corpus) and rows == sorted(map(str, want.select(*columns).fetchall()))


def test_nearest_equals_sql(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(12)] + [(400, None), (450, [0.0] * 16), (500, [float("nan")] * 16), (550, [None] + [1.0] * 15), (600, [])]
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [i for i, _ in rows], "embedding": pa.array([v for _, v in rows], pa.list_(pa.float64()))}))
    want = con.sql(sql.nearest(50, 5)).fetchall()
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, top=5)
    assert len(want) == 35 and sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)


def test_registered():
    assert ORACLES["op2_suffix_dedup"] == sql.repeats(400) and ORACLES["op3_simhash"] == sql.simhash(3, 2) and ORACLES["op10_fingerprints"] == sql.sketches(128, 5)
