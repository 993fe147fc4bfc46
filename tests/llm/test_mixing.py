from collections import Counter

import pytest
from pyspark.sql import functions as F

from blockloom.llm import mixing


def test_taken_words_come_near_the_targets(spark):
    rows = spark.range(0, 20000).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat('w ', cast(1 + pmod(xxhash64(id), 40) as int))").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
        F.lit(1).alias("size"),
    )
    found = mixing.mix(rows).collect()
    assert len(found) == 20000
    taken, target, size = Counter(), {}, Counter()
    for r in found:
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    assert abs(sum(target.values()) / sum(size.values()) - 1.5) < 1e-9
    for s, t in target.items():
        assert t <= 2 * size[s] * (1 + 1e-12) and abs(taken[s] / t - 1) < 0.1
    again = {(r.doc_id, r.taken) for r in mixing.mix(rows.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in found}


def test_edges(docs, none, corpus):
    found = mixing.mix(docs).collect()
    assert len(found) == len(corpus) and mixing.mix(none).count() == 0
    by = {r.doc_id: r for r in found}
    assert by[2000].size == 0 and by[2000].taken == 0 and by[2004].size == 2


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 0}, {"a": 1, "b": 1000, "c": 5, None: 7}, {"a": 100, "b": 100}])
def test_water_filling(spark, sizes):
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    from test_pipeline import water

    want = water(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_columns_of_any_name_come_through(spark):
    names = ["doc_id", "text", "source", "_copies", "_copy", "_id", "_size", "_target", "_source", "_source_size", "_key", "_salt", "_salts", "c0"]
    rows = [(i, f"a b {i}", f"s{i % 3}", *range(i, i + len(names) - 3)) for i in range(200)]
    frame = spark.createDataFrame(rows, names)
    found = mixing.emit_mix(frame)
    assert found.columns == names and found.schema == frame.schema
    got = Counter(tuple(r) for r in found.collect())
    assert set(got) <= set(rows) and len(got) > 100
    assert {r.doc_id: r.copies for r in mixing.mix(frame).collect() if r.copies} == {k[0]: n for k, n in got.items()}
    assert mixing.emit_mix(frame.filter("doc_id < 0")).count() == 0


def test_more_sources_than_a_broadcast_takes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "broadcast_if_small", lambda table: table)
    rows = spark.range(0, 6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 9 as int))").alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id"))).alias("source"))
    found = {r.doc_id: tuple(r) for r in mixing.mix(rows).collect()}
    monkeypatch.undo()
    assert found == {r.doc_id: tuple(r) for r in mixing.mix(rows).collect()} and len(found) == 6000


def test_many_sources_get_their_weights_in_order(spark):
    from test_pipeline import water

    sizes = {f"s{i * 7919 % 5000:05d}": i * 31 % 997 for i in range(3000)} | {None: 50, "é": 3, "\U0001f600": 4, "": 9}
    frame = spark.createDataFrame([*sizes.items()], "source string, source_size long").repartition(9)
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    want = water(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
