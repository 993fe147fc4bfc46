import pyarrow as pa
from pyspark.sql import functions as F

from blockloom.llm import common, queries


def test_tables_go_to_the_shared_folder(spark):
    folder = common.shared_dir(spark)
    frame = spark.range(7).withColumn("x", F.lit("y"))
    again = common.materialize(frame, "test")
    assert again.schema.simpleString() == frame.schema.simpleString() and again.count() == 7
    assert all(f.startswith(folder) or f.startswith("file:") for f in again.inputFiles())
    assert common.materialize(frame.filter("id < 0"), "test").count() == 0


def test_broadcast_only_what_is_small(spark):
    plan = lambda t: t._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(common.broadcast_if_small(spark.range(5), 5)).lower()
    assert "broadcast" not in plan(common.broadcast_if_small(spark.range(6), 5)).lower()


def test_short_batches():
    seen = []

    def spy(batches):
        for b in batches:
            seen.append(b.num_rows)
            yield b

    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], names=["x"])
    assert sum(b.num_rows for b in common.lean(spy, 4)(iter([batch]))) == 10 and seen == [4, 4, 2]


def test_each_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
