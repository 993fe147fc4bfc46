import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators import blocks as B
from blockloom.operators import codec

SCHEMA = "object_id string, payload binary"


def objects():
    rnd = random.Random(9)
    rows = [(f"n{n}", bytes(rnd.choice(b"ab\0 ") for _ in range(n))) for n in (0, 1, 2, 5, 14, 15, 63, 64, 65, 128, 1000)]
    rows += [("run", b"z" * 5000), ("periodic", b"abcdefg" * 300), ("random", rnd.randbytes(3000)), ("unicode", "é你\U0001f600".encode() * 100), ("all", bytes(range(256)) * 4), ("null", None)]
    return rows


@pytest.fixture(scope="module")
def objs(spark):
    return spark.createDataFrame(objects(), SCHEMA)


@pytest.mark.parametrize("size,entropy,level", [(1, False, 2), (7, True, 1), (64, True, 2), (64, False, 0), (1 << 20, True, 2)])
def test_roundtrip(objs, size, entropy, level):
    got = {r.object_id: bytes(r.payload) for r in codec.roundtrip(objs, size, level, entropy).collect()}
    assert got == {k: v for k, v in objects() if v is not None}


def test_partitions_make_no_difference(objs):
    seen = set()
    for n in (1, 2, 4, 8):
        rows = codec.encode_blocks(B.split_blocks(objs.repartition(n), 64)).collect()
        seen.add(tuple(sorted((r.object_id, r.block_id, bytes(r.lit), bytes(r.cmd), bytes(r.xxh3)) for r in rows)))
    assert len(seen) == 1


@pytest.mark.parametrize("entropy", [True, False])
@pytest.mark.parametrize("stream", B.STREAMS)
def test_a_flipped_byte_in_any_stream_is_noticed(spark, objs, stream, entropy):
    """Decoding really runs: damage to each stream shows."""
    encoded = codec.encode_blocks(B.split_blocks(objs, 256), entropy=entropy)
    hurt = encoded.withColumn(stream, F.concat(F.substring(stream, 1, 1), F.unhex(F.lit("7f7f7f")), F.substring(F.col(stream), 5, 1 << 30))).filter(F.octet_length(stream) > 6)
    changed = hurt.exceptAll(encoded).cache()
    assert changed.count() > 0 or not entropy
    assert codec.decode_blocks(changed, entropy).filter("status = 'OK'").count() == 0


def test_quarantine_keeps_whole_objects_apart(objs):
    encoded = codec.encode_blocks(B.split_blocks(objs, 64), entropy=False)
    hurt = encoded.withColumn("xxh3", F.when((F.col("object_id") == "run") & (F.col("block_id") == 3), F.unhex(F.lit("00" * 8))).otherwise(F.col("xxh3")))
    good, bad = codec.quarantine(codec.decode_blocks(hurt, entropy=False))
    assert [tuple(r) for r in bad.collect()] == [("run", "BAD_CHECKSUM")]
    assert good.filter("object_id = 'run'").count() == 0 and good.filter("object_id = 'n1000'").count() == 16


def test_metrics(objs):
    encoded = codec.encode_blocks(B.split_blocks(objs, 1024)).cache()
    m = codec.compression_metrics(encoded).first()
    assert m.raw_bytes == sum(len(v or b"") for _, v in objects())
    packed = m.lit_bytes + m.off_bytes + m.len_bytes + m.cmd_bytes
    assert abs(m.ratio - m.raw_bytes / packed) < 1e-12 and abs(m.bpb - 8 * packed / m.raw_bytes) < 1e-12


def test_nothing_in_nothing_out(objs):
    none = objs.filter("object_id = 'absent'")
    assert codec.roundtrip(none).count() == 0
    assert B.split_blocks(objs.filter("object_id IN ('n0', 'null')"), 8).count() == 0
    with pytest.raises(ValueError):
        B.split_blocks(objs, 0)


def test_random_access_reads_only_the_streams_it_needs(spark, objs, tmp_path):
    path = str(tmp_path / "encoded")
    codec.encode_blocks(B.split_blocks(objs, 64)).write.parquet(path)
    one = spark.read.parquet(path).filter("object_id = 'n1000' AND block_id = 3")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(block_id,3)" in plan
    row = codec.decode_blocks(one).first()
    assert bytes(row.payload) == dict(objects())["n1000"][192:256]
    sizes = spark.read.parquet(path).select("object_id", F.octet_length("cmd"))
    assert "lit" not in sizes._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_streams(spark, objs, tmp_path):
    from blockloom.streaming.stream import decode_stream, encode_stream, write_stream

    source, out, state = (str(tmp_path / x) for x in ("source", "out", "state"))
    objs.limit(9).write.parquet(source)
    want = {}
    for _ in range(2):
        arriving = spark.readStream.schema(SCHEMA).parquet(source)
        write_stream(decode_stream(encode_stream(arriving, 64)), out, state).awaitTermination()
        found = spark.read.parquet(out).collect()
        want = {(r.object_id, a // 64) for r in spark.read.parquet(source).collect() for a in range(0, len(r.payload or b""), 64)}
        assert {(r.object_id, r.block_id) for r in found} == want and len(found) == len(want)
        assert all(r.status == "OK" for r in found)
        objs.filter("object_id IN ('run', 'unicode')").write.mode("append").parquet(source)


def test_assembling_tells_damaged_and_short_objects(objs):
    decoded = codec.decode_blocks(codec.encode_blocks(B.split_blocks(objs, 64), entropy=False), entropy=False)
    hurt = decoded.withColumn("status", F.when((F.col("object_id") == "run") & (F.col("block_id") == 3), F.lit(codec.BAD_DATA)).otherwise(F.col("status")))
    rows = {r.object_id: r for r in codec.assembled(hurt.filter("object_id != 'n1000' OR block_id != 5")).collect()}
    assert rows["run"].status == codec.BAD_DATA and rows["run"].payload is None
    assert rows["n1000"].status == codec.MISSING and rows["n1000"].payload is None
    assert {r.status for k, r in rows.items() if k not in ("run", "n1000")} == {codec.OK}


def test_a_round_trip_runs_its_kernels_once(objs):
    plan = codec.roundtrip(objs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3  # encode, decode, join
