from blockloom.operators import codec
from blockloom.sources.ranges import RangeSource


def test_byte_ranges_of_files(spark, tmp_path):
    spark.dataSource.register(RangeSource)
    data = bytes(range(256)) * 41 + b"tail"
    for name, content in (("a", data), ("empty", b""), ("b", b"x" * 1000)):
        (tmp_path / name).write_bytes(content)
    paths = ",".join(str(tmp_path / n) for n in ("a", "empty", "b"))
    rows = spark.read.format("blockloom_bytes").option("block_size", "500").option("blocks_per_partition", "4").load(paths)
    assert rows.rdd.getNumPartitions() == 7
    found = sorted(codec.decode_blocks(codec.encode_blocks(rows)).collect(), key=lambda r: (r.object_id, r.block_id))
    assert b"".join(bytes(r.payload) for r in found if r.object_id.endswith("a")) == data
    assert [r.raw_size for r in found if r.object_id.endswith("b")] == [500, 500]
