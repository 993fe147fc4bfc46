import random

import pytest

from blockloom.functions import container, parse
from blockloom.functions.tokens import BadData

WRITERS = [container.write_indexed, container.write_interleaved, container.write_chunked]


def written(writer, payload, size=512):
    return writer(payload, size, [parse.encode(payload[a : a + size]) for a in range(0, len(payload), size)])


def sample(n, seed=0):
    rnd = random.Random(seed)
    return bytes(rnd.choice(b"abcd\0\xff") for _ in range(n))


@pytest.mark.parametrize("writer", WRITERS)
@pytest.mark.parametrize("n", [0, 1, 2, 5, 511, 512, 513, 5000])
def test_roundtrip(writer, n):
    payload = sample(n)
    data = written(writer, payload)
    assert container.read_object(data) == payload and container.decoded_size(data) == n
    m = container.manifest(data)
    assert m.num_blocks == -(-n // 512) and m.block_size == 512 and m.xxh3 is not None


@pytest.mark.parametrize("writer", WRITERS)
def test_any_damage_is_noticed(writer):
    payload = sample(1300, 1)
    data = written(writer, payload)
    rnd = random.Random(3)
    unseen = 0
    for at in range(len(data)):
        hurt = bytearray(data)
        hurt[at] ^= 1 << rnd.randrange(8)
        try:
            unseen += container.read_object(bytes(hurt)) != payload
        except BadData:
            pass
    assert not unseen
    for cut in range(0, len(data) - 16 * (writer is container.write_chunked), 7):
        with pytest.raises(BadData):
            container.read_object(data[:cut])


@pytest.mark.parametrize("writer", WRITERS)
def test_single_blocks(writer):
    payload = sample(3000, 2)
    found = container.read_blocks(written(writer, payload), range(2, 4))
    assert [i for i, _ in found] == [2, 3] and [b.raw_size for _, b in found] == [512, 512]


def test_other_magic():
    payload = sample(100)
    data = container.write_chunked(payload, 64, [parse.encode(payload[:64]), parse.encode(payload[64:])], b"OTHER\0\0\0")
    with pytest.raises(BadData):
        container.read_object(data)
    assert container.read_object(data, container.Magic(chunked=b"OTHER\0\0\0")) == payload


def test_data_source(spark, tmp_path):
    from pyspark.sql import functions as F

    from blockloom.sources.container import ContainerSource, from_containers, read_files, to_containers

    spark.dataSource.register(ContainerSource)
    for writer in WRITERS:
        payload = sample(5000, 4)
        path = tmp_path / f"{writer.__name__}.bin"
        path.write_bytes(written(writer, payload))
        rows = spark.read.format("blockloom").option("blocks_per_partition", "3").load(str(path))
        assert rows.rdd.getNumPartitions() == 4
        assert b"".join(r.payload for r in sorted(rows.collect(), key=lambda r: r.block_id)) == payload
        assert rows.filter("block_id = 9").first().raw_size == 392
        back = from_containers(read_files(spark, str(path))).first()
        assert bytes(back.payload) == payload and back.status == "OK"
    objs = spark.createDataFrame([(1, b"abc" * 500), (2, None), (3, b"")], "object_id long, payload binary")
    for layout in ("indexed", "interleaved", "chunked"):
        got = {r.object_id: r for r in from_containers(to_containers(objs, layout, 64)).collect()}
        assert bytes(got[1].payload) == b"abc" * 500 and got[2].status == "NULL" and got[3].payload == b"" and got[3].status == "OK"
    assert from_containers(objs.select("object_id", F.lit(b"junk").alias("container"))).filter("status != 'BAD_DATA'").count() == 0


def test_functions_of_bytes_and_columns(spark):
    from pyspark.sql import functions as F

    from blockloom.functions import api

    payload = sample(3000, 7)
    for layout in api.WRITERS:
        assert api.decompress(api.compress(payload, block_size=700, layout=layout), 3000) == payload
        with pytest.raises(BadData):
            api.decompress(api.compress(payload, block_size=700, layout=layout), 2999)
    frame = spark.createDataFrame([(1, payload), (2, None), (3, b"")], "id long, x binary").withColumn("z", api.compress_column(F.col("x"), block_size=512))
    rows = {r.id: r for r in frame.select("id", "x", api.decompress_column(F.col("z")).alias("y"), api.decompress_column(F.substring("z", 1, 40)).alias("bad")).collect()}
    assert bytes(rows[1].y) == payload and rows[2].y is None and rows[3].y == b"" and rows[1].bad is None


@pytest.mark.parametrize("layout", ["raw", "indexed", "interleaved", "chunked"])
def test_data_source_writes_a_file_an_object(spark, tmp_path, layout):
    from blockloom.sources.container import ContainerSource

    spark.dataSource.register(ContainerSource)
    objs = {"a/b": sample(2000, 1), "c": b"", "d e": sample(700, 2)}
    frame = spark.createDataFrame([*objs.items(), ("none", None)], "object_id string, payload binary")
    frame.repartition(3).write.format("blockloom").option("layout", layout).option("block_size", "512").mode("append").save(str(tmp_path / "out"))
    files = {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()}
    assert set(files) == {"a%2Fb", "c", "d%20e"}
    read = (lambda x: x) if layout == "raw" else container.read_object
    assert [read(files[n]) for n in ("a%2Fb", "c", "d%20e")] == list(objs.values())


@pytest.mark.parametrize("writer", WRITERS)
def test_ranges_read_their_own_bytes_alone(writer):
    payload = sample(40_000, 9)
    data = written(writer, payload)
    m = container.manifest(data)
    seen = 0

    def read(at, n):
        nonlocal seen
        seen += n
        return data[at : at + n]

    from blockloom.functions.entropy import unpack_streams
    from blockloom.functions.tokens import decode

    places = container.record_places(read, m.num_blocks, 5) if m.layout == "chunked" else None
    for first in range(0, m.num_blocks, 5):
        seen, last = 0, min(m.num_blocks, first + 5)
        found = list(container.read_range(read, first, last, places[first // 5] if places else None))
        assert [i for i, _, _ in found] == list(range(first, last))
        for i, size, b in found:
            whole = decode(b.raw_size, *(unpack_streams(b.streams) if b.packed else b.streams))
            assert whole == payload[i * m.block_size : (i + 1) * m.block_size] and len(whole) == size
        if m.layout != "indexed":  # whose streams are packed as a whole
            assert seen < len(data) / 3


def test_a_damaged_block_of_a_file_is_told_apart(spark, tmp_path):
    from blockloom.sources.container import ContainerSource

    spark.dataSource.register(ContainerSource)
    writer = next(w for w in WRITERS if "interleaved" in w.__name__)
    data = bytearray(written(writer, sample(5000, 4)))
    data[-3] ^= 0xFF
    (tmp_path / "hurt").write_bytes(bytes(data))
    rows = {r.block_id: r for r in spark.read.format("blockloom").option("blocks_per_partition", "2").load(str(tmp_path)).collect()}
    last = max(rows)
    assert rows[last].status == "BAD_DATA" and rows[last].payload is None and all(rows[i].status == "OK" for i in rows if i != last)


@pytest.mark.parametrize("ids", [["a", "a"], ["a", None]])
def test_a_repeated_or_null_id_is_an_error(spark, tmp_path, ids):
    from blockloom.sources.container import ContainerSource

    spark.dataSource.register(ContainerSource)
    frame = spark.createDataFrame([(i, b"x") for i in ids], "object_id string, payload binary")
    with pytest.raises(Exception, match="same id|without an id"):
        frame.write.format("blockloom").mode("append").save(str(tmp_path / "out"))
