"""Containers as DataFrames: writing, reading, and a data source with one partition a range of blocks."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from blockloom.functions import container, parse
from blockloom.functions.entropy import unpack_streams
from blockloom.functions.tokens import BadData, decode
from blockloom.operators.blocks import BLOCK_SIZE
from blockloom.operators.codec import BAD_DATA, NULL, OK

LAYOUTS = {"indexed": container.write_indexed, "interleaved": container.write_interleaved, "chunked": container.write_chunked}


def _write(layout: str, block_size: int, level: int):
    write = LAYOUTS[layout]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for payload in batch.column("payload").to_pylist():
                cut = [payload[a : a + block_size] for a in range(0, len(payload), block_size)] if payload is not None else []
                out.append(None if payload is None else write(payload, block_size, [parse.encode(b, level) for b in cut]))
            yield pa.RecordBatch.from_arrays([batch.column("object_id"), pa.array(out, pa.binary())], names=["object_id", "container"])

    return run


def to_containers(objs: DataFrame, layout: str = "chunked", block_size: int = BLOCK_SIZE, level: int = 2) -> DataFrame:
    """(object_id, container BINARY) of (object_id, payload); null stays null. For objects that fit a row."""
    kind = objs.schema["object_id"].dataType.simpleString()
    return objs.select("object_id", "payload").mapInArrow(_write(layout, block_size, level), f"object_id {kind}, container binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for data in batch.column("container").to_pylist():
            if data is None:
                row = (None, None, None, NULL)
            else:
                try:
                    m = container.manifest(data)
                    row = (m.layout, m.orig_size, container.read_object(data), OK)
                except BadData:
                    row = (None, container.decoded_size(data), None, BAD_DATA)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("object_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["object_id", "layout", "orig_size", "payload", "status"])


def from_containers(containers: DataFrame) -> DataFrame:
    """(object_id, layout, orig_size, payload, status) of (object_id, container); damaged ones have a null payload."""
    kind = containers.schema["object_id"].dataType.simpleString()
    return containers.select("object_id", "container").mapInArrow(_read, f"object_id {kind}, layout string, orig_size long, payload binary, status string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(object_id = file path, container) of container files, through Spark's own reader."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("object_id"), F.col("content").alias("container"))


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int, place: int | None):
        super().__init__((path, first, last))
        self.path, self.first, self.last, self.place = path, first, last, place


def _place(path: str):
    """(file system, path there) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _open(path: str):
    system, place = _place(path)
    return system.open_input_file(place)


def files_of(paths: str) -> list[str]:
    """The files of comma-separated paths; a folder stands for its own files, but for hidden ones."""
    from pyarrow import fs

    out = []
    for path in filter(None, paths.split(",")):
        system, place = _place(path)
        if system.get_file_info(place).type == fs.FileType.Directory:
            names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(place)) if i.type == fs.FileType.File)
            out += [f"{path.rstrip('/')}/{n}" for n in names if n[0] not in "_."]
        else:
            out.append(path)
    return out


def _reads(f):
    """read(at, n) of an open file."""

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return read


class _Reader(DataSourceReader):
    """Reads block rows; a partition holds ``blocks_per_partition`` blocks of one file, and reads their bytes alone."""

    def __init__(self, options: dict):
        self.paths = files_of(options.get("path", options.get("paths", "")))
        self.per = int(options.get("blocks_per_partition", "64"))
        if self.per < 1:
            raise ValueError("blocks_per_partition must be positive")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            with _open(path) as f:
                read = _reads(f)
                m = container.manifest(read(0, container.HEADER.size))
                places = container.record_places(read, m.num_blocks, self.per) if m.layout == "chunked" else None
            out += [_Range(path, a, min(m.num_blocks, a + self.per), places[a // self.per] if places else None) for a in range(0, m.num_blocks, self.per)]
        return out

    def read(self, partition: _Range):
        with _open(partition.path) as f:
            for i, size, b in container.read_range(_reads(f), partition.first, partition.last, partition.place):
                payload = None
                if b is not None:
                    with contextlib.suppress(BadData):
                        payload = decode(b.raw_size, *(unpack_streams(b.streams) if b.packed else b.streams))
                yield (partition.path, i, size, payload, BAD_DATA if payload is None else OK)


class _Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class _Writer(DataSourceWriter):
    """Writes a file an object; files take their names when all tasks have ended."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.layout = options.get("layout", "chunked")
        self.block_size = int(options.get("block_size", BLOCK_SIZE))
        if self.layout != "raw" and self.layout not in LAYOUTS:
            raise ValueError(f"no layout {self.layout}")

    def write(self, rows) -> WriterCommitMessage:
        import uuid
        from urllib.parse import quote

        from blockloom.functions.api import compress

        system, base = _place(self.path)
        aside = f"{base}/_temporary-{uuid.uuid4().hex}"
        system.create_dir(aside, recursive=True)
        moves = []
        for row in rows:
            if row["payload"] is None:
                continue
            if row["object_id"] is None:
                raise ValueError("an object without an id has no file name")
            data = bytes(row["payload"])
            name = quote(str(row["object_id"]), safe="")
            with system.open_output_stream(f"{aside}/{name}") as f:
                f.write(data if self.layout == "raw" else compress(data, block_size=self.block_size, layout=self.layout))
            moves.append((f"{aside}/{name}", f"{base}/{name}"))
        return _Written(moves)

    def commit(self, messages) -> None:
        system, _ = _place(self.path)
        moves = [pair for m in messages if m for pair in m.moves]
        if len({b for _, b in moves}) < len(moves):
            self._tidy()
            raise ValueError("several objects have the same id")
        for a, b in moves:
            system.move(a, b)
        self._tidy()

    def abort(self, messages) -> None:
        self._tidy()

    def _tidy(self) -> None:
        from pyarrow import fs

        system, base = _place(self.path)
        for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if info.base_name.startswith("_temporary-"):
                system.delete_dir(info.path)


class ContainerSource(DataSource):
    """``spark.read.format("blockloom").load(path)``: (object_id, block_id, raw_size, payload, status) of container files.

    Option ``path``: files or folders, comma-separated; ``blocks_per_partition``: 64 by default. A partition reads the
    bytes of its blocks and no others. A damaged block has a null payload and status BAD_DATA; the layouts have a
    checksum for the whole object only, which ``from_containers`` verifies.
    ``df.write.format("blockloom").save(path)``: a file for each row of (object_id, payload), named by its id; option
    ``layout``: chunked (default), indexed, interleaved, or raw for the bytes alone; ``block_size``. Null payloads
    make no file; a null or repeated id is an error.
    Register it once a session: ``spark.dataSource.register(ContainerSource)``.
    """

    @classmethod
    def name(cls) -> str:
        return "blockloom"

    def schema(self) -> str:
        return "object_id string, block_id long, raw_size long, payload binary, status string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)
