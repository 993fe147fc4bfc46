"""Files of any size as block rows: a data source with one partition a range of bytes."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from blockloom.operators.blocks import BLOCK_SIZE
from blockloom.sources.container import _open, files_of


class _Bytes(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = files_of(options.get("path", ""))
        self.block_size = int(options.get("block_size", BLOCK_SIZE))
        self.per = int(options.get("blocks_per_partition", "64"))
        if self.block_size < 1 or self.per < 1:
            raise ValueError("block_size and blocks_per_partition must be positive")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            with _open(path) as f:
                count = -(-f.size() // self.block_size)
            out += [_Bytes(path, a, min(count, a + self.per)) for a in range(0, count, self.per)]
        return out

    def read(self, partition: _Bytes):
        with _open(partition.path) as f:
            for i in range(partition.first, partition.last):
                f.seek(i * self.block_size)
                data = f.read(self.block_size)
                yield (partition.path, i, len(data), data)


class RangeSource(DataSource):
    """``spark.read.format("blockloom_bytes").load(path)``: (object_id, block_id, raw_size, payload) of plain files.

    A task reads ``blocks_per_partition`` (64) blocks of ``block_size`` bytes (1 MiB) and holds one at a time, so a
    file may be larger than any executor. Option ``path``: files or folders, comma-separated; empty files have no
    blocks. Register it once a session: ``spark.dataSource.register(RangeSource)``.
    """

    @classmethod
    def name(cls) -> str:
        return "blockloom_bytes"

    def schema(self) -> str:
        return "object_id string, block_id long, raw_size long, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
