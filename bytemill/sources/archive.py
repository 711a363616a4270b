"""A Spark data source for archive files, and one for blocks of any file, both by ranged reads.

`spark.read.format("bytemill_archive").option("layout", "checked").load(path or folder)` has a row for each chunk. Planning lists files and, of
those above TASK_BYTES, reads the header of fixed size; tasks read the entries of the tables that are theirs, and the payload ranges
of their chunks. Option payload=false leaves the payloads out, so nothing but tables is read; filters on algorithm and chunk_idx
are applied to the tables. Paths must be readable where driver and executors run.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from bytemill.functions import codecs
from bytemill.functions.layouts import LAYOUTS, Layout, restore

#: Compressed bytes that one task reads, more or less.
TASK_BYTES = 32 << 20
_COMPARE = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}


def listed(path: str) -> list[str]:
    """The files of a path that is a file or a folder."""
    path = path.removeprefix("file://").removeprefix("file:")
    return sorted(str(p) for p in Path(path).rglob("*") if p.is_file() and not p.name.startswith(".")) if os.path.isdir(path) else [path]


def read_tables(path: str, layout: Layout) -> tuple[dict, list[dict]]:
    """Header and entries of an archive file, whose payloads stay unread."""
    with open(path, "rb") as f:
        header = layout.read_header(f.read(layout.header.size))
        return header, layout.read_table(f.read(header["chunks"] * layout.entry.size), header["chunks"])


class _Entries(InputPartition):
    """Entries first to last of an archive's table; all of them if last is None."""

    def __init__(self, path: str, first: int = 0, last: int | None = None):
        self.path, self.first, self.last = path, first, last


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.layout, self.payload, self.path = LAYOUTS[options.get("layout", "checked")], options.get("payload", "true").lower() == "true", options["path"]
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _COMPARE and f.attribute in (("algorithm",), ("chunk_idx",)):
                self.filters.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for path in listed(self.path):
            size = os.path.getsize(path)
            if size <= TASK_BYTES:
                out.append(_Entries(path))
                continue
            with open(path, "rb") as f:
                n = self.layout.read_header(f.read(self.layout.header.size))["chunks"]
            step = max(1, n * TASK_BYTES // size)
            out += [_Entries(path, i, min(n, i + step)) for i in range(0, n, step)]
        return out or [_Entries("")]

    def read(self, partition: _Entries) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            n = self.layout.read_header(f.read(self.layout.header.size))["chunks"]
            first, last = partition.first, n if partition.last is None else partition.last
            f.seek(self.layout.header.size + first * self.layout.entry.size)
            table = self.layout.read_table(f.read((last - first) * self.layout.entry.size), last - first)
            base = self.layout.payload_at(n)
            for i, e in enumerate(table, first):
                try:
                    name = codecs.name_of(e["algorithm_id"])
                except KeyError as problem:
                    raise self.layout.error(f"{partition.path}: {problem}") from problem
                known = {"algorithm": name, "chunk_idx": i}
                if not all(_COMPARE[kind](known[c], v) for c, kind, v in self.filters):
                    continue
                row = (partition.path, i, name, e["length"], e["compressed"], e["offset"], e["checksum"].hex() if e["checksum"] else None)
                if self.payload:
                    f.seek(base + e["offset"])
                    data = f.read(e["compressed"])
                    if len(data) < e["compressed"]:
                        raise self.layout.error("payload ends behind the archive")
                    row = (*row, restore(self.layout, e, data))
                yield row


class ArchiveSource(DataSource):
    """Rows: path, chunk_idx, algorithm, original_length, compressed_length, payload_offset, checksum and, unless payload=false, content."""

    @classmethod
    def name(cls) -> str:
        return "bytemill_archive"

    def schema(self) -> str:
        base = "path string, chunk_idx int, algorithm string, original_length long, compressed_length long, payload_offset long, checksum string"
        return base + (", content binary" if self.options.get("payload", "true").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class BlockReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block = options["path"], int(options.get("block", 4096))
        if self.block <= 0:
            raise ValueError("block must be above 0")

    def partitions(self) -> Sequence[InputPartition]:
        step = max(self.block, TASK_BYTES // self.block * self.block)
        return [_Range(p, a, min(a + step, n)) for p in listed(self.path) for n in (os.path.getsize(p),) for a in range(0, n, step)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if partition.end <= partition.begin:
            return
        with open(partition.path, "rb") as f:
            f.seek(partition.begin)
            for at in range(partition.begin, partition.end, self.block):
                data = f.read(min(self.block, partition.end - at))
                yield partition.path, at // self.block, at, len(data), data


class BlockSource(DataSource):
    """Fixed-size chunks of files of any size: path, chunk_idx, offset, length, content. Option block: bytes of one."""

    @classmethod
    def name(cls) -> str:
        return "bytemill_blocks"

    def schema(self) -> str:
        return "path string, chunk_idx int, offset long, length int, content binary"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(BlockSource)
