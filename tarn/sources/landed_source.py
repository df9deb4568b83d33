"""Landed pages and documents as a Spark data source: planned partitions, pushed filters, offsets.

``spark.dataSource.register(LandedSource)``, then ``spark.read.format("landed")`` or
``spark.readStream.format("landed")`` with the options

- ``path``: a file or folder of any file system that Arrow opens,
- ``format``: parquet or json (a document per line),
- ``cursor`` (reading once): the column whose comparisons are answered by the source.

A batch read plans one partition per file, or per row group of a Parquet file. Comparisons of the
cursor with a constant (``cursor > mark``) are pushed down: row groups whose statistics exclude
them are not planned, and rows are filtered before they leave the reader. A stream hands out files
in the order of (modification time, name); its offset is the last one handed out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyarrow import json as pj
from pyarrow import parquet as pq
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

COMPARED = {
    EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal,
}

#: Bytes of JSON that are parsed at once; a longer document is parsed whole.
CHUNK = 8 << 20


def whole_lines(source: pa.NativeFile) -> Iterator[bytes]:
    """The bytes of a file in chunks that end with a line; blank ones are left out."""
    held = []
    while block := source.read(CHUNK):
        end = block.rfind(b"\n") + 1
        if end:
            yield b"".join([*held, block[:end]])
            held = []
        held.append(block[end:])
    yield b"".join(held)


def json_schema(path: str, filesystem: fs.FileSystem) -> pa.Schema | None:
    """The schema of the first documents of a file, None if it has none."""
    with filesystem.open_input_stream(path) as source:
        chunk = next((c for c in whole_lines(source) if c.strip()), None)
    return chunk and pj.read_json(pa.BufferReader(chunk), pj.ReadOptions(block_size=len(chunk) + 1)).schema


def json_batches(system: fs.FileSystem, path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Documents of a file, with the columns of the schema alone; a file may be empty and a document of any length."""
    parsed = pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")
    with system.open_input_stream(path) as source:
        for chunk in whole_lines(source):
            if chunk.strip():
                read = pj.ReadOptions(use_threads=False, block_size=len(chunk) + 1)
                yield from pj.read_json(pa.BufferReader(chunk), read, parsed).select(schema.names).to_batches()


def landed(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The files below ``path`` in the order in which they came; names that begin with _ or . are no data."""
    system, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    found = system.get_file_info(place)
    if found.type == fs.FileType.File:
        return system, [found]
    inside = system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    files = [f for f in inside if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return system, sorted(files, key=lambda f: (f.mtime_ns or 0, f.path))


@dataclass
class Piece(InputPartition):
    path: str
    groups: list[int] | None

    def __init__(self, path: str, groups: list[int] | None = None):
        super().__init__(None)
        self.path, self.groups = path, groups


class _Files:
    """What batch and stream readers share: options, schema, and reading one piece."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.format, self.cursor = options["path"], options.get("format", "parquet"), options.get("cursor")
        self.schema = to_arrow_schema(schema)
        self.comparisons: list[tuple[str, str, object]] = []

    def expression(self) -> ds.Expression | None:
        found = None
        for kind, column, value in self.comparisons:
            compare = next(f for k, f in COMPARED.items() if k.__name__ == kind)
            scalar = pa.scalar(value, self.schema.field(column).type)
            one = compare(pc.field(column), scalar)
            found = one if found is None else found & one
        return found

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        wanted, kind = self.expression(), ds.ParquetFileFormat()
        if self.format != "parquet":
            found = json_batches(system, partition.path, self.schema)
            yield from found if wanted is None else (b.filter(wanted) for b in found)
            return
        if partition.groups is None:
            source = ds.dataset([partition.path], schema=self.schema, format=kind, filesystem=system)
        else:
            fragment = kind.make_fragment(partition.path, system, row_groups=partition.groups)
            source = ds.FileSystemDataset([fragment], self.schema, kind, system)
        yield from source.to_batches(filter=wanted)


class LandedReader(_Files, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps comparisons of the cursor with a constant; all others stay with Spark."""
        for one in filters:
            if type(one) in COMPARED and one.attribute == (self.cursor,):
                self.comparisons.append((type(one).__name__, self.cursor, one.value))
            else:
                yield one

    def partitions(self) -> list[Piece]:
        system, files = landed(self.path)
        if self.format != "parquet":
            return [Piece(f.path) for f in files]
        wanted, pieces = self.expression(), []
        for f in files:
            fragment = ds.ParquetFileFormat().make_fragment(f.path, system)
            for part in fragment.split_by_row_group(filter=wanted, schema=self.schema):
                pieces.append(Piece(f.path, [g.id for g in part.row_groups]))
        return pieces


class LandedStream(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"at": 0, "path": ""}

    def latestOffset(self) -> dict:
        _, files = landed(self.path)
        return {"at": files[-1].mtime_ns or 0, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        _, files = landed(self.path)
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        return [Piece(f.path) for f in files if low < (f.mtime_ns or 0, f.path) <= high]


class LandedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> StructType:
        """That of the first file with rows, where the reader was given none."""
        system, files = landed(self.options["path"])
        schema_of = pq.read_schema if self.options.get("format", "parquet") == "parquet" else json_schema
        found = next((s for s in (schema_of(f.path, filesystem=system) for f in files) if s is not None), None)
        if found is None:
            raise ValueError("no file to take a schema from; give one")
        return from_arrow_schema(found, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> LandedStream:
        return LandedStream(dict(self.options), schema)


def register(spark) -> None:
    """Makes the format known to the session and lets filters through to it."""
    spark.dataSource.register(LandedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
