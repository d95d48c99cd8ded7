"""Files of a directory as a data source, for batches and for streams.

    register(spark)
    spark.read.format("text_files").load("/shared/in").where("mime_type = 'text/csv'")
    spark.readStream.format("text_files").load("/shared/in")

Rows: source_path, mime_type (by extension, ``unknown`` otherwise), modified, length, content (UTF-8;
what isn't becomes U+FFFD). The files are listed once, in lexical order, and dealt into partitions
of about ``partition_bytes``; a larger file is a partition of its own. Filters on source_path and
mime_type are pushed down: a file that they rule out is neither planned nor opened.

A stream's offset is the (modified, path) of the last file, so a batch holds the files
between two offsets and is the same when it is replayed. A file that arrives with an older
time than the last offset isn't seen; move files into the folder with a new time.

Paths go through Arrow's file systems (local, hdfs, s3 ...), on the driver and on the executors.
``loaders.load_directory`` reads what only Spark's own readers reach. Formats are parsed by
``loaders.load``, one branch for each type.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from corpusmill.sources.loaders import MIME_BY_EXTENSION

SCHEMA = "source_path string, mime_type string, modified timestamp, length long, content string"
PARTITION_BYTES = 64 << 20


@dataclass
class File:
    path: str
    mime: str
    modified: int  #: nanoseconds
    length: int


@dataclass
class Files(InputPartition):
    files: list[File]


def _opened(path: str):
    """(Arrow file system, path in it)"""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[File]:
    import pyarrow.fs as fs

    system, place = _opened(path)
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    found = system.get_file_info(fs.FileSelector(place, recursive=True))
    out = []
    for f in found:
        if f.is_file and not f.base_name.startswith((".", "_")):
            name = f"{prefix}{f.path}" if not prefix or f.path.startswith("/") or prefix != "file://" else f"file:///{f.path}"
            out.append(File(name, MIME_BY_EXTENSION.get(f.extension.lower(), "unknown"), f.mtime_ns or 0, f.size or 0))
    return sorted(out, key=lambda f: f.path)


def packed(files: Iterable[File], most: int) -> list[Files]:
    """Consecutive files up to ``most`` bytes, at least one."""
    out: list[Files] = []
    size = 0
    for f in files:
        if not out or size + f.length > most:
            out.append(Files([]))
            size = 0
        out[-1].files.append(f)
        size += f.length
    return out


def rows(part: Files) -> Iterator[tuple]:
    for f in part.files:
        system, place = _opened(f.path)
        with system.open_input_stream(place, compression=None) as stream:
            content = stream.read().decode("utf-8", "replace")
        yield f.path, f.mime, dt.datetime.fromtimestamp(f.modified / 1e9, dt.UTC), f.length, content


class _Reader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most
        self.kept: list[tuple[str, str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            test = {EqualTo: "in", In: "in", StringStartsWith: "starts", StringEndsWith: "ends"}.get(type(f))
            if test and column in ("source_path", "mime_type"):
                self.kept.append((column, test, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def _fits(self, f: File) -> bool:
        def holds(column: str, test: str, values: tuple[str, ...]) -> bool:
            x = f.path if column == "source_path" else f.mime
            return x in values if test == "in" else x.startswith(values[0]) if test == "starts" else x.endswith(values[0])

        return all(holds(*k) for k in self.kept)

    def partitions(self) -> list[Files]:
        return packed(filter(self._fits, listed(self.path)), self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((f.modified, f.path) for f in listed(self.path)), default=(-1, ""))
        return {"modified": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        lo, hi = ((o["modified"], o["path"]) for o in (start, end))
        return packed((f for f in listed(self.path) if lo < (f.modified, f.path) <= hi), self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition)


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return SCHEMA

    def _arguments(self) -> tuple[str, int]:
        if not (path := self.options.get("path")):
            raise ValueError("text_files needs a path")
        return path.rstrip("/"), int(self.options.get("partition_bytes", PARTITION_BYTES))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._arguments())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(*self._arguments())


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it unless the session says otherwise."""
    key = "spark.sql.python.filterPushdown.enabled"
    if spark.conf.get(key, "false") == "false":
        spark.conf.set(key, "true")
    spark.dataSource.register(TextFiles)
