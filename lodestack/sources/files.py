"""A Spark data source of all files below a folder, those with leading dots too, which Spark's own readers skip.

    spark.dataSource.register(FilesSource)
    spark.read.format("corpus_files").load("file:///src")

The driver lists the folder's first levels only, enough for a task a folder; tasks list and read what is below. Any store
that Arrow's file systems know (mounted folders, HDFS, S3, GCS) will do, if all executors reach it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "abs_path string, size bigint, mtime double, content string"
ARROW = pa.schema([("abs_path", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("content", pa.string())])
#: Bytes of file content in a batch, or one file.
BATCH_BYTES = 8 << 20


def decode(data: bytes) -> str:
    """Text of UTF-8 bytes; what isn't UTF-8 is dropped, and every line ends with a line feed."""
    return data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


@dataclass
class Folder(InputPartition):
    """A folder to read, with all below it or by itself."""

    path: str
    recursive: bool


def _opened(uri: str):
    """(file system, path on it) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class FilesReader(DataSourceReader):
    """Reads the files below ``path``; ``levels`` of folders are listed before tasks are dealt out (2)."""

    def __init__(self, options: dict):
        self.root, self.levels = options["path"], int(options.get("levels", "2"))

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        system, top = _opened(self.root)
        found, todo = [], [(top, 0)]
        while todo:
            path, depth = todo.pop()
            if depth >= self.levels:
                found.append(Folder(path, True))
                continue
            found.append(Folder(path, False))
            todo += [(x.path, depth + 1) for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.Directory]
        return found

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = _opened(self.root)
        rows, held = [], 0
        for x in system.get_file_info(fs.FileSelector(partition.path, recursive=partition.recursive)):
            if x.type != fs.FileType.File:
                continue
            with system.open_input_stream(x.path) as f:
                data = f.read()
            rows.append((x.path, x.size, x.mtime_ns // 1_000_000 / 1000, decode(data)))
            held += len(data)
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ARROW)], schema=ARROW)


class FilesSource(DataSource):
    """Option ``path``: the folder. Rows: abs_path, size in bytes, mtime in seconds, content."""

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)
