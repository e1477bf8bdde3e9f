"""A tree of files as a data source, for queries that read it lazily or go on reading it.

Spark's file streams leave out hidden files.  This source lists a tree as
``read_code_tree`` does and orders files by the time they last changed (on a
local file system the change of the entry itself, so a file that is moved in
counts as new), then by path.  An offset is a place in that order, so a stream
keeps no list of what it has seen: a batch is what lies between two offsets, and
gives the same files when it is run again after a restart.

Listing runs on the driver when a batch is planned, as with Spark's own file
streams; for trees of many millions of files use ``read_code_tree``.
"""

from __future__ import annotations

import heapq
import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.paths import glob_filter
from ..options import DEFAULT_OPTIONS, ScanOptions
from .code_tree import _GONE, BATCH_BYTES, TASK_BYTES, _entries, _suffix, is_address, open_file

FORMAT = "code_tree"
SCHEMA = "path string, content string, changed timestamp"
#: Seconds after which nothing is expected to change at an earlier time any more.
SETTLED = 2.0
_FILES_PER_TASK = 10_000
_START = {"at": -1, "path": ""}


@dataclass
class Files(InputPartition):
    """The files of a task: path and time of change in nanoseconds."""

    files: list[tuple[bytes, int]]


def _changed(path: bytes) -> int:
    if is_address(path):
        store, inner = fs.FileSystem.from_uri(path.decode())
        return store.get_file_info(inner).mtime_ns or 0
    found = os.stat(path)
    return max(found.st_mtime_ns, found.st_ctime_ns)


def _visible(path: bytes) -> str:
    return path.decode("utf-8", "backslashreplace")


class _Tree:
    """What a reader knows: roots and what to skip."""

    def __init__(self, options: dict[str, str]):
        self.roots = [os.fsencode(r) for r in json.loads(options["roots"])]
        self.skip_dirs = {d.encode() for d in json.loads(options["skip_dirs"])}
        self.skip_extensions = set(json.loads(options["skip_extensions"]))
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        self.settled = float(options.get("settled", SETTLED))
        self.max_files = int(options.get("max_files", 0))

    def files(self) -> Iterator[tuple[int, bytes, int]]:
        """Time of change, path and size of every file."""
        folders = list(self.roots)
        while folders:
            for name, path, size in _entries(folders.pop()):
                if size is None:
                    if name not in self.skip_dirs:
                        folders.append(path)
                elif _suffix(name) not in self.skip_extensions:
                    try:
                        yield _changed(path), path, size
                    except _GONE:
                        continue

    def dealt(self, found: Iterator[tuple[int, bytes, int]]) -> list[Files]:
        """Files in tasks of bounded bytes."""
        tasks, held = [Files([])], 0
        for at, path, size in sorted(found):
            if tasks[-1].files and (held + size > self.task_bytes or len(tasks[-1].files) >= _FILES_PER_TASK):
                tasks.append(Files([]))
                held = 0
            tasks[-1].files.append((path, at))
            held += size
        return tasks

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, at in partition.files:
            try:
                with open_file(path) as file:
                    text = file.read().decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")
            except _GONE:
                continue
            rows.append((_visible(path), text, at // 1000))
            size += len(text)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.timestamp("us", "UTC")]
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["path", "content", "changed"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.tree = _Tree(options)

    def partitions(self) -> list[Files]:
        return self.tree.dealt(self.tree.files())

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.tree = _Tree(options)
        self.known: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        self.known = _START
        return _START

    def _between(self, start: dict, end: dict | None) -> Iterator[tuple[int, bytes, int]]:
        low = (start["at"], start["path"])
        for at, path, size in self.tree.files():
            place = (at, path.hex())
            if place > low and (end is None or place <= (end["at"], end["path"])):
                yield at, path, size

    def latestOffset(self) -> dict:  # noqa: N802
        """The last file that has settled; with ``max_files``, that many files after the last offset."""
        until = time.time_ns() - int(self.tree.settled * 1e9)
        start = self.known or _START
        places = ((at, path.hex()) for at, path, _ in self._between(start, None) if at <= until)
        if self.tree.max_files and self.known:
            some = heapq.nsmallest(self.tree.max_files, places)
            last = some[-1] if some else None
        else:
            last = max(places, default=None)
        if last:
            self.known = {"at": last[0], "path": last[1]} if self.known else None
            return {"at": last[0], "path": last[1]}
        return start

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.known = end
        return self.tree.dealt(self._between(start, end))

    def commit(self, end: dict) -> None:
        self.known = end

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class CodeTree(DataSource):
    """``files(path, content, changed)`` below the roots of an option."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)


def _options(roots: list[str] | str, opts: ScanOptions, more: dict) -> dict[str, str]:
    named = [roots] if isinstance(roots, str) else list(roots)
    return {
        "roots": json.dumps(named), "skip_dirs": json.dumps(sorted(opts.skip_dirs)),
        "skip_extensions": json.dumps(sorted(opts.skip_extensions)), **{k: str(v) for k, v in more.items()},
    }


def tree_table(spark: SparkSession, roots: list[str] | str, opts: ScanOptions = DEFAULT_OPTIONS, *,
               include: list[str] | None = None, exclude: list[str] | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``files(path, content, changed)`` below some folders; listed when the query is planned, read when it runs.

    Files that are gone or closed to the reader yield no row; invalid UTF-8
    bytes are dropped.  Globs are applied to the rows.
    """
    spark.dataSource.register(CodeTree)
    rows = spark.read.format(FORMAT).options(**_options(roots, opts, {"task_bytes": task_bytes})).load()
    return glob_filter(rows, include, exclude)


def tree_stream(spark: SparkSession, roots: list[str] | str, opts: ScanOptions = DEFAULT_OPTIONS, *,
                include: list[str] | None = None, exclude: list[str] | None = None, task_bytes: int = TASK_BYTES,
                settled: float = SETTLED, max_files: int = 0) -> DataFrame:
    """A stream of the files below some folders, hidden ones included; a file that changes comes again.

    A file is taken up ``settled`` seconds after it changed.  ``max_files``
    bounds a trigger; the first trigger after a restart may go beyond it, and a
    run of all that is available is one trigger.
    """
    spark.dataSource.register(CodeTree)
    more = {"task_bytes": task_bytes, "settled": settled, "max_files": max_files}
    rows = spark.readStream.format(FORMAT).options(**_options(roots, opts, more)).load()
    return glob_filter(rows, include, exclude)
