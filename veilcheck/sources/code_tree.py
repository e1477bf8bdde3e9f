"""Reading a tree of text files, hidden files included.

Spark's file sources leave out names that start with ``.`` or ``_``, which are
the ones most worth scanning.  This source lists the tree itself, prunes skipped
directories while walking, and never opens files with a skipped suffix.

Listing and reading are two steps.  Folders are listed by tasks, round by round:
a task hands on the folders that it has not come to, so neither a wide nor a
deep tree ends up in one task or on the driver.  The listed files are then dealt
to reading tasks by the bytes there are.

Roots are folders that all executors see, or addresses (``s3://...``,
``hdfs://...``, ``gs://...``, ``file:///...``) of stores that Arrow opens.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paths import glob_filter
from ..options import DEFAULT_OPTIONS, ScanOptions
from ..session import written

# Names that a listing task takes in before it hands the folders left on to the next round.
NAMES_PER_TASK = 20_000
# Bytes that a reading task should get, and that leave it in one batch.
TASK_BYTES = 128 << 20
BATCH_BYTES = 32 << 20
_ROWS = 10_000
# What a tree that changes or is closed to the reader brings about; anything else fails the scan.
_GONE = (FileNotFoundError, PermissionError, NotADirectoryError)

LISTED = "raw binary, size long, folder boolean"


def is_address(path: bytes) -> bool:
    return b"://" in path


def open_file(path: bytes):
    """A file for reading, of the local system or a store."""
    if not is_address(path):
        return open(path, "rb")
    store, inner = fs.FileSystem.from_uri(path.decode())
    return store.open_input_file(inner)


def _local_entries(folder: bytes) -> Iterator[tuple[bytes, bytes, int | None]]:
    with os.scandir(folder) as entries:
        for entry in entries:
            if not entry.is_dir():
                try:
                    found = entry.stat()
                except _GONE:
                    continue
                yield entry.name, entry.path, found.st_size
            elif not entry.is_symlink():  # like a walk that does not follow links into directories
                yield entry.name, entry.path, None


def _store_entries(folder: bytes) -> Iterator[tuple[bytes, bytes, int | None]]:
    store, inner = fs.FileSystem.from_uri(folder.decode())
    for found in store.get_file_info(fs.FileSelector(inner)):
        address = folder.rstrip(b"/") + b"/" + found.base_name.encode()
        yield found.base_name.encode(), address, None if found.type == fs.FileType.Directory else found.size


def _entries(folder: bytes) -> Iterator[tuple[bytes, bytes, int | None]]:
    """Name, path and size (none for a folder) of what a folder holds; nothing if it is closed or gone."""
    try:
        yield from (_store_entries if is_address(folder) else _local_entries)(folder)
    except _GONE:
        return


def _root(path: bytes, strict: bool) -> int | None:
    """The size of a root that is a file; none for a folder.  -1 if there is none, or an error if ``strict``."""
    try:
        if is_address(path):
            store, inner = fs.FileSystem.from_uri(path.decode())
            found = store.get_file_info(inner)
            if found.type == fs.FileType.NotFound:
                raise FileNotFoundError(path.decode())
            return None if found.type == fs.FileType.Directory else found.size
        found = os.stat(path)
        return None if stat.S_ISDIR(found.st_mode) else found.st_size
    except _GONE:
        if strict:
            raise
        return -1


def _suffix(name: bytes) -> str:
    name = name.rsplit(b"/", 1)[-1]
    dot = name.rfind(b".")
    return name[dot:].decode("utf-8", "ignore").lower() if 0 < dot < len(name) - 1 else ""


def _lister(skip_dirs: list[str], skip_extensions: list[str], strict: bool) -> Callable:
    skipped, suffixes = {d.encode() for d in skip_dirs}, set(skip_extensions)

    def found_below(folders: list[bytes]) -> Iterator[tuple[bytes, int, bool]]:
        names = 0
        while folders and names < NAMES_PER_TASK:
            for name, path, size in _entries(folders.pop()):
                names += 1
                if size is None:
                    if name not in skipped:
                        folders.append(path)
                elif _suffix(name) not in suffixes:
                    yield path, size, False
        yield from ((path, 0, True) for path in folders)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, bool]]:
        folders = []
        for batch in batches:
            for path, folder in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                # A root is looked at first; it may have a skipped name.
                size = None if folder else _root(path, strict)
                if size is None:
                    folders.append(path)
                elif size >= 0 and _suffix(path) not in suffixes:
                    yield path, size, False
        yield from found_below(folders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bool]] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, kind) for c, kind in zip(zip(*held, strict=True), (pa.binary(), pa.int64(), pa.bool_()), strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["raw", "size", "folder"])

        for row in rows(batches):
            held.append(row)
            if len(held) >= _ROWS:
                yield flush()
        if held:
            yield flush()

    return run


def list_tree(spark: SparkSession, roots: list[str] | str, skip_dirs: list[str], skip_extensions: list[str],
              strict: bool = False) -> DataFrame:
    """``(path, raw, size)`` of the files below some roots.  An action: folders are listed as it is called.

    ``raw`` is the path as the file system has it; in ``path``, bytes that are not
    UTF-8 are written as escapes.  ``strict`` makes a missing root an error.
    """
    listing = _lister(skip_dirs, skip_extensions, strict)
    named = [roots] if isinstance(roots, str) else list(roots)
    waiting = spark.createDataFrame([(bytearray(os.fsencode(r)), 0, False) for r in named], LISTED)
    rounds = []
    while True:
        found = written(waiting.repartition(spark.sparkContext.defaultParallelism).mapInArrow(listing, LISTED), "listing")
        rounds.append(found.filter(~F.col("folder")))
        waiting = found.filter("folder")
        if waiting.isEmpty():
            break
    files = rounds[0]
    for more in rounds[1:]:
        files = files.union(more)
    # Valid UTF-8 decodes as it is; other bytes are kept visible.
    plain = F.try_validate_utf8(F.col("raw").cast("string"))
    return files.select(F.coalesce(plain, _escaped(F.col("raw"))).alias("path"), "raw", "size")


def _escaped(raw: Column) -> Column:
    @F.arrow_udf("string")
    def run(names: pa.Array) -> pa.Array:
        return pa.array([n.decode("utf-8", "backslashreplace") for n in names.to_pylist()], pa.string())

    return run(raw)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the listed files, in batches of bounded size."""

    def batch(paths, texts):
        return pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(texts, pa.large_string()).cast(pa.string())], ["path", "content"]
        )

    paths, texts, size = [], [], 0
    for incoming in batches:
        for path, raw in zip(incoming.column(0).to_pylist(), incoming.column(1).to_pylist(), strict=True):
            try:
                with open_file(raw) as f:
                    # Universal newlines, as text mode would read them.
                    text = f.read().decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")
            except _GONE:
                continue
            paths.append(path)
            texts.append(text)
            size += len(text)
            if size >= BATCH_BYTES:
                yield batch(paths, texts)
                paths, texts, size = [], [], 0
    if paths:
        yield batch(paths, texts)


def reading_tasks(files: DataFrame, task_bytes: int) -> int:
    """Tasks by bytes; small trees use the cores there are."""
    seen = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    return max(1, min(seen.n, files.sparkSession.sparkContext.defaultParallelism), -(-seen.bytes // task_bytes))


def read_code_tree(spark: SparkSession, roots: list[str] | str, opts: ScanOptions = DEFAULT_OPTIONS, *,
                   include: list[str] | None = None, exclude: list[str] | None = None,
                   where: Column | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``files(path, content)`` below some roots; listing them is an action.

    Globs and ``where`` (a condition on ``path``) are applied before any file is
    opened.  Files that are gone or closed to the reader yield no row, any other
    failure to read ends the scan; invalid UTF-8 bytes are dropped.
    """
    files = glob_filter(list_tree(spark, roots, opts.skip_dirs, opts.skip_extensions), include, exclude)
    if where is not None:
        files = files.filter(where)
    # Round-robin, so no name is hot.  The count is given: listed paths are tiny,
    # and adaptive execution would merge them, and all the reading, into one task.
    return files.select("path", "raw").repartition(reading_tasks(files, task_bytes)).mapInArrow(
        _read_files, "path string, content string"
    )
