"""Reading files in pieces, so that one large file is many rows and many tasks.

Files are listed as ``read_code_tree`` lists them and cut by bytes.  A piece owns
the lines that begin within its bytes; tasks find its first and last line
themselves, so they need nothing from each other.  Only what number its first
line has takes one more pass, over the files of several pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed_values as fv
from ..operators.paths import glob_filter
from ..options import DEFAULT_OPTIONS, ScanOptions
from ..session import written
from .code_tree import _GONE, TASK_BYTES, list_tree, open_file

PIECE_BYTES = 64 << 20
_BLOCK = 1 << 16
_END = re.compile(rb"\r\n|\n|\r")


def line_start(file, at: int, size: int) -> int:
    """The first place from ``at`` on where a line begins, or the end."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    pos = at - 1
    while pos < size:
        file.seek(pos)
        block = file.read(_BLOCK)
        found = _END.search(block)
        if not found:
            pos += len(block)
        elif found[0] == b"\r" and found.end() == len(block) and pos + len(block) < size:
            pos += found.start()
            file.seek(pos)
            return pos + (2 if file.read(2) == b"\r\n" else 1)
        else:
            return pos + found.end()
    return size


def _read_lines(file, start: int, end: int) -> list[str]:
    file.seek(start)
    return file.read(end - start).decode("utf-8", errors="ignore").splitlines()


def _lines_before(file, start: int, size: int) -> list[str]:
    width = _BLOCK
    while start:
        first = line_start(file, start - width, size)
        lines = _read_lines(file, first, start) if first < start else []
        if len(lines) >= fv.CONTEXT_RADIUS or width >= start:
            return lines[-fv.CONTEXT_RADIUS :]
        width *= 4
    return []


def _lines_after(file, end: int, size: int) -> list[str]:
    width = _BLOCK
    while end < size:
        lines = _read_lines(file, end, min(size, end + width))
        # The last line may be cut off.
        if len(lines) > fv.CONTEXT_RADIUS or end + width >= size:
            return lines[: fv.CONTEXT_RADIUS]
        width *= 4
    return []


def _each(batches: Iterator[pa.RecordBatch], piece_bytes: int) -> Iterator[tuple]:
    """Open file, path, piece, first byte, byte after the last, size and number of the first line of each piece."""
    for batch in batches:
        for row in batch.to_pylist():
            try:
                with open_file(row["raw"]) as file:
                    start = line_start(file, row["piece"] * piece_bytes, row["size"])
                    last = row["piece"] + 1 == row["n_pieces"]
                    end = row["size"] if last else line_start(file, (row["piece"] + 1) * piece_bytes, row["size"])
                    yield file, row, start, end
            except _GONE:
                continue


def read_pieces(spark: SparkSession, roots: list[str] | str, opts: ScanOptions = DEFAULT_OPTIONS, *,
                include: list[str] | None = None, exclude: list[str] | None = None, where: Column | None = None,
                piece_bytes: int = PIECE_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``(path, piece, n_pieces, first_line, before, lines, after)`` of the files below some roots, for ``scan_pieces``.

    Listing, and counting the lines of files of several pieces, are actions.
    Filters, files that are gone and invalid bytes are treated as in
    ``read_code_tree``.  A piece is as large as its longest line at least.
    """
    files = glob_filter(list_tree(spark, roots, opts.skip_dirs, opts.skip_extensions), include, exclude)
    if where is not None:
        files = files.filter(where)
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / piece_bytes)).cast("int")
    ranges = files.select("path", "raw", "size", n.alias("n_pieces")).select("*", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    ranges = written(ranges, "ranges")
    own = F.least(F.col("size"), F.lit(piece_bytes))
    seen = ranges.agg(F.count("*").alias("n"), F.coalesce(F.sum(own), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(seen.n, spark.sparkContext.defaultParallelism), -(-seen.bytes // task_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, row, start, end in _each(batches, piece_bytes):
            lines = len(_read_lines(file, start, end))
            yield pa.RecordBatch.from_pylist([{"raw": row["raw"], "piece": row["piece"], "n_lines": lines}], pa.schema([("raw", pa.binary()), ("piece", pa.int32()), ("n_lines", pa.int64())]))

    several = ranges.filter("n_pieces > 1").repartition(tasks).mapInArrow(count, "raw binary, piece int, n_lines long")
    upto = F.sum("n_lines").over(Window.partitionBy("raw").orderBy("piece"))
    first = written(several.select("raw", "piece", (upto - F.col("n_lines") + 1).cast("int").alias("first_line")), "first-lines")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        for file, row, start, end in _each(batches, piece_bytes):
            lines = [_lines_before(file, start, row["size"]), _read_lines(file, start, end), _lines_after(file, end, row["size"])]
            plain = [pa.array([row[c]], t) for c, t in (("path", pa.string()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("first_line", pa.int32()))]
            yield pa.RecordBatch.from_arrays([*plain, *(pa.array([x], kind) for x in lines)], ["path", "piece", "n_pieces", "first_line", "before", "lines", "after"])

    numbered = ranges.join(first, ["raw", "piece"], "left").withColumn("first_line", F.coalesce("first_line", F.lit(1)))
    return numbered.select("path", "raw", "size", "n_pieces", "piece", "first_line").repartition(tasks).mapInArrow(
        read, "path string, piece int, n_pieces int, first_line int, before array<string>, lines array<string>, after array<string>"
    )
