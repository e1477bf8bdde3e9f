"""Lines of files as rows, each with its surroundings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def with_context(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line: adds ``line_number, line, context_match``; other columns are kept.

    The neighbours come from the file's own array of lines, so no window and no
    shuffle is needed.  Blank and comment lines count as neighbours.  No keyword
    has white space, so none reaches over a line's end: each line is searched
    once, and a line asks what was found in those around it.
    """
    kept = [c for c in files.columns if c != content]
    lines = files.select(*kept, text.split_lines(content).alias("_lines"))
    rows = text.bind(F.transform("_lines", text.has_context), lambda found: F.transform("_lines", lambda line, i: F.struct(
        (i + 1).alias("line_number"), line.alias("line"), F.exists(text.around(found, i), lambda x: x).alias("context_match"),
    )))
    return lines.select(*kept, F.inline(rows))


def numbered_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line: adds ``line_number, line``; other columns are kept."""
    kept = [c for c in files.columns if c != content]
    return files.select(*kept, F.posexplode(text.split_lines(content)).alias("_i", "line")).select(
        *kept, (F.col("_i") + 1).alias("line_number"), "line"
    )
