"""Path filters: skip lists and globs.  All push down below the text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regex, text
from ..functions.text import col
from ..options import DEFAULT_OPTIONS, ScanOptions


def is_skipped(path: Column | str = "path", mode: str = "dirs", opts: ScanOptions = DEFAULT_OPTIONS) -> Column:
    """Whether a path lies in a skipped directory or has a skipped suffix.

    ``dirs`` tests the directories of a path, ``parts`` also the file name.
    """
    if mode not in ("dirs", "parts"):
        raise ValueError(f"unknown skip mode: {mode!r}")
    parts = F.split(col(path), "/")
    tested = parts if mode == "parts" else F.slice(parts, 1, F.size(parts) - 1)
    in_dir = F.arrays_overlap(tested, F.array(*map(F.lit, opts.skip_dirs)))
    return in_dir | text.suffix(path).isin(opts.skip_extensions)


def skip_paths(df: DataFrame, mode: str = "dirs", opts: ScanOptions = DEFAULT_OPTIONS, path: str = "path") -> DataFrame:
    return df.filter(~is_skipped(path, mode, opts))


def matches_globs(path: Column | str, include: list[str] | None, exclude: list[str] | None) -> Column:
    """Included (if any include is given) and not excluded, by base name or full path."""

    def any_match(globs: list[str]) -> Column:
        pattern = "|".join(f"(?:{regex.glob(g)})" for g in globs)
        return text.file_name(path).rlike(pattern) | col(path).rlike(pattern)

    keep = any_match(include) if include else F.lit(True)
    return keep & ~any_match(exclude) if exclude else keep


def glob_filter(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None,
                path: str = "path") -> DataFrame:
    if not include and not exclude:
        return df
    return df.filter(matches_globs(path, include, exclude))
