"""Text helpers: lines, paths and white space, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from . import regex

# Every character (or pair) that ends a line.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a transform over a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_lines(content: Column | str) -> Column:
    """Lines of a text, without their ends and without an empty last line."""

    def without_empty_last(parts):
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return bind(F.split(col(content), LINE_ENDS, -1), without_empty_last)


def strip(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(regex.SPACE_CHARS))


def rstrip(text: Column | str) -> Column:
    return F.rtrim(col(text), F.lit(regex.SPACE_CHARS))


def matchable(line: Column | str) -> Column:
    """False for blank lines and lines that start as a ``#`` or ``//`` comment."""
    start = F.ltrim(col(line), F.lit(regex.SPACE_CHARS))
    return (start != "") & ~start.startswith("#") & ~start.startswith("//")


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(F.rtrim(col(path), F.lit("/")), "/"), -1)


def suffix(path: Column | str) -> Column:
    """Lower-cased last suffix, or an empty string (``.env`` has none)."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)\A.+(\.[^.]+)\z", 1))


def file_ext(path: Column | str) -> Column:
    """The suffix, or the whole name of a dotfile without one."""
    name, ext = file_name(path), suffix(path)
    return F.when((ext == "") & name.startswith("."), F.lower(name)).otherwise(ext)


def truncate(value: Column | str, limit: int, mark: str = "...") -> Column:
    v = col(value)
    return F.when(F.length(v) > limit, F.concat(F.substring(v, 1, limit), F.lit(mark))).otherwise(v)


def numbered_text(lines: Column | str) -> Column:
    """The text with every line prefixed ``L<n>: ``."""
    return F.array_join(
        F.transform(col(lines), lambda line, i: F.concat(F.lit("L"), (i + 1).cast("string"), F.lit(": "), line)),
        "\n",
    )


def around(items: Column, i: Column) -> Column:
    """Item ``i`` (0-based) and its neighbours."""
    first = F.greatest(i - fv.CONTEXT_RADIUS, F.lit(0))
    return F.slice(items, first + 1, i + fv.CONTEXT_RADIUS + 1 - first)


def context_window(lines: Column, i: Column) -> Column:
    """Line ``i`` (0-based) and its neighbours, joined."""
    return F.array_join(around(lines, i), " ")


def fold_case(text: Column | str) -> Column:
    """Lower case as case-insensitive matching of ASCII words sees it.

    Four letters beyond ASCII equal an ASCII letter when case is ignored.
    """
    return F.lower(F.translate(col(text), regex.FOLDED, regex.FOLDED_TO))


def has_context(window: Column | str) -> Column:
    """Whether a text contains one of the context keywords."""
    # Keywords that hold another one are implied by it.  Plain searches: an alternation tries every branch at every place.
    needed = [k for k in fv.CONTEXT_KEYWORDS if not any(o != k and o in k for o in fv.CONTEXT_KEYWORDS)]
    return bind(F.lower(col(window)), lambda lower: reduce(or_, [lower.contains(k) for k in needed]))
