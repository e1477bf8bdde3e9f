"""Assignments, identifiers and risky calls on a line, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from . import regex
from .text import col

_ASSIGNMENT = regex.java(r"^\s*([A-Z_a-z][A-Z_a-z0-9]*)\s*=")
_ASSIGNMENT_WITH_VALUE = regex.java(r"^\s*([A-Z_a-z][A-Z_a-z0-9]*)\s*=(.+)")
_WORDS = regex.java(r"\w+")


def _group(line: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, index), F.lit(""))


def assigned_variable(line: Column | str) -> Column:
    """The identifier a line assigns to, or null."""
    return _group(col(line), _ASSIGNMENT, 1)


def assignment_target(line: Column | str) -> Column:
    """Like ``assigned_variable``, but only where a right-hand side follows."""
    return _group(col(line), _ASSIGNMENT_WITH_VALUE, 1)


def assignment_value(line: Column | str) -> Column:
    return _group(col(line), _ASSIGNMENT_WITH_VALUE, 2)


def words(text: Column | str) -> Column:
    """The distinct whole words of a text."""
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(_WORDS), F.lit(0)))


def sink_type(line: Column | str) -> Column:
    """Name of the first risky call that a line contains, or null.

    A regex only meets lines with all literals of its call, which plain searches find.
    """
    c = col(line)
    name = F.when(F.lit(False), F.lit(""))
    for pattern, sink in fv.SINKS:
        literals = reduce(and_, [c.contains(x) for x in regex.literals(pattern)], F.lit(True))
        name = name.when(literals & c.rlike(regex.java(pattern)), F.lit(sink))
    return name
