"""Searches in sorted arrays, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind


def count_first(items: Column, holds: Callable[[Column], Column]) -> Column:
    """How many elements a condition holds for, that holds up to some place in the array and not beyond it.

    By bisection: the cost is the logarithm of the array's length.
    """

    def halve(state, _):
        mid = F.floor((state["low"] + state["high"]) / 2).cast("int")
        return (
            F.when(state["low"] >= state["high"], state)
            .when(holds(F.get(items, mid)), F.struct((mid + 1).alias("low"), state["high"].alias("high")))
            .otherwise(F.struct(state["low"].alias("low"), mid.alias("high")))
        )

    # As many rounds as the length has binary digits.
    rounds = F.sequence(F.lit(1), F.length(F.bin(F.size(items))))
    start = F.struct(F.lit(0).alias("low"), F.size(items).alias("high"))
    return F.aggregate(rounds, start, halve, lambda state: state["low"])


def between(items: Column, before: Callable[[Column], Column], upto: Callable[[Column], Column]) -> Column:
    """The elements after those that ``before`` holds for, among those that ``upto`` holds for."""
    first = count_first(items, before)
    return F.slice(items, first + 1, count_first(items, upto) - first)


def runs(items: Column, key: str) -> Column:
    """A sorted array of structs, cut where a field changes."""
    heads = F.filter(
        F.transform(items, lambda x, i: F.when((i == 0) | (F.get(items, i - 1)[key] != x[key]), i)), lambda i: i.isNotNull()
    )
    return bind(heads, lambda starts: F.transform(
        starts, lambda start, j: F.slice(items, start + 1, F.coalesce(F.get(starts, j + 1), F.size(items)) - start)
    ))
