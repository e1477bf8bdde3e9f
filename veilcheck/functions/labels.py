"""Report labels: detector flags, SARIF fields and review words, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import col, strip


def is_review_finding(secret_type: Column | str = "secret_type", category: Column | str = "category",
                      source: Column | str = "source") -> Column:
    """Whether a finding came from an external code review."""
    return (
        (col(secret_type) == fv.REVIEW_TYPE)
        | (col(category) == fv.REVIEW_CATEGORY)
        | F.coalesce(col(source).startswith(fv.REVIEW_SOURCE_PREFIX), F.lit(False))
    )


def detector(is_review: Column) -> Column:
    return F.when(is_review, "llm").otherwise("patterns")


def rule_id(secret_type: Column | str) -> Column:
    return F.upper(F.replace(col(secret_type), F.lit(" "), F.lit("_")))


def sarif_level(level: Column | str) -> Column:
    return F.when(col(level).isin("HIGH", "CRITICAL"), "error").otherwise("warning")


def sarif_message(is_review: Column) -> Column:
    """Message text of a finding row."""
    return F.concat(
        F.col("secret_type"), F.lit(" ("), F.col("severity"), F.lit(") at "), F.col("file"), F.lit(":"),
        F.col("line_number").cast("string"), F.lit("; confidence="), F.col("confidence").cast("string"),
        F.when(is_review, " [LLM]").otherwise(""),
    )


def _lookup(key: Column, table: dict) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def threat_severity(raw: Column | str) -> Column:
    """Severity of a threat word (``SAFE`` included), or null if unknown."""
    return _lookup(F.upper(strip(raw)), fv.THREAT_WORDS)


def review_score(level: Column | str) -> Column:
    return _lookup(col(level), fv.REVIEW_SCORES)


def review_confidence(level: Column | str) -> Column:
    return _lookup(col(level), fv.REVIEW_CONFIDENCE)


def alarm_pattern(line: Column | str) -> Column:
    """First alarm substring that a line contains, or null."""
    c = col(line)
    found = F.when(F.lit(False), F.lit(""))
    for s in fv.ALARM_SUBSTRINGS:
        found = found.when(c.contains(s), F.lit(s))
    return found
