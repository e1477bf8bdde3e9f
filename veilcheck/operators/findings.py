"""Operators over findings: filters, order, deduplication and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import labels, scoring
from ..session import written
from .ranking import number_rows

DEDUP_KEY = ["file", "line_number", "secret_type", "matched_value", "source"]
REPORT_ORDER = ["file", "line_number", "rule_ord", "match_ord", "source", "secret_type", "matched_value"]


def drop_low_score(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("score") >= fv.MIN_SCORE)


def _level(name: str) -> int:
    if name not in fv.SEVERITY_ORDER:
        raise ValueError(f"unknown severity: {name!r}")
    return fv.SEVERITY_ORDER.index(name)


def min_severity(findings: DataFrame, level: str) -> DataFrame:
    """Findings of at least a severity; unknown severities rank as LOW."""
    return findings.filter(scoring.severity_rank("severity") >= _level(level))


def union_findings(*parts: DataFrame) -> DataFrame:
    """Bag union of findings of several origins."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def deduplicate(findings: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """The first finding, in detection order, of each (file, line, type, value, source).

    ``min`` of a struct combines on the map side, so many copies of one finding
    shrink to one row per task before the shuffle.
    """
    key = [*(extra_keys or []), *DEDUP_KEY]
    rest = [c for c in findings.columns if c not in key]
    order = ["rule_ord", "match_ord"]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first")
    return findings.groupBy(*key).agg(first).select(*key, "_first.*").select(*findings.columns)


def report_order() -> list[Column]:
    """Sort order of reports: highest score first, then place, then detection order."""
    return [F.desc("score"), *map(F.asc, REPORT_ORDER)]


def in_report_order(findings: DataFrame) -> DataFrame:
    """The findings in report order.  An action: they are written, since a sort samples its input and would scan twice.

    Columns that nobody needs are best dropped before.
    """
    return written(findings, "unordered").orderBy(*report_order())


def rank_findings(findings: DataFrame, start: int = 1) -> DataFrame:
    """Adds ``idx``, the position in report order."""
    return number_rows(findings, report_order(), start)


def _severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in reversed(fv.SEVERITY_ORDER)]


def severity_summary(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per severity, zero-filled, as columns CRITICAL, HIGH, MEDIUM, LOW."""
    return findings.groupBy(*(by or [])).agg(*_severity_counts())


def exposure_counts(findings: DataFrame) -> DataFrame:
    """Findings that reach a risky call, and findings from code reviews."""
    return findings.agg(
        F.count_if(F.col("taint_count") > 0).alias("tainted"),
        F.count_if(labels.is_review_finding()).alias("review_findings"),
    )


def scan_summary(findings: DataFrame) -> DataFrame:
    """Total, counts per severity and review findings, in one pass."""
    return findings.agg(
        F.count("*").alias("total"), *_severity_counts(),
        F.count_if(labels.is_review_finding()).alias("review_findings"),
    )


def ci_gate(findings: DataFrame, fail_on: str, by: list[str] | None = None,
            groups: DataFrame | None = None) -> DataFrame:
    """Whether any finding reaches ``fail_on``: column ``failed`` and ``exit_code``.

    Without ``by`` this is one row, false for no findings.  With ``by``, pass
    the ``groups`` to judge so that groups without findings count as passed.
    """
    hit = F.coalesce(F.bool_or(scoring.severity_rank("severity") >= _level(fail_on)), F.lit(False))
    gate = findings.groupBy(*(by or [])).agg(hit.alias("failed"))
    if by and groups is not None:
        gate = groups.select(*by).distinct().join(gate, by, "left").withColumn(
            "failed", F.coalesce("failed", F.lit(False))
        )
    return gate.withColumn("exit_code", F.col("failed").cast("int"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One row per rule id, ordered by first appearance, described by its last finding."""
    place = F.struct(
        (-F.col("score")).alias("s"), *[F.col(c) for c in REPORT_ORDER],
    )
    is_review = labels.is_review_finding()
    described = findings.select(
        labels.rule_id("secret_type").alias("rule_id"),
        place.alias("place"),
        F.struct("secret_type", "category", is_review.alias("ai_detection")).alias("last"),
    )
    return (
        described.groupBy("rule_id")
        .agg(F.min("place").alias("first_place"), F.max_by("last", "place").alias("last"))
        .select("rule_id", "first_place", "last.*")
        .withColumn("name", F.col("secret_type"))
        .withColumn("full_description", F.concat(F.lit("Detected potential secret: "), "secret_type"))
        .drop("secret_type")
    )


def corpus_by_project(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each labelled project with its number of findings."""
    per_project = findings.groupBy("project").agg(F.count("*").alias("findings"))
    return manifest.join(per_project, "project", "left").withColumn(
        "findings", F.coalesce("findings", F.lit(0))
    )


def evaluate_corpus(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per language: labelled projects, and how many behave as labelled."""
    return corpus_by_project(findings, manifest).groupBy("language").agg(*_corpus_counts())


def _corpus_counts() -> list[Column]:
    vulnerable, found = F.col("vulnerable"), F.col("findings") > 0
    return [
        F.count_if(vulnerable).alias("vulnerable"),
        F.count_if(vulnerable & found).alias("vulnerable_found"),
        F.count_if(~vulnerable).alias("clean"),
        F.count_if(~vulnerable & ~found).alias("clean_quiet"),
    ]


def corpus_verdict(evaluation: DataFrame) -> DataFrame:
    """Totals over all languages against the recall and quietness floors."""
    # At most 6 vulnerable projects missed, 2 clean ones noisy,
    # but never fewer than 5 found and 8 quiet.
    totals = evaluation.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (
        "vulnerable", "vulnerable_found", "clean", "clean_quiet",
    )])
    return totals.withColumn(
        "recall_ok", F.col("vulnerable_found") >= F.greatest(F.lit(5), F.col("vulnerable") - 6)
    ).withColumn(
        "quiet_ok", F.col("clean_quiet") >= F.greatest(F.lit(8), F.col("clean") - 2)
    )
