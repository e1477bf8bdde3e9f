"""The scan: files -> findings, in one map-only pass.

A file is one row, whatever its size and kind, and everything that needs a
file's context (neighbouring lines, the flow of its variables) is an array
expression inside that row.  The plan therefore has no shuffle: the text is
read once and only findings leave the task.  The same function scans batch and
streaming DataFrames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import flow, scoring, text
from ..operators import findings as fnd
from ..operators import matching, paths, taint
from ..operators.history import history_files
from ..operators.rules import RuleSet, rules
from ..options import DEFAULT_OPTIONS, ScanOptions
from ..schemas import FINDING, FLOWS, TOUCHES
from ..session import per_gateway


def _candidates(lines: Column, rule_set: RuleSet) -> Column:
    """Lines that pass a gate, with their index and keys."""

    def gated(line, i):
        keys = F.when(text.matchable(line), matching.gate_keys(line, rule_set)).otherwise(F.array().cast("array<string>"))
        return F.struct(i.alias("i"), line.alias("line"), keys.alias("keys"))

    return F.filter(F.transform(lines, gated), lambda c: F.size(c["keys"]) > 0)


def _matches(lines: Column, rule_set: RuleSet, opts: ScanOptions) -> Column:
    """Matches with a plausible value."""

    def plausible(c):
        kept = F.filter(
            matching.line_matches(c["line"], c["keys"], rule_set),
            lambda m: ~scoring.is_false_positive(m["value"], opts),
        )
        return F.struct(c["i"].alias("i"), c["line"].alias("line"), kept.alias("kept"))

    # The surroundings are looked at once per line, and only on lines with a match.
    def placed(c):
        return F.struct(
            (c["i"] + 1).alias("line_number"),
            c["line"].alias("line"),
            c["kept"].alias("kept"),
            text.has_context(text.context_window(lines, c["i"])).alias("context_match"),
        )

    def spread(c):
        return F.transform(c["kept"], lambda m: F.struct(
            *[c[name].alias(name) for name in ("line_number", "line", "context_match")],
            *[m[name].alias(name) for name in (
                "rule_ord", "secret_type", "base_score", "category", "match_ord", "value",
            )],
        ))

    matched = F.filter(F.transform(_candidates(lines, rule_set), plausible), lambda c: F.size(c["kept"]) > 0)
    return F.flatten(F.transform(F.transform(matched, placed), spread))


def _scored(matches: Column, ext: Column) -> Column:
    """Matches with their score, without those that score too low."""

    def measure(m):
        return F.struct(
            *[m[name].alias(name) for name in (
                "line_number", "line", "context_match", "rule_ord", "secret_type", "base_score", "category",
                "match_ord", "value",
            )],
            scoring.shannon_entropy(m["value"]).alias("entropy"),
            scoring.validate_structure(m["secret_type"], m["value"]).alias("structural_valid"),
        )

    def rate(m):
        return F.struct(
            *[m[name].alias(name) for name in (
                "line_number", "line", "context_match", "rule_ord", "secret_type", "category", "match_ord", "value",
                "entropy", "structural_valid",
            )],
            scoring.score(
                m["base_score"], scoring.is_likely_hash(m["value"]), m["entropy"], m["context_match"], ext,
                m["structural_valid"],
            ).alias("score"),
            flow.assigned_variable(m["line"]).alias("variable"),
        )

    rated = F.transform(F.transform(matches, measure), rate)
    return F.filter(rated, lambda m: m["score"] >= fv.MIN_SCORE)


@per_gateway
def _hits(rule_set: RuleSet, opts: ScanOptions) -> Column:
    """Scored matches in the lines of a file, as an expression over its columns."""
    return _scored(_matches(F.col("_lines"), rule_set, opts), text.file_ext("path"))


def detect(files: DataFrame, rule_set: RuleSet | None = None, opts: ScanOptions = DEFAULT_OPTIONS,
           with_traces: bool = True) -> DataFrame:
    """Scored matches of ``files(path, content, ...)`` with their traces, before rescoring.

    Columns of ``files`` other than ``content`` are kept.  ``taint_count`` is
    the number of traces; ``taint_traces`` writes them out, which costs nothing
    unless it is selected.  ``with_traces=False`` skips the flow analysis.
    """
    kept = [c for c in files.columns if c != "content"]
    return detect_lines(files.select(*kept, text.split_lines("content").alias("_lines")), rule_set, opts, with_traces)


def with_hits(files: DataFrame, rule_set: RuleSet | None = None, opts: ScanOptions = DEFAULT_OPTIONS) -> DataFrame:
    """Adds ``_hits``, the scored matches in ``files(path, _lines, ...)``."""
    return files.select("*", _hits(rule_set or rules(), opts).alias("_hits"))


def detect_lines(files: DataFrame, rule_set: RuleSet | None = None, opts: ScanOptions = DEFAULT_OPTIONS,
                 with_traces: bool = True) -> DataFrame:
    """``detect`` for files that are arrays of lines, ``files(path, _lines, ...)``."""
    kept = [c for c in files.columns if c != "_lines"]
    hits = with_hits(files, rule_set, opts)
    secrets = F.transform(
        F.filter("_hits", lambda h: h["variable"].isNotNull()),
        lambda h: F.struct(h["variable"].alias("variable"), h["line_number"].alias("line_number")),
    )
    if with_traces:
        secrets = F.when(taint.is_flow_file(text.file_ext("path")), secrets).otherwise(F.slice(secrets, 1, 0))
        traced = taint.with_flows(hits.select(*kept, "_lines", "_hits", secrets.alias("_secrets")))
    else:
        traced = hits.withColumns({"_flows": F.array().cast(FLOWS), "_touches": F.array().cast(TOUCHES)})

    def counted(h):
        return F.struct(h.alias("hit"), taint.trace_count(F.col("_touches"), h["line_number"]).alias("taint_count"))

    return traced.select(*kept, "_flows", "_touches", F.inline(F.transform("_hits", counted))).select(
        *kept, "hit.*", "taint_count",
        taint.traces_through(F.col("_flows"), F.col("_touches"), F.col("path"), F.col("hit.line_number")).alias(
            "taint_traces"),
    )


def file_flows(files: DataFrame, rule_set: RuleSet | None = None, opts: ScanOptions = DEFAULT_OPTIONS) -> DataFrame:
    """``(..., path, flows)``: the flows of the secrets of each file that has any, for ``taint.attach_traces``."""
    kept = [c for c in files.columns if c not in ("path", "content")]
    lines = files.filter(taint.is_flow_file(text.file_ext("path"))).select(
        *kept, "path", text.split_lines("content").alias("_lines")
    ).select(*kept, "path", "_lines", _hits(rule_set or rules(), opts).alias("_hits"))
    secrets = F.transform(
        F.filter("_hits", lambda h: h["variable"].isNotNull()),
        lambda h: F.struct(h["variable"].alias("variable"), h["line_number"].alias("line_number")),
    )
    return taint.taint_flows(lines.select(*kept, "path", F.col("_lines").alias("lines"), secrets.alias("secrets")))


def rescore(hits: DataFrame, opts: ScanOptions = DEFAULT_OPTIONS) -> DataFrame:
    """Raise the score of findings whose variable reaches a risky call; then rate them all."""
    tainted = F.col("taint_count") > 0
    final = F.col("score") + F.when(tainted, fv.TAINT_BONUS).otherwise(0)
    rated = hits.withColumns({"score": final, "entropy": scoring.round2(F.col("entropy"))})
    return rated.withColumns({
        "severity": scoring.severity("score", opts),
        "confidence": scoring.confidence("score", "entropy", "structural_valid", tainted),
    })


def scan_content(files: DataFrame, rule_set: RuleSet | None = None, opts: ScanOptions = DEFAULT_OPTIONS,
                 with_traces: bool = True) -> DataFrame:
    """Findings of ``files(path, content[, source], ...)``; other columns are kept in front."""
    if "source" not in files.columns:
        files = files.withColumn("source", F.lit("current"))
    others = [c for c in files.columns if c not in ("path", "content", "source")]
    return as_findings(detect(files, rule_set, opts, with_traces), others, opts)


def as_findings(hits: DataFrame, others: list[str], opts: ScanOptions = DEFAULT_OPTIONS) -> DataFrame:
    """Findings of detected matches, after the other columns."""
    rated = rescore(hits, opts)
    stored = {
        "file": F.col("path"), "line_content": text.rstrip("line"), "matched_value": text.truncate("value", fv.VALUE_LIMIT),
    }
    return rated.select(*others, *[stored[c].alias(c) if c in stored else c for c in FINDING])


def run_scan(files: DataFrame, blobs: DataFrame | None = None, reviews: DataFrame | None = None, *,
             rule_set: RuleSet | None = None, opts: ScanOptions = DEFAULT_OPTIONS, min_severity: str = "LOW",
             include: list[str] | None = None, exclude: list[str] | None = None,
             max_commits: int = fv.HISTORY_COMMITS, skip_mode: str = "dirs", repo: list[str] | None = None,
             where: Column | None = None, observation: Observation | None = None) -> DataFrame:
    """Findings of files, optionally of their history and of code reviews.

    ``files(path, content)`` is filtered by skip lists, globs and ``where``;
    ``blobs`` adds the history, ``reviews`` finished review findings.  Globs
    apply to the files and again to the findings, so history findings are
    filtered by their ``history/`` path only.  ``repo`` names the columns of
    ``blobs`` that tell repositories apart: each has its own newest commits and
    first blobs, and its findings carry the columns.  ``observation`` receives the number
    of ``files`` that were scanned, once the findings are computed.
    """
    current = paths.glob_filter(paths.skip_paths(files, skip_mode, opts), include, exclude)
    if where is not None:
        current = current.filter(where)
    if observation is not None:
        current = current.observe(observation, F.count("*").alias("files"))
    parts = [scan_content(current, rule_set, opts)]
    if blobs is not None:
        parts.append(scan_content(history_files(blobs, max_commits, opts, repo), rule_set, opts))
    if reviews is not None:
        parts.append(reviews)
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    found = paths.glob_filter(found, include, exclude, path="file")
    return fnd.min_severity(found, min_severity)
