"""External code review: what to send out, and what to make of the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed_values as fv
from ..functions import labels, regex, text
from ..functions.arrays import count_first
from ..functions.text import col
from ..schemas import FINDING, TRACES
from ..session import written

# Detection order of review findings: after every rule.
REVIEW_ORD = 1_000_000
# Verdicts that are searched together, and paths at most that have more.
VERDICT_GROUP, MOST_LARGE = 4096, 1 << 17
_NOT_BLANK = regex.java(r"[^\s]")
_NUMBERED = regex.java(r"^\s*L(\d+)\s*:\s*(.*)\s*$")


def looks_risky(content: Column | str) -> Column:
    """Cheap search for code worth a review."""
    return col(content).rlike(regex.any_of(fv.RISK_MARKERS, "(?iu)"))


def review_eligible(files: DataFrame, max_bytes: int = fv.REVIEW_MAX_BYTES, scan_all: bool = False) -> DataFrame:
    """Code files, never dotfiles, that are not blank, not too big and look risky.

    The path tests come first, so the text of other files is not read for this.
    """
    content = F.col("content")
    keep = (
        ~text.file_name("path").startswith(".")
        & text.suffix("path").isin(fv.REVIEW_EXTENSIONS)
        & (F.octet_length(content) <= max_bytes)
        & content.rlike(_NOT_BLANK)
    )
    return files.filter(keep if scan_all else keep & looks_risky(content))


def cap_files(files: DataFrame, n: int = fv.REVIEW_MAX_FILES, scan: list[str] | None = None) -> DataFrame:
    """The first ``n`` files by path (of each ``scan``, if given); 0 means all."""
    if n <= 0:
        return files
    if not scan:
        return files.orderBy("path").limit(n)
    # Spark limits each group to n rows before the shuffle, so no scan is hot.
    rank = F.row_number().over(Window.partitionBy(*scan).orderBy("path"))
    return files.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def review_batch(files: DataFrame, max_files: int = fv.REVIEW_MAX_FILES, max_bytes: int = fv.REVIEW_MAX_BYTES,
                 scan_all: bool = False, scan: list[str] | None = None) -> DataFrame:
    """One numbered text per file to be reviewed: ``(path, prompt_text)``."""
    chosen = cap_files(review_eligible(files, max_bytes, scan_all), max_files, scan)
    return chosen.select(
        *(scan or []), "path", text.numbered_text(text.split_lines("content")).alias("prompt_text")
    )


def _verdict(raw: Column) -> Column:
    """Severity, line number and quoted code of one response line."""
    line = text.strip(raw)
    # Split at the first " - " only.
    left = text.strip(F.substring_index(line, " - ", 1))
    right = text.strip(F.regexp_replace(line, r"(?s)\A.*? - ", ""))
    inner = F.when(
        left.startswith("[") & left.endswith("]"), text.strip(left.substr(F.lit(2), F.length(left) - 2))
    ).otherwise(left)
    numbered = right.rlike(_NUMBERED)
    code = F.when(numbered, text.strip(F.regexp_extract(right, _NUMBERED, 2))).otherwise(right)
    return F.struct(
        F.when(line.contains(" - "), labels.threat_severity(inner)).alias("severity"),
        F.when(numbered, F.regexp_extract(right, _NUMBERED, 1).try_cast("int")).alias("line"),
        code.alias("code"),
    )


def parse_reviews(responses: DataFrame, response: str = "response") -> DataFrame:
    """One row per verdict: adds ``verdict_ord, severity, line, code``.

    A response that declares the code safe, in whole or in any part, yields none.
    """
    whole = F.upper(text.strip(response))
    safe = whole.isin(fv.SAFE_WORDS)
    for marker in fv.SAFE_MARKERS:
        safe = safe | whole.contains(marker)
    verdicts = F.filter(
        F.transform(text.split_lines(response), _verdict),
        lambda v: v["severity"].isNotNull() & (v["severity"] != "SAFE"),
    )
    kept = [c for c in responses.columns if c != response]
    # An expression, not a column, is exploded: the parse runs once per row.
    parsed = F.posexplode(F.when(~F.coalesce(safe, F.lit(True)), verdicts))
    return responses.select(*kept, parsed.alias("_i", "_v")).select(
        *kept, (F.col("_i") + 1).alias("verdict_ord"), "_v.*"
    )


def _first_lines(codes: Column, content: Column) -> Column:
    """``struct<code, line>`` by code: the line on which a text first holds each code, null without one.

    A code has no line end, so it is looked for in the text as a whole.
    """

    def found(code):
        at = F.call_function("position", code, content)
        return F.struct(code.alias("code"), F.when(at > 0, F.size(F.split(F.substring(content, F.lit(1), at - 1), text.LINE_ENDS, -1))).alias("line"))

    return F.sort_array(F.transform(F.array_distinct(codes), found))


def locate_verdicts(verdicts: DataFrame, files: DataFrame, group: int = VERDICT_GROUP) -> DataFrame:
    """Adds ``line_number`` and ``line_content`` from the reviewed file.

    The line is the one named, else the first that contains the quoted code,
    else line 1.  The content is that line, or the code if there is no such line
    (or no such file).  Texts of files without a review are dropped before any
    exchange.  The verdicts of a path are searched in groups of some ``group``,
    each with the text, and each code once in a group.  An action: paths with
    more verdicts than a group are counted, of which there are few.
    """
    others = [c for c in verdicts.columns if c != "path"]
    counts = written(verdicts.groupBy("path").agg(F.count("*").alias("_n")), "verdict-counts")
    # At most MOST_LARGE paths are larger than a group.
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first().n
    group = max(group, -(-total // MOST_LARGE))
    parts = F.ceil(F.col("_n") / group)
    large = F.broadcast(counts.filter(F.col("_n") > group).select("path", parts.alias("_parts")))
    numbered = verdicts.withColumn("_row", F.monotonically_increasing_id()).join(large, "path", "left")
    salted = numbered.withColumn("_salt", F.pmod("_row", F.coalesce("_parts", F.lit(1))))
    by_group = salted.groupBy("path", "_salt").agg(F.collect_list(F.struct(*others)).alias("_verdicts"))
    salts = counts.select("path", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_salt"))
    texts = files.select("path", "content").join(salts, "path")
    grouped = by_group.join(texts, ["path", "_salt"], "left").select(
        "path", "_verdicts", "content", text.split_lines("content").alias("_lines"),
        _first_lines(F.transform(F.filter("_verdicts", lambda v: v["line"].isNull() & (v["code"] != "")), lambda v: v["code"]), F.col("content")).alias("_places"),
    )

    def located(verdict):
        place = F.get("_places", count_first(F.col("_places"), lambda p: p["code"] < verdict["code"]))
        found = F.when(place["code"] == verdict["code"], place["line"])
        return F.struct(verdict.alias("v"), F.coalesce(verdict["line"], found, F.lit(1)).alias("line_number"))

    def with_content(place):
        number = place["line_number"]
        content = F.when((number >= 1) & (number <= F.size("_lines")), text.rstrip(F.get("_lines", number - 1)))
        quote = F.substring(place["v"]["code"], 1, fv.REVIEW_QUOTE_LIMIT)
        return F.struct(
            *[place["v"][c].alias(c) for c in others if c != "line"], number.alias("line_number"),
            F.coalesce(content, quote).alias("line_content"),
        )

    return grouped.select("path", F.inline(F.transform(F.transform("_verdicts", located), with_content)))


def review_findings(verdicts: DataFrame, files: DataFrame) -> DataFrame:
    """Findings from verdicts ``(path, verdict_ord, severity, line, code)`` on files."""
    located = locate_verdicts(verdicts, files)
    matched = F.when(F.col("code") != "", F.col("code")).otherwise(F.col("line_content"))
    return located.select(
        F.col("path").alias("file"),
        "line_number",
        "line_content",
        F.lit(fv.REVIEW_TYPE).alias("secret_type"),
        F.substring(matched, 1, fv.VALUE_LIMIT).alias("matched_value"),
        labels.review_score("severity").alias("score"),
        "severity",
        F.lit(fv.REVIEW_CATEGORY).alias("category"),
        F.lit(fv.REVIEW_SOURCE).alias("source"),
        F.lit(0.0).alias("entropy"),
        F.lit(False).alias("context_match"),
        F.lit(False).alias("structural_valid"),
        labels.review_confidence("severity").alias("confidence"),
        F.lit(0).alias("taint_count"),
        F.array().cast(TRACES).alias("taint_traces"),
        F.lit(REVIEW_ORD).alias("rule_ord"),
        F.col("verdict_ord").cast("int").alias("match_ord"),
    ).select(*FINDING)
