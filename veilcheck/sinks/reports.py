"""Reports: findings as JSON, SARIF, text and environment files.

Every report is a DataFrame first; the writers put it out as text whose part
files, concatenated in name order, form the document.  Nothing is gathered on
the driver, whatever the number of findings.
"""

from __future__ import annotations

import shutil
from itertools import accumulate
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import labels, text
from ..operators.advice import with_recommendations
from ..operators.findings import deduplicate, rank_findings, sarif_rules
from ..operators.ranking import number_rows_by

# Formats of the text report and of the SARIF document.
RULE_WIDTH = 70
TRACE_RULE_WIDTH = 50
SHOWN_VALUE = 60
SHOWN_LINE = 120
SHOWN_STEP = 100
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SARIF_VERSION = "2.1.0"
SARIF_TAIL = "]}]}"
TOOL_NAME = "veilcheck"
TEXT_TITLE = "🔍 Secret Scanner Report"
NOTHING_FOUND = "✅ Секреты не найдены."
# The place of a document's last line.
_LAST = 1 << 62


def _cut(c: Column, limit: int) -> Column:
    return F.substring(text.strip(c), 1, limit)


def _json_fields() -> list[Column]:

    def step(s):
        return F.struct(
            s["file"].alias("file"), s["line_number"].alias("line"), s["variable"].alias("variable"),
            s["action"].alias("action"), text.strip(s["line_content"]).alias("content"),
        )

    def trace(t):
        return F.struct(
            *[t[c].alias(c) for c in (
                "source_variable", "source_file", "source_line", "sink_type", "sink_file", "sink_line",
            )],
            text.strip(t["sink_content"]).alias("sink_content"),
            F.size(t["steps"]).alias("depth"),
            F.transform(t["steps"], step).alias("steps"),
        )

    return [
        F.col("file"),
        F.col("line_number").alias("line"),
        F.col("secret_type").alias("type"),
        F.col("category"),
        F.col("source"),
        labels.is_review_finding().alias("ai_detection"),
        F.col("severity"),
        F.col("score"),
        F.col("confidence"),
        F.col("entropy"),
        F.col("matched_value").alias("value"),
        F.col("context_match"),
        F.col("structural_valid"),
        text.strip("line_content").alias("line_content"),
        F.transform("taint_traces", trace).alias("taint_traces"),
    ]


def findings_json(findings: DataFrame) -> DataFrame:
    """The 15 fields of a finding in a JSON report."""
    return findings.select(*_json_fields())


def compact_json(findings: DataFrame) -> DataFrame:
    """The 10 fields of a finding next to an HTML report; not deduplicated."""
    return findings.select(
        "file",
        F.col("line_number").alias("line"),
        F.col("secret_type").alias("type"),
        "severity",
        "score",
        "confidence",
        F.col("matched_value").alias("value"),
        "category",
        "source",
        labels.is_review_finding().alias("ai_detection"),
    )


def api_rows(findings: DataFrame, recommendations: bool = False) -> DataFrame:
    """The 11 fields of a finding in a scan response, with its advice on request."""
    is_review = labels.is_review_finding()
    fields = [
        F.col("file"),
        F.col("line_number").alias("line"),
        F.col("secret_type").alias("type"),
        F.col("severity"),
        F.col("score"),
        F.col("confidence"),
        F.col("category"),
        F.substring("matched_value", 1, 80).alias("value"),
        text.strip("line_content").alias("line_content"),
        is_review.alias("ai_detection"),
        labels.detector(is_review).alias("detector"),
    ]
    if recommendations:
        findings = with_recommendations(findings)
        fields.append(F.struct("title", "description", "priority").alias("recommendation"))
    return findings.select(*fields)


def sarif_results(findings: DataFrame) -> DataFrame:
    """Rule id, level, message and place of each finding."""
    return findings.select(
        labels.rule_id("secret_type").alias("rule_id"),
        labels.sarif_level("severity").alias("level"),
        labels.sarif_message(labels.is_review_finding()).alias("message"),
        F.col("file").alias("uri"),
        F.col("line_number").alias("start_line"),
    )


def _trace_lines(t: Column) -> Column:
    def place(file: Column, line: Column) -> Column:
        return F.concat(file, F.lit(":"), line.cast("string"))

    steps = F.transform(t["steps"], lambda s: F.concat(
        F.lit("     ↓  "), place(s["file"], s["line_number"]), F.lit("  ["), s["action"], F.lit("]\n        "),
        _cut(s["line_content"], SHOWN_STEP),
    ))
    return F.concat(
        F.array(
            F.concat(F.lit("  🔗 Taint trace: "), t["source_variable"], F.lit(" → "), t["sink_type"]),
            F.concat(F.lit("     📍 Source : "), place(t["source_file"], t["source_line"])),
        ),
        steps,
        F.array(
            F.concat(F.lit("     💥 Sink   : "), place(t["sink_file"], t["sink_line"]), F.lit("  ["), t["sink_type"],
                     F.lit("]")),
            F.concat(F.lit("        "), _cut(t["sink_content"], SHOWN_STEP)),
        ),
    )


def text_rows(findings: DataFrame) -> DataFrame:
    """``value``: the labelled lines of each finding, without colours; other columns are kept."""
    c = F.col
    traced = F.col("taint_count") > 0
    flags = F.concat_ws(
        ", ",
        F.when(c("context_match"), "context✓"),
        F.when(c("structural_valid"), "structure✓"),
        F.when(traced, F.concat(F.lit("taint:"), F.col("taint_count").cast("string"), F.lit("✓"))),
    )
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("["), c("severity"), F.lit("] "), c("secret_type"), F.lit(" ("), c("category"), F.lit(")"),
                 F.when(labels.is_review_finding(), " 🤖 ML").otherwise("")),
        F.concat(F.lit("  📁 File   : "), c("file"), F.lit(":"), c("line_number").cast("string")),
        F.concat(F.lit("  🔑 Value  : "), text.truncate("matched_value", SHOWN_VALUE)),
        F.concat(F.lit("  📊 Score  : "), c("score").cast("string"), F.lit(" | Entropy: "),
                 c("entropy").cast("string"), F.lit(" | Confidence: "), c("confidence").cast("string")),
        F.concat(F.lit("  🧭 Source : "), c("source")),
        F.when(flags != "", F.concat(F.lit("  🏷  Flags  : "), flags)),
        F.concat(F.lit("  📝 Line   : "), _cut(c("line_content"), SHOWN_LINE)),
        F.when(traced, F.lit("  " + "─" * TRACE_RULE_WIDTH)),
        F.flatten(F.transform("taint_traces", _trace_lines)),
        F.lit("-" * RULE_WIDTH),
    )
    return findings.withColumn("value", lines)


def env_rows(alarms: DataFrame) -> DataFrame:
    """``value``: one environment line per alarm ``(session_id, seq, pattern, line)``, numbered from 0."""
    name = F.upper(F.replace("pattern", F.lit(" "), F.lit("_")))
    numbered = number_rows_by(alarms, ["session_id"], ["seq"])
    return numbered.withColumn("value", F.concat(
        F.lit("FOUND_"), name, F.lit("_"), F.col("idx").cast("string"), F.lit('="'), F.col("line"), F.lit('"'),
    ))


def _document(items: DataFrame, head: DataFrame, tail: str) -> DataFrame:
    """Lines of a JSON document: ``head(value)``, the items ``(idx, value)`` from 1, ``tail``."""
    spark = items.sparkSession
    comma = F.when(F.col("idx") > 1, ",").otherwise("")
    rows = items.select("idx", F.concat(comma, "value").alias("value"))
    end = spark.range(1).select(F.lit(_LAST).alias("idx"), F.lit(tail).alias("value"))
    return head.select(F.lit(0).cast("long").alias("idx"), "value").unionByName(rows).unionByName(end)


def findings_document(findings: DataFrame) -> DataFrame:
    """``(idx, value)``: the lines of the JSON report, deduplicated and in report order."""
    ranked = rank_findings(deduplicate(findings))
    items = ranked.select("idx", F.to_json(F.struct(*_json_fields())).alias("value"))
    head = ranked.agg(
        F.concat(F.lit('{"total": '), F.count("*").cast("string"), F.lit(', "findings": [')).alias("value")
    )
    return _document(items, head, "]}")


def sarif_document(findings: DataFrame) -> DataFrame:
    """``(idx, value)``: the lines of the SARIF 2.1.0 report, deduplicated and in report order."""
    ranked = rank_findings(deduplicate(findings))
    place = F.struct(
        F.struct(
            F.struct(F.col("file").alias("uri")).alias("artifactLocation"),
            F.struct(F.col("line_number").alias("startLine")).alias("region"),
        ).alias("physicalLocation")
    )
    items = ranked.select("idx", F.to_json(F.struct(
        labels.rule_id("secret_type").alias("ruleId"),
        labels.sarif_level("severity").alias("level"),
        F.struct(labels.sarif_message(labels.is_review_finding()).alias("text")).alias("message"),
        F.array(place).alias("locations"),
    )).alias("value"))
    rule = F.struct(
        F.col("rule_id").alias("id"),
        "name",
        F.struct(F.col("name").alias("text")).alias("shortDescription"),
        F.struct(F.col("full_description").alias("text")).alias("fullDescription"),
        F.struct("category", "ai_detection").alias("properties"),
    )
    # One entry per rule of the rule set, so the list is bounded by configuration.
    rule_list = F.transform(
        F.sort_array(F.collect_list(F.struct("first_place", F.to_json(rule).alias("json")))), lambda r: r["json"]
    )
    head = sarif_rules(ranked).agg(F.concat(
        F.lit(f'{{"$schema": "{SARIF_SCHEMA}", "version": "{SARIF_VERSION}", "runs": [{{"tool": {{"driver": '
              f'{{"name": "{TOOL_NAME}", "rules": ['),
        F.array_join(rule_list, ", "), F.lit(']}}, "results": ['),
    ).alias("value"))
    return _document(items, head, SARIF_TAIL)


def text_document(findings: DataFrame) -> DataFrame:
    """``(idx, value)``: the lines of the text report, deduplicated and in report order, with title and summary."""
    ranked = rank_findings(deduplicate(findings))
    totals = ranked.agg(
        F.count("*").alias("found"), *[F.count_if(F.col("severity") == s).alias(s) for s in reversed(fv.SEVERITY_ORDER)],
        F.count_if(F.col("taint_count") > 0).alias("tainted"), F.count_if(labels.is_review_finding()).alias("reviewed"),
    )

    def counted(column, label):
        return F.when(F.col(column) > 0, F.concat(F.lit(label), F.col(column).cast("string")))

    head = F.concat(F.lit(f"\n{TEXT_TITLE}\nFound "), F.col("found").cast("string"), F.lit(" potential secret(s)\n\n" + "=" * RULE_WIDTH))
    tail = F.concat_ws(
        "\n", F.lit("\nSummary:"), *[counted(s, f"  {s}: ") for s in reversed(fv.SEVERITY_ORDER)],
        counted("tainted", "\n  ⚠  Secrets actively used in dangerous sinks: "),
        counted("reviewed", "\n  🤖 Findings from LLM check: "),
    )
    some = F.col("found") > 0
    first = totals.select(F.lit(0).cast("long").alias("idx"), F.when(some, head).otherwise(NOTHING_FOUND).alias("value"))
    last = totals.filter(some).select(F.lit(_LAST).alias("idx"), tail.alias("value"))
    return first.unionByName(text_rows(ranked).select("idx", "value")).unionByName(last)


def _place(source: str, target: str, at: int, size: int) -> None:
    """Copies a part to its place in the whole; run again, it writes the same bytes there."""
    with open(source, "rb") as part, open(target, "r+b") as whole:
        whole.seek(at)
        shutil.copyfileobj(part, whole, 1 << 20)
        if whole.tell() != at + size:
            raise OSError(f"{source} has {whole.tell() - at} bytes; {size} were written")


def _join_parts(spark: SparkSession, parts: list[tuple[str, int]], target: str) -> None:
    """The parts ``(path, size)`` one after the other in the file ``target``, each put there by a task."""
    with open(target, "wb"):
        pass
    starts = accumulate((size for _, size in parts), initial=0)
    places = [(source, target, at, size) for (source, size), at in zip(parts, starts, strict=False)]
    spark.sparkContext.parallelize(places, len(places)).foreach(lambda place: _place(*place))


def write_document(document: DataFrame, path: str, one_file: bool = False) -> None:
    """Writes the lines of a document in order: as range-partitioned text files, or as the one file ``path``.

    One file in a mounted folder (``file:``) is written in ranges, too, which
    tasks then copy to their places in it.  Other stores cannot write within a
    file; there one task sorts and writes all lines.  The file is made beside
    the target and moved there when it is whole, so a task that is run again or
    a job that fails leaves no half document.
    """
    if not one_file:
        document.orderBy("idx").select("value").write.mode("overwrite").text(path)
        return
    spark = document.sparkSession
    beside = f"{path}.writing-{uuid4().hex[:12]}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, folder = hadoop.Path(path), hadoop.Path(beside)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    mounted = store.getUri().getScheme() == "file"
    ordered = document.orderBy("idx") if mounted else document.repartition(1).sortWithinPartitions("idx")
    ordered.select("value").write.text(beside)
    parts = sorted((f.getPath().getName(), f.getLen()) for f in store.listStatus(folder) if f.getPath().getName().startswith("part-"))
    if mounted:
        at = folder.toUri().getPath()
        _join_parts(spark, [(f"{at}/{name}", size) for name, size in parts], f"{at}/whole")
        whole = hadoop.Path(folder, "whole")
    elif len(parts) == 1:
        whole = hadoop.Path(folder, parts[0][0])
    else:
        raise OSError(f"{beside} has {len(parts)} parts; one was written")
    if store.exists(target):
        store.delete(target, True)
    if not store.rename(whole, target):
        raise OSError(f"could not move {whole.toString()} to {path}")
    store.delete(folder, True)


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``sarif_results`` from a report of ``write_sarif``, which has a line for each result.

    The file is read by ranges.  Lines that do not make up one document are an
    error, and so is a line that is no result.
    """
    lines = spark.read.text(path)
    head, tail = F.startswith("value", F.lit('{"$schema"')), F.col("value") == SARIF_TAIL
    later = F.startswith("value", F.lit(","))
    seen = lines.agg(*[F.count_if(c).alias(n) for n, c in (("heads", head), ("tails", tail), ("firsts", ~head & ~tail & ~later), ("later", later))]).first()
    if (seen.heads, seen.tails) != (1, 1) or seen.firsts != min(1, seen.firsts + seen.later):
        raise ValueError(f"{path} is not one whole report: {seen}")
    place = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>"
    result = f"struct<ruleId:string,level:string,message:struct<text:string>,locations:array<{place}>>"
    value = F.when(later, F.substr("value", F.lit(2))).otherwise(F.col("value"))
    rows = lines.filter(~head & ~tail).select(F.from_json(value, result, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    at = F.col("locations")[0]["physicalLocation"]
    return rows.select(
        F.col("ruleId").alias("rule_id"), "level", F.col("message.text").alias("message"),
        at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("start_line"),
    )


def write_findings(findings: DataFrame, path: str, one_file: bool = False) -> None:
    write_document(findings_document(findings), path, one_file)


def write_sarif(findings: DataFrame, path: str, one_file: bool = False) -> None:
    write_document(sarif_document(findings), path, one_file)


def write_text(findings: DataFrame, path: str, one_file: bool = False) -> None:
    write_document(text_document(findings), path, one_file)


def write_env(alarms: DataFrame, path: str) -> None:
    rows = env_rows(alarms)
    rows.orderBy("session_id", "idx").select("value").write.mode("overwrite").text(path)
