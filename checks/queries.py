"""The registered queries, each with the SQL that checks it.

Every query covers the given tables in whole.  A query without SQL is one whose
result has no plain relational form; the tests check it by other means.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from io import BytesIO
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilcheck import fixed_values as fv
from veilcheck.functions import flow, labels, scoring, text
from veilcheck.operators import advice, context, findings, history, matching, paths, review, taint
from veilcheck.operators.catalogue import FULL_ORDER
from veilcheck.operators.rules import RuleSet, add_custom_rules, only_ru_findings, rules
from veilcheck.options import ScanOptions
from veilcheck.plans import pieces, scan
from veilcheck.session import work_dir
from veilcheck.sinks import reports
from veilcheck.sources.archives import explode_archives
from veilcheck.sources.code_tree import read_code_tree
from veilcheck.sources.targets import classify_targets
from veilcheck.sources.tree_source import tree_stream, tree_table
from veilcheck.streaming import files as file_stream
from veilcheck.streaming import lines as line_stream

from . import oracle as o
from .views import spark_view, test_table


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, replaced: dict[str, str] | None = None):
    def register(run):
        REGISTRY[name] = Query(run, sql and o.statement(sql, replaced))
        return run

    return register


# Inputs ---------------------------------------------------------------------


def _code(spark, sf) -> DataFrame:
    return spark_view(spark, sf, "code_files")


def _files(spark, sf, mode="dirs", opts=ScanOptions()) -> DataFrame:
    return paths.skip_paths(_code(spark, sf), mode, opts)


def _documents(spark, sf) -> DataFrame:
    return test_table(spark, f"{sf}/documents.parquet", "doc_id", "text")


def _lines(spark, sf) -> DataFrame:
    """Matchable lines with their context."""
    lines = context.with_context(_files(spark, sf).select("file_id", "path", "content"))
    return lines.filter(text.matchable("line"))


def _matches(spark, sf, rule_set: RuleSet | None = None) -> DataFrame:
    return matching.match_rules(_lines(spark, sf), rule_set)


def _checked(spark, sf) -> DataFrame:
    """Plausible matches with everything that is measured on their value."""
    v = F.col("value")
    plausible = _matches(spark, sf).filter(~scoring.is_false_positive(v))
    return (
        plausible.withColumn("ext", text.file_ext("path"))
        .withColumn("raw_entropy", scoring.shannon_entropy(v))
        .withColumn("structural_valid", scoring.validate_structure("secret_type", v))
        .withColumn("score", scoring.score(
            F.col("base_score"), scoring.is_likely_hash(v), F.col("raw_entropy"), F.col("context_match"),
            F.col("ext"), F.col("structural_valid"),
        ))
    )


def _findings(spark, sf, rule_set: RuleSet | None = None, opts=ScanOptions()) -> DataFrame:
    return scan.scan_content(_files(spark, sf, opts=opts).select("path", "content"), rule_set, opts)


def _reviews(spark, sf) -> DataFrame:
    return review.review_findings(
        review.parse_reviews(spark_view(spark, sf, "reviews").select("path", "response")),
        _code(spark, sf).select("path", "content"),
    )


def _project(path: str = "file") -> Column:
    return F.split(path, "/")[0].alias("project")


def _stream_table(spark, sf) -> DataFrame:
    """One session per file; every fifth one lacks its start marker."""
    code = _code(spark, sf).select(F.col("file_id").alias("session_id"), text.split_lines("content").alias("ls"))
    rows = F.concat(
        F.when(F.col("session_id") % 5 != 4, F.array(F.struct(F.lit(0).alias("seq"), F.lit(fv.STREAM_START).alias("line"))))
        .otherwise(F.array().cast("array<struct<seq:int,line:string>>")),
        F.transform("ls", lambda line, i: F.struct((i + 1).alias("seq"), line.alias("line"))),
        F.array(F.struct((F.size("ls") + 1).alias("seq"), F.lit(fv.STREAM_END).alias("line"))),
    )
    return code.select("session_id", F.inline(rows))


def _as_stream(spark, table: DataFrame, name: str) -> DataFrame:
    """The rows of a table, written out and read back as a stream of limited triggers."""
    folder = work_dir(spark, name)
    table.write.parquet(folder)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 64).parquet(folder)


def _drained(spark, stream: DataFrame, name: str) -> DataFrame:
    out = work_dir(spark, f"{name}-out")
    file_stream.run_available(stream, out, work_dir(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(out)


FINDING = (
    "file, line_number, line_content, secret_type, matched_value, score, severity, category, source, entropy, "
    "context_match, structural_valid, confidence, trace_count, rule_ord, match_ord"
)


def _flat(df: DataFrame, *extra: str) -> DataFrame:
    """Findings with the number of traces in place of the traces."""
    return df.withColumn("trace_count", F.col("taint_count")).select(*extra, *FINDING.split(", "))


def _trace_text(depth: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform("taint_traces", lambda t: F.concat_ws(
        ":", t["source_variable"], t["source_line"].cast("string"), t["sink_type"], t["sink_line"].cast("string"),
        depth(t).cast("string"),
    )), ";")


TRACE_TEXT_SQL = """coalesce((SELECT string_agg(l.var || ':' || l.src || ':' || l.sink || ':' || l.sink_line || ':' || l.depth,
    ';' ORDER BY l.src, l.rule_ord, l.match_ord, l.sink_line)
  FROM touches c JOIN listed l USING (file_id, var, src, sink_line)
  WHERE c.file_id = f.file_id AND c.line_number = f.line_number), '')"""


# Sources --------------------------------------------------------------------


def _stored_tree(spark, sf) -> str:
    """The code files written as files below the shared folder."""
    root = Path(work_dir(spark, "tree").removeprefix("file:"))
    if "://" in str(root):
        raise ValueError(f"a file tree needs a folder that all executors have mounted, not {root}")

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = root / path
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(content.encode())
            yield batch[["path"]]

    _code(spark, sf).select("path", "content").mapInPandas(store, "path string").write.format("noop").mode(
        "overwrite").save()
    return str(root)


def _digests(tree: DataFrame, root: str) -> DataFrame:
    return tree.select(F.expr(f"substring(path, {len(root) + 2})").alias("path"), F.md5("content").alias("digest"))


_TREE_SQL = """
SELECT path, md5(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM files"""


@query("src_1_code_tree", _TREE_SQL)
def _(spark, sf):
    root = _stored_tree(spark, sf)
    return _digests(read_code_tree(spark, root), root)


@query("src_1_lazy_tree", _TREE_SQL)
def _(spark, sf):
    root = _stored_tree(spark, sf)
    return _digests(tree_table(spark, root), root)


@query("src_2_archives", f"""
SELECT 'bundle-' || CAST(file_id // 50 AS VARCHAR) || '.zip' AS archive, path,
  md5(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest
FROM code_files WHERE NOT {o.skipped('path', 'parts')}""")
def _(spark, sf):
    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        buffer = BytesIO()
        with zipfile.ZipFile(buffer, "w") as zf:
            for path, content in zip(batch["path"], batch["content"]):
                zf.writestr(path, content)
        return pd.DataFrame({"archive": [batch["archive"].iloc[0]], "bytes": [buffer.getvalue()]})

    # Fifty files per archive, whatever the size of the table.
    bundle = F.concat(F.lit("bundle-"), F.floor(F.col("file_id") / 50).cast("string"), F.lit(".zip"))
    archives = (
        _code(spark, sf).select(bundle.alias("archive"), "path", "content")
        .groupBy("archive").applyInPandas(pack, "archive string, bytes binary")
    )
    return explode_archives(archives).select("archive", "path", F.md5("content").alias("digest"))


@query("src_3_history", "SELECT path, 'history' AS source, md5(content) AS digest FROM history")
def _(spark, sf):
    blobs = history.history_files(spark_view(spark, sf, "blobs"))
    return blobs.select("path", "source", F.md5("content").alias("digest"))


_REPO = "CASE WHEN path_ord % 3 = 0 THEN 'a' ELSE 'b' END"


@query("src_3_history_repos", f"""
SELECT repo, 'history/' || substr(commit_id, 1, 12) || '/' || path AS path, md5(content) AS digest
FROM (SELECT *, {_REPO} AS repo FROM blobs
      WHERE commit_ord >= CASE WHEN path_ord % 3 = 0 THEN 0 ELSE 1 END AND NOT {o.skipped('path', 'parts')}
      QUALIFY dense_rank() OVER (PARTITION BY repo ORDER BY commit_ord) <= 2)
WHERE content <> ''
QUALIFY row_number() OVER (PARTITION BY repo, blob_hash ORDER BY commit_ord, path_ord) = 1""")
def _(spark, sf):
    # Repository b lacks the newest commit of repository a, so their newest two differ.
    blobs = spark_view(spark, sf, "blobs").withColumn("repo", F.expr(_REPO)).filter("repo = 'a' OR commit_ord >= 1")
    found = history.history_files(blobs, 2, repo=["repo"])
    return found.select("repo", "path", F.md5("content").alias("digest"))


@query("src_4_rules", "SELECT r.*, coalesce(n, 0) AS matches FROM (VALUES " + ", ".join(
    f"({i}, {o.text_literal(r.name)}, {r.score}, {o.text_literal(r.category)}, {r.group})"
    for i, r in enumerate(rules())
) + """) AS r(rule_ord, secret_type, base_score, category, group_idx)
LEFT JOIN (SELECT rule_ord, count(*) AS n FROM matches GROUP BY ALL) USING (rule_ord)""")
def _(spark, sf):
    used = _matches(spark, sf).groupBy("rule_ord").agg(F.count("*").alias("matches"))
    catalogue = rules().to_df(spark).select("rule_ord", "secret_type", "base_score", "category", "group_idx")
    return catalogue.join(used, "rule_ord", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


@query("src_4_rules_full", "SELECT r.*, coalesce(n, 0) AS matches FROM (VALUES " + ", ".join(
    f"({i}, {o.text_literal(name)})" for i, name in enumerate(FULL_ORDER)
) + """) AS r(rule_ord, secret_type)
LEFT JOIN (SELECT secret_type, count(*) AS n FROM full_matches GROUP BY ALL) USING (secret_type)""")
def _(spark, sf):
    used = _matches(spark, sf, rules("full")).groupBy("secret_type").agg(F.count("*").alias("matches"))
    catalogue = rules("full").to_df(spark).select("rule_ord", "secret_type")
    return catalogue.join(used, "secret_type", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


_HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_PATH = r"regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"


@query("src_5_targets", rf"""
SELECT page_id, url, source_kind, CASE WHEN source_kind <> 'git' THEN name END AS file_name
FROM (SELECT *, CASE WHEN starts_with(url, 'git@') THEN 'git'
    WHEN regexp_matches(url, '(?i)^(https?|ssh):') AND ends_with(path, '.git') THEN 'git'
    WHEN regexp_matches(url, '(?i)^https?:') AND contains({_HOST}, 'github.com') THEN 'git'
    WHEN {o.suffix_of('name')} = '.zip' THEN 'zip' ELSE 'file' END AS source_kind
  FROM (SELECT *, CASE WHEN {o.name_of('path')} = '' THEN 'downloaded_target' ELSE {o.name_of('path')} END AS name
        FROM (SELECT *, {_PATH} AS path FROM targets)))""")
def _(spark, sf):
    return classify_targets(spark_view(spark, sf, "targets"))


@query("src_6_lines", o.exploded("doc_id", "documents", "text"))
def _(spark, sf):
    return context.numbered_lines(_documents(spark, sf), "text")


@query("src_7_path_facts", f"""
SELECT file_id, {o.name_of('path')} AS file_name, {o.suffix_of('path')} AS suffix, {o.ext_of('path')} AS ext
FROM code_files""")
def _(spark, sf):
    return _code(spark, sf).select(
        "file_id", text.file_name("path").alias("file_name"), text.suffix("path").alias("suffix"),
        text.file_ext("path").alias("ext"),
    )


# Filters --------------------------------------------------------------------


@query("flt_1_skip_paths", f"""
SELECT file_id, path, {o.skipped('path', 'dirs')} AS skipped_dirs, {o.skipped('path', 'parts')} AS skipped_parts
FROM code_files""")
def _(spark, sf):
    return _code(spark, sf).select(
        "file_id", "path", paths.is_skipped("path", "dirs").alias("skipped_dirs"),
        paths.is_skipped("path", "parts").alias("skipped_parts"),
    )


INCLUDE, EXCLUDE = ["*.py", "*/deploy/*", ".env"], ["src1/*", "*/chain.py"]


def _globs(path: str) -> str:
    base = o.name_of(path)
    return (
        f"((regexp_matches({path}, '(?s)\\.py$') OR regexp_matches({path}, '(?s)/deploy/') OR {base} = '.env') "
        f"AND NOT (starts_with({path}, 'src1/') OR ends_with({path}, '/chain.py')))"
    )


@query("flt_2_globs", f"SELECT file_id, path FROM code_files WHERE {_globs('path')}")
def _(spark, sf):
    return paths.glob_filter(_code(spark, sf), INCLUDE, EXCLUDE).select("file_id", "path")


@query("flt_3_matchable", f"""
SELECT doc_id, line_number FROM ({o.exploded('doc_id', 'documents', 'text')}) WHERE {o.matchable('line')}""")
def _(spark, sf):
    lines = context.numbered_lines(_documents(spark, sf), "text")
    return lines.filter(text.matchable("line")).select("doc_id", "line_number")


@query("flt_4_false_positives", f"""
SELECT file_id, line_number, rule_ord, match_ord, value, {o.is_false_positive('value')} AS false_positive
FROM matches""")
def _(spark, sf):
    return _matches(spark, sf).select(
        "file_id", "line_number", "rule_ord", "match_ord", "value",
        scoring.is_false_positive("value").alias("false_positive"),
    )


@query("flt_5_low_score", """
SELECT file_id, line_number, rule_ord, match_ord, CAST(score AS INTEGER) AS score FROM hits""")
def _(spark, sf):
    return findings.drop_low_score(_checked(spark, sf)).select(
        "file_id", "line_number", "rule_ord", "match_ord", "score"
    )


@query("flt_6_min_severity", f"SELECT {FINDING} FROM findings WHERE {o.rank('severity')} >= 2")
def _(spark, sf):
    return _flat(findings.min_severity(_findings(spark, sf), "HIGH"))


@query("flt_7_risky", f"""
SELECT file_id, regexp_matches(content, {o.text_literal(o.RISKY)}) AS risky FROM scripts""")
def _(spark, sf):
    return spark_view(spark, sf, "scripts").select("file_id", review.looks_risky("content").alias("risky"))


@query("flt_8_review_eligible", f"""
SELECT file_id, path FROM eligible WHERE regexp_matches(content, {o.text_literal(o.RISKY)})""")
def _(spark, sf):
    return review.review_eligible(spark_view(spark, sf, "scripts")).select("file_id", "path")


# Joins ----------------------------------------------------------------------


@query("jn_1_match_rules", "SELECT file_id, line_number, rule_ord, secret_type, match_ord, value FROM matches")
def _(spark, sf):
    return _matches(spark, sf).select("file_id", "line_number", "rule_ord", "secret_type", "match_ord", "value")


@query("jn_1_match_rules_full", "SELECT file_id, line_number, rule_ord, secret_type, match_ord, value FROM full_matches")
def _(spark, sf):
    return _matches(spark, sf, rules("full")).select(
        "file_id", "line_number", "rule_ord", "secret_type", "match_ord", "value"
    )


@query("jn_1_match_documents", "SELECT doc_id, line_number, secret_type, match_ord, value FROM ("
       + o.matches(rules("full"), "doc_lines", "doc_id") + ")")
def _(spark, sf):
    lines = context.numbered_lines(_documents(spark, sf), "text")
    return matching.match_rules(lines.filter(text.matchable("line")), rules("full")).select(
        "doc_id", "line_number", "secret_type", "match_ord", "value"
    )


@query("jn_2_attach_traces", f"""
SELECT f.file, f.line_number, f.rule_ord, f.match_ord, {TRACE_TEXT_SQL} AS traces FROM findings f""")
def _(spark, sf):
    flows = scan.file_flows(_files(spark, sf).select("path", "content"))
    return taint.attach_traces(_findings(spark, sf), flows).select(
        "file", "line_number", "rule_ord", "match_ord", _trace_text(lambda t: F.size(t["steps"])).alias("traces")
    )


@query("jn_3_recommendations", """
SELECT file, line_number, rule_ord, match_ord, secret_type, title, md5(description) AS description, priority
FROM advised""")
def _(spark, sf):
    return advice.with_recommendations(_findings(spark, sf)).select(
        "file", "line_number", "rule_ord", "match_ord", "secret_type", "title",
        F.md5("description").alias("description"), "priority",
    )


@query("jn_4_regional", """
SELECT secret_type, count(*) AS found FROM full_findings SEMI JOIN ru_names USING (secret_type) GROUP BY ALL""")
def _(spark, sf):
    return only_ru_findings(_findings(spark, sf, rules("full"))).groupBy("secret_type").agg(
        F.count("*").alias("found")
    )


@query("jn_5_locate_verdicts", "SELECT path, verdict_ord, severity, code, line_number, line_content FROM located")
def _(spark, sf):
    verdicts = review.parse_reviews(spark_view(spark, sf, "reviews").select("path", "response"))
    return review.locate_verdicts(verdicts, _code(spark, sf).select("path", "content")).select(
        "path", "verdict_ord", "severity", "code", "line_number", "line_content"
    )


_BY_PROJECT = """
SELECT m.project, m.vulnerable, m.language, coalesce(n, 0) AS findings FROM manifest m
LEFT JOIN (SELECT string_split(file, '/')[1] AS project, count(*) AS n FROM findings GROUP BY ALL) USING (project)"""


@query("jn_6_corpus", _BY_PROJECT)
def _(spark, sf):
    found = _findings(spark, sf).withColumn("project", _project())
    return findings.corpus_by_project(found, spark_view(spark, sf, "manifest"))


# Aggregates -----------------------------------------------------------------

_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in reversed(fv.SEVERITY_ORDER))


@query("agg_1_severity_summary", f"SELECT {_COUNTS} FROM findings")
def _(spark, sf):
    return findings.severity_summary(_findings(spark, sf))


@query("agg_1_severity_summary_full", f"SELECT {_COUNTS} FROM full_findings")
def _(spark, sf):
    return findings.severity_summary(_findings(spark, sf, rules("full")))


@query("agg_2_by_type", """
SELECT secret_type, count(*) AS found, priority, title FROM advised GROUP BY ALL""")
def _(spark, sf):
    return advice.findings_by_type(_findings(spark, sf)).select("secret_type", "found", "priority", "title")


@query("agg_3_exposure", """
SELECT count(*) FILTER (trace_count > 0) AS tainted,
  count(*) FILTER (secret_type = 'AI Security' OR category = 'ai_security' OR starts_with(source, 'ai:')) AS review_findings
FROM (SELECT * EXCLUDE (file_id) FROM findings UNION ALL BY NAME SELECT * FROM review_findings)""")
def _(spark, sf):
    return findings.exposure_counts(findings.union_findings(_findings(spark, sf), _reviews(spark, sf)))


@query("agg_4_ci_gate", f"""
SELECT project, failed, CAST(failed AS INTEGER) AS exit_code FROM (
  SELECT m.project, coalesce(bool_or({o.rank('f.severity')} >= 3), false) AS failed
  FROM manifest m LEFT JOIN findings f ON string_split(f.file, '/')[1] = m.project AND {o.rank('f.severity')} >= 1
  GROUP BY ALL)""")
def _(spark, sf):
    kept = findings.min_severity(_findings(spark, sf), "MEDIUM").withColumn("project", _project())
    return findings.ci_gate(kept, "CRITICAL", ["project"], spark_view(spark, sf, "manifest"))


@query("agg_5_sarif_rules", """
SELECT upper(replace(secret_type, ' ', '_')) AS rule_id, arg_max(secret_type, idx) AS name,
  arg_max(category, idx) AS category, false AS ai_detection,
  'Detected potential secret: ' || arg_max(secret_type, idx) AS full_description,
  row_number() OVER (ORDER BY min(idx)) AS place
FROM ranked GROUP BY 1""")
def _(spark, sf):
    # As many rows as rules, so one window numbers them.
    found = findings.sarif_rules(findings.deduplicate(_findings(spark, sf)))
    by_place = F.row_number().over(Window.orderBy("first_place"))
    return found.select(
        "rule_id", "name", "category", "ai_detection", "full_description", by_place.cast("long").alias("place")
    )


@query("agg_6_corpus_evaluation", f"""
SELECT language, count(*) FILTER (vulnerable) AS vulnerable,
  count(*) FILTER (vulnerable AND findings > 0) AS vulnerable_found, count(*) FILTER (NOT vulnerable) AS clean,
  count(*) FILTER (NOT vulnerable AND findings = 0) AS clean_quiet
FROM ({_BY_PROJECT}) GROUP BY ALL""")
def _(spark, sf):
    found = _findings(spark, sf).withColumn("project", _project())
    return findings.evaluate_corpus(found, spark_view(spark, sf, "manifest"))


@query("agg_6_corpus_verdict", f"""
SELECT *, vulnerable_found >= greatest(5, vulnerable - 6) AS recall_ok, clean_quiet >= greatest(8, clean - 2) AS quiet_ok
FROM (SELECT count(*) FILTER (vulnerable) AS vulnerable,
  count(*) FILTER (vulnerable AND findings > 0) AS vulnerable_found, count(*) FILTER (NOT vulnerable) AS clean,
  count(*) FILTER (NOT vulnerable AND findings = 0) AS clean_quiet FROM ({_BY_PROJECT}))""")
def _(spark, sf):
    found = _findings(spark, sf).withColumn("project", _project())
    return findings.corpus_verdict(findings.evaluate_corpus(found, spark_view(spark, sf, "manifest")))


@query("agg_7_scan_summary", f"""
SELECT count(*) AS total, {_COUNTS}, count(*) FILTER (source = 'ai:nvidia') AS review_findings
FROM (SELECT * EXCLUDE (file_id) FROM findings UNION ALL BY NAME SELECT * FROM review_findings)""")
def _(spark, sf):
    return findings.scan_summary(findings.union_findings(_findings(spark, sf), _reviews(spark, sf)))


# Order and windows ----------------------------------------------------------


@query("win_1_context", "SELECT file_id, line_number, context_match FROM lines")
def _(spark, sf):
    return context.with_context(_files(spark, sf)).select("file_id", "line_number", "context_match")


@query("win_2_first_blob", """
SELECT blob_hash, commit_ord, path_ord, path FROM blobs
QUALIFY row_number() OVER (PARTITION BY blob_hash ORDER BY commit_ord, path_ord) = 1""")
def _(spark, sf):
    blobs = spark_view(spark, sf, "blobs")
    return history.first_blob(blobs).select("blob_hash", "commit_ord", "path_ord", "path")


@query("win_3_deduplicate", f"SELECT {FINDING} FROM distinct_findings")
def _(spark, sf):
    return _flat(findings.deduplicate(_findings(spark, sf)))


@query("win_4_ranked", f"SELECT idx, {FINDING} FROM ranked")
def _(spark, sf):
    return _flat(findings.rank_findings(findings.deduplicate(_findings(spark, sf))), "idx")


@query("win_4_ranked_full", "SELECT idx, file, line_number, rule_ord, secret_type, match_ord, score FROM full_ranked")
def _(spark, sf):
    ranked = findings.rank_findings(findings.deduplicate(_findings(spark, sf, rules("full")).drop("taint_traces")))
    return ranked.select("idx", "file", "line_number", "rule_ord", "secret_type", "match_ord", "score")


@query("win_5_newest_commits", """
SELECT commit_ord, path, blob_hash FROM blobs
WHERE commit_ord IN (SELECT DISTINCT commit_ord FROM blobs ORDER BY commit_ord LIMIT 2)""")
def _(spark, sf):
    return history.newest_commits(spark_view(spark, sf, "blobs"), 2).select("commit_ord", "path", "blob_hash")


@query("win_6_review_cap", """
SELECT string_split(path, '/')[1] AS scan, path FROM eligible
QUALIFY row_number() OVER (PARTITION BY string_split(path, '/')[1] ORDER BY path) <= 3""")
def _(spark, sf):
    scripts = review.review_eligible(spark_view(spark, sf, "scripts"), scan_all=True)
    eligible = scripts.select(F.split("path", "/")[0].alias("scan"), "path")
    return review.cap_files(eligible, 3, ["scan"])


@query("srt_1_report_order", f"SELECT {FINDING} FROM findings")
def _(spark, sf):
    return findings.in_report_order(_flat(_findings(spark, sf)))


_HISTORY_FILES = f"""
SELECT CAST(1000000 + row_number() OVER (ORDER BY path) AS BIGINT) AS file_id, path, content, {o.ext_of('path')} AS ext
FROM history"""


@query("uni_1_append", """
SELECT source, severity, count(*) AS found
FROM (SELECT source, severity FROM findings UNION ALL SELECT source, severity FROM review_findings) GROUP BY ALL""", {
    "files": o.SUBQUERIES["files"].replace("SELECT *,", "SELECT file_id, path, content,") + " UNION ALL " + _HISTORY_FILES})
def _(spark, sf):
    past = scan.scan_content(history.history_files(spark_view(spark, sf, "blobs")))
    every = findings.union_findings(_findings(spark, sf), past, _reviews(spark, sf))
    return every.groupBy("source", "severity").agg(F.count("*").alias("found"))


@query("uni_2_custom_rules", f"SELECT {FINDING} FROM custom_findings")
def _(spark, sf):
    # The last one would hold a task on any long line, and is left out with a warning.
    custom = [*o.CUSTOM_RULES, {"name": "Backtracking", "regex": r"(\w+\s?)+=$", "score": 9}]
    return _flat(_findings(spark, sf, add_custom_rules(spark, rules(), custom)))


# Scalars --------------------------------------------------------------------

_MATCH = "file_id, line_number, rule_ord, match_ord"
_MATCH_KEY = _MATCH.split(", ")


def _scalar(name: str, sql: str, build: Callable[[], Column]):
    """A function of matches, checked on every match."""

    @query(name, f"SELECT {_MATCH}, {sql} AS result FROM matches")
    def _(spark, sf):
        return _matches(spark, sf).select(*_MATCH_KEY, build().alias("result"))


_scalar("scl_1_value", "value", lambda: F.col("value"))
_scalar("scl_2_entropy", o.round2(o.entropy("value")), lambda: scoring.round2(scoring.shannon_entropy("value")))
_scalar("scl_3_likely_hash", o.is_hash("value"), lambda: scoring.is_likely_hash("value"))
_scalar("scl_4_structure", o.structure("secret_type", "value"),
        lambda: scoring.validate_structure("secret_type", "value"))
_scalar("scl_8_truncate", "CASE WHEN length(value) > 28 THEN substr(value, 1, 28) || '...' ELSE value END",
        lambda: text.truncate("value", 28))


@query("scl_5_score", f"SELECT {_MATCH}, CAST(score AS INTEGER) AS score FROM scored")
def _(spark, sf):
    return _checked(spark, sf).select(*_MATCH_KEY, "score")


@query("scl_6_severity", f"""
SELECT {_MATCH}, {o.severity('score')} AS severity, {o.severity('score', 15, 10, 6)} AS strict_severity FROM scored""")
def _(spark, sf):
    strict = ScanOptions(threshold_critical=15, threshold_high=10, threshold_medium=6)
    return _checked(spark, sf).select(
        *_MATCH_KEY, scoring.severity("score").alias("severity"),
        scoring.severity("score", strict).alias("strict_severity"),
    )


@query("scl_7_confidence", f"""
SELECT {_MATCH}, {o.confidence('score', o.round2('raw_entropy'), 'structural_valid', 'context_match')} AS confidence
FROM scored""")
def _(spark, sf):
    ent2 = scoring.round2(F.col("raw_entropy"))
    return _checked(spark, sf).select(*_MATCH_KEY, scoring.confidence(
        "score", ent2, "structural_valid", F.col("context_match")).alias("confidence"))


@query("scl_9_assigned_variable", f"""
SELECT file_id, line_number, nullif(regexp_extract(line, '{o.VARIABLE}', 1), '') AS variable FROM lines""")
def _(spark, sf):
    return context.numbered_lines(_files(spark, sf)).select(
        "file_id", "line_number", flow.assigned_variable("line").alias("variable")
    )


@query("scl_10_sink_type", f"SELECT file_id, line_number, {o.sink('line')} AS sink_type FROM lines")
def _(spark, sf):
    return context.numbered_lines(_files(spark, sf)).select(
        "file_id", "line_number", flow.sink_type("line").alias("sink_type")
    )


_EVERY = "(SELECT * EXCLUDE (file_id) FROM findings UNION ALL BY NAME SELECT * FROM review_findings)"


@query("scl_11_review_flags", f"""
SELECT file, line_number, rule_ord, match_ord, source = 'ai:nvidia' AS is_review,
  CASE WHEN source = 'ai:nvidia' THEN 'llm' ELSE 'patterns' END AS detector FROM {_EVERY}""")
def _(spark, sf):
    is_review = labels.is_review_finding()
    return findings.union_findings(_findings(spark, sf), _reviews(spark, sf)).select(
        "file", "line_number", "rule_ord", "match_ord", is_review.alias("is_review"),
        labels.detector(is_review).alias("detector"),
    )


_SARIF = """
SELECT upper(replace(secret_type, ' ', '_')) AS rule_id,
  CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 'error' ELSE 'warning' END AS level,
  secret_type || ' (' || severity || ') at ' || file || ':' || line_number || '; confidence=' || confidence
    || CASE WHEN source = 'ai:nvidia' THEN ' [LLM]' ELSE '' END AS message,
  file AS uri, line_number AS start_line"""


@query("scl_12_sarif_fields", f"{_SARIF} FROM {_EVERY}")
def _(spark, sf):
    return reports.sarif_results(findings.union_findings(_findings(spark, sf), _reviews(spark, sf)))


@query("scl_13_numbered_text", """
SELECT file_id, string_agg('L' || line_number || ': ' || line, chr(10) ORDER BY line_number) AS prompt_text
FROM lines GROUP BY ALL""")
def _(spark, sf):
    return _files(spark, sf).select("file_id", text.numbered_text(text.split_lines("content")).alias("prompt_text"))


@query("scl_14_threat_words", f"""
SELECT file_id, verdict_ord, severity,
  CASE severity WHEN 'LOW' THEN 3 WHEN 'MEDIUM' THEN 6 WHEN 'HIGH' THEN 9 ELSE 13 END AS score,
  CASE WHEN severity IN ('LOW', 'MEDIUM') THEN 0.55::DOUBLE ELSE 0.7::DOUBLE END AS confidence
FROM verdicts""")
def _(spark, sf):
    return review.parse_reviews(spark_view(spark, sf, "reviews")).select(
        "file_id", "verdict_ord", "severity", labels.review_score("severity").alias("score"),
        labels.review_confidence("severity").alias("confidence"),
    )


# Flow and whole scans -------------------------------------------------------


@query("tnt_1_traces", """
SELECT c.path, l.var AS source_variable, l.src AS source_line, l.sink AS sink_type, l.sink_line, l.sink_content,
  CAST(l.depth AS INTEGER) AS depth, l.rule_ord, l.match_ord
FROM listed l JOIN files c USING (file_id)""")
def _(spark, sf):
    files = _files(spark, sf).select("path", "content").filter(text.file_ext("path").isin(fv.FLOW_EXTENSIONS))
    hits = scan.detect(files, with_traces=False).filter("variable is not null")
    # Every secret by itself, so that its rule can be told.
    listed = hits.select("path", "rule_ord", "match_ord", F.array(F.struct("variable", "line_number")).alias("secrets"))
    lines = files.select("path", text.split_lines("content").alias("lines")).join(listed, "path")
    return taint.taint_traces(lines).select(
        F.col("source_file").alias("path"), "source_variable", "source_line", "sink_type", "sink_line", "sink_content",
        F.size("steps").alias("depth"), "rule_ord", "match_ord",
    )


@query("tnt_2_secret_variables", """
SELECT path, var AS variable, src AS line_number, count(*) AS listed FROM secrets GROUP BY ALL""")
def _(spark, sf):
    hits = scan.detect(_files(spark, sf).select("path", "content"), with_traces=False)
    secret = hits.filter("variable is not null").filter(text.file_ext("path").isin(fv.FLOW_EXTENSIONS))
    return secret.groupBy("path", "variable", "line_number").agg(F.count("*").alias("listed"))


@query("tnt_3_rescored", f"""
SELECT file, line_number, rule_ord, match_ord, score, severity, confidence, trace_count FROM findings""")
def _(spark, sf):
    return _flat(_findings(spark, sf)).select(
        "file", "line_number", "rule_ord", "match_ord", "score", "severity", "confidence", "trace_count"
    )


@query("scan_content", f"SELECT {FINDING} FROM findings")
def _(spark, sf):
    return _flat(_findings(spark, sf))


@query("scan_pieces", f"SELECT {FINDING} FROM findings")
def _(spark, sf):
    # Pieces of sixteen lines, so that most of the small test files have several.
    cut = pieces.cut_files(_files(spark, sf).select("path", "content"), 16)
    return _flat(pieces.scan_pieces(cut))


@query("scan_content_full", f"SELECT {FINDING} FROM full_findings")
def _(spark, sf):
    return _flat(_findings(spark, sf, rules("full")))


@query("run_scan", f"""
SELECT {FINDING} FROM (SELECT * EXCLUDE (file_id) FROM findings UNION ALL BY NAME SELECT * FROM review_findings)
WHERE {o.rank('severity')} >= 1 AND {_globs('file')}""", {
    "files": o.SUBQUERIES["files"].replace("SELECT *,", "SELECT file_id, path, content,")
    + f" AND {_globs('path')} UNION ALL " + _HISTORY_FILES})
def _(spark, sf):
    return _flat(scan.run_scan(
        _code(spark, sf).select("path", "content"), spark_view(spark, sf, "blobs"), _reviews(spark, sf),
        min_severity="MEDIUM", include=INCLUDE, exclude=EXCLUDE,
    ))


# Code review ----------------------------------------------------------------


@query("ai_1_parse_reviews", "SELECT file_id, path, verdict_ord, severity, line, code FROM verdicts")
def _(spark, sf):
    return review.parse_reviews(spark_view(spark, sf, "reviews"))


@query("ai_2_review_findings", f"SELECT {FINDING} FROM review_findings")
def _(spark, sf):
    return _flat(_reviews(spark, sf))


@query("ai_3_review_batch", f"""
SELECT path, (SELECT string_agg('L' || i || ': ' || ls[i], chr(10) ORDER BY i) FROM range(1, len(ls) + 1) t(i)) AS prompt_text
FROM (SELECT path, {o.lines_of('content')} AS ls FROM eligible
      WHERE regexp_matches(content, {o.text_literal(o.RISKY)}) ORDER BY path LIMIT 50)""")
def _(spark, sf):
    return review.review_batch(spark_view(spark, sf, "scripts"))


# Sinks ----------------------------------------------------------------------


@query("snk_1_findings_json", f"""
SELECT f.file, f.line_number AS line, f.secret_type AS type, f.category, f.source, false AS ai_detection, f.severity,
  f.score, f.confidence, f.entropy, f.matched_value AS value, f.context_match, f.structural_valid,
  {o.strip('f.line_content')} AS line_content, {TRACE_TEXT_SQL} AS taint_traces
FROM distinct_findings f""")
def _(spark, sf):
    traces = _trace_text(lambda t: t["depth"])
    return reports.findings_json(findings.deduplicate(_findings(spark, sf))).withColumn("taint_traces", traces)


@query("snk_2_sarif", f"{_SARIF} FROM distinct_findings")
def _(spark, sf):
    return reports.sarif_results(findings.deduplicate(_findings(spark, sf)))


@query("snk_2_sarif_file", f"{_SARIF} FROM distinct_findings")
def _(spark, sf):
    # The one file, read back by its lines.
    path = f"{work_dir(spark, 'report')}.sarif"
    reports.write_sarif(_findings(spark, sf), path, one_file=True)
    return reports.read_sarif(spark, path)


@query("snk_3_compact_json", """
SELECT file, line_number AS line, secret_type AS type, severity, score, confidence, matched_value AS value, category,
  source, false AS ai_detection FROM findings""")
def _(spark, sf):
    return reports.compact_json(_findings(spark, sf))


@query("snk_3_api_rows", f"""
SELECT file, line_number AS line, secret_type AS type, severity, score, confidence, category,
  substr(matched_value, 1, 80) AS value, {o.strip('line_content')} AS line_content, false AS ai_detection,
  'patterns' AS detector, title, priority FROM advised""")
def _(spark, sf):
    return reports.api_rows(_findings(spark, sf), recommendations=True).withColumn(
        "title", F.col("recommendation.title")).withColumn("priority", F.col("recommendation.priority")).drop(
        "recommendation")


_TEXT_ROWS = rf"""
SELECT idx, concat_ws(chr(10), '[' || severity || '] ' || secret_type || ' (' || category || ')',
  '  📁 File   : ' || file || ':' || line_number,
  '  🔑 Value  : ' || CASE WHEN length(matched_value) > 60 THEN substr(matched_value, 1, 60) || '...' ELSE matched_value END,
  '  📊 Score  : ' || score || ' | Entropy: ' || entropy || ' | Confidence: ' || confidence,
  '  🧭 Source : ' || source,
  '  🏷  Flags  : ' || nullif(concat_ws(', ', CASE WHEN context_match THEN 'context✓' END,
     CASE WHEN structural_valid THEN 'structure✓' END, CASE WHEN trace_count > 0 THEN 'taint:' || trace_count || '✓' END), ''),
  '  📝 Line   : ' || substr({o.strip('line_content')}, 1, 120),
  CASE WHEN trace_count > 0 THEN '  ' || repeat('─', 50) END,
  (SELECT string_agg('  🔗 Taint trace: ' || l.var || ' → ' || l.sink || chr(10) || '     📍 Source : ' || r.file || ':' || l.src
      || coalesce((SELECT string_agg(chr(10) || '     ↓  ' || r.file || ':' || s.line_number || '  [propagated from '
           || s.origin || ']' || chr(10) || '        ' || substr({o.strip('s.line')}, 1, 100), '' ORDER BY s.line_number)
         FROM (SELECT x.*, (SELECT t.name FROM tainted t JOIN assigns a
                  ON a.file_id = x.file_id AND a.line_number = x.line_number
                  WHERE t.file_id = x.file_id AND t.var = x.var AND t.src = x.src AND t.since < x.line_number
                    AND list_contains(a.words, t.name) ORDER BY t.since LIMIT 1) AS origin FROM steps x) s
         WHERE s.file_id = l.file_id AND s.var = l.var AND s.src = l.src AND s.line_number <= l.sink_line), '')
      || chr(10) || '     💥 Sink   : ' || r.file || ':' || l.sink_line || '  [' || l.sink || ']' || chr(10)
      || '        ' || substr({o.strip('l.sink_content')}, 1, 100),
      chr(10) ORDER BY l.src, l.rule_ord, l.match_ord, l.sink_line)
   FROM touches c JOIN listed l USING (file_id, var, src, sink_line)
   WHERE c.file_id = r.file_id AND c.line_number = r.line_number),
  repeat('-', 70)) AS value
FROM ranked r"""


@query("snk_4_text_rows", _TEXT_ROWS)
def _(spark, sf):
    ranked = findings.rank_findings(findings.deduplicate(_findings(spark, sf)))
    return reports.text_rows(ranked).select("idx", "value")


_LAST = "4611686018427387904"
_TOTALS = f"""
SELECT count(*) AS found, {_COUNTS}, count(*) FILTER (trace_count > 0) AS tainted FROM ranked"""


@query("snk_4_text_document", f"""
SELECT CAST(0 AS BIGINT) AS idx, chr(10) || '{reports.TEXT_TITLE}' || chr(10) || 'Found ' || found
  || ' potential secret(s)' || chr(10) || chr(10) || repeat('=', 70) AS value FROM ({_TOTALS})
UNION ALL SELECT idx, value FROM ({_TEXT_ROWS})
UNION ALL SELECT {_LAST}, concat_ws(chr(10), chr(10) || 'Summary:',
  {", ".join(f"CASE WHEN {s} > 0 THEN '  {s}: ' || {s} END" for s in reversed(fv.SEVERITY_ORDER))},
  CASE WHEN tainted > 0 THEN chr(10) || '  ⚠  Secrets actively used in dangerous sinks: ' || tainted END) FROM ({_TOTALS})""")
def _(spark, sf):
    return reports.text_document(_findings(spark, sf))


_TRACES_JSON = f"""
coalesce((SELECT list({{'source_variable': l.var, 'source_file': r.file, 'source_line': l.src, 'sink_type': l.sink,
    'sink_file': r.file, 'sink_line': l.sink_line, 'sink_content': {o.strip('l.sink_content')}, 'depth': l.depth,
    'steps': coalesce((SELECT list({{'file': r.file, 'line': s.line_number, 'variable': s.lhs,
          'action': 'propagated from ' || s.origin, 'content': {o.strip('s.line')}}} ORDER BY s.line_number)
         FROM (SELECT x.*, (SELECT t.name FROM tainted t JOIN assigns a
                  ON a.file_id = x.file_id AND a.line_number = x.line_number
                  WHERE t.file_id = x.file_id AND t.var = x.var AND t.src = x.src AND t.since < x.line_number
                    AND list_contains(a.words, t.name) ORDER BY t.since LIMIT 1) AS origin FROM steps x) s
         WHERE s.file_id = l.file_id AND s.var = l.var AND s.src = l.src AND s.line_number <= l.sink_line), [])}}
      ORDER BY l.src, l.rule_ord, l.match_ord, l.sink_line)
   FROM touches c JOIN listed l USING (file_id, var, src, sink_line)
   WHERE c.file_id = r.file_id AND c.line_number = r.line_number), [])"""


@query("snk_1_json_document", f"""
SELECT CAST(0 AS BIGINT) AS idx, '{{"total": ' || count(*) || ', "findings": [' AS value FROM ranked
UNION ALL SELECT idx, CASE WHEN idx > 1 THEN ',' ELSE '' END || CAST(to_json({{'file': file, 'line': line_number,
  'type': secret_type, 'category': category, 'source': source, 'ai_detection': false, 'severity': severity, 'score': score,
  'confidence': confidence, 'entropy': entropy, 'value': matched_value, 'context_match': context_match,
  'structural_valid': structural_valid, 'line_content': {o.strip('line_content')}, 'taint_traces': {_TRACES_JSON}}}) AS VARCHAR)
FROM ranked r
UNION ALL SELECT {_LAST}, ']}}'""")
def _(spark, sf):
    return reports.findings_document(_findings(spark, sf))


@query("snk_2_sarif_document", f"""
SELECT CAST(0 AS BIGINT) AS idx, '{{"$schema": "{reports.SARIF_SCHEMA}", "version": "2.1.0", "runs": [{{"tool": {{"driver": '
  || '{{"name": "{reports.TOOL_NAME}", "rules": [' || string_agg(CAST(to_json({{'id': rule_id, 'name': name,
    'shortDescription': {{'text': name}}, 'fullDescription': {{'text': 'Detected potential secret: ' || name}},
    'properties': {{'category': category, 'ai_detection': false}}}}) AS VARCHAR), ', ' ORDER BY first) || ']}}}}, "results": [' AS value
FROM (SELECT upper(replace(secret_type, ' ', '_')) AS rule_id, min(idx) AS first, max_by(secret_type, idx) AS name,
        max_by(category, idx) AS category FROM ranked GROUP BY ALL)
UNION ALL SELECT idx, CASE WHEN idx > 1 THEN ',' ELSE '' END || CAST(to_json({{'ruleId': rule_id, 'level': level,
  'message': {{'text': message}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': uri}},
  'region': {{'startLine': start_line}}}}}}]}}) AS VARCHAR) FROM ({_SARIF}, idx FROM ranked)
UNION ALL SELECT {_LAST}, ']}}]}}'""")
def _(spark, sf):
    return reports.sarif_document(_findings(spark, sf))


@query("snk_5_env_rows", """
SELECT session_id, idx, 'FOUND_' || replace(upper(pattern), ' ', '_') || '_' || idx || '="' || line || '"' AS value
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS idx FROM alarms)""")
def _(spark, sf):
    alarms = line_stream.session_alarms(_stream_table(spark, sf))
    return reports.env_rows(alarms).select("session_id", "idx", "value")


# Streams --------------------------------------------------------------------


@query("st_1_stateless_alarms", f"""
SELECT session_id, CAST(seq AS INTEGER) AS seq, '{fv.ALARM_SEVERITY}' AS severity, pattern, line
FROM signals WHERE kind = 'alarm'""")
def _(spark, sf):
    return line_stream.prefix_alarms(_stream_table(spark, sf))


@query("st_1_prefix_alarms", "SELECT session_id, seq, severity, pattern, line FROM alarms")
def _(spark, sf):
    events = line_stream.session_events(_as_stream(spark, _stream_table(spark, sf), "alarm-lines"))
    return _drained(spark, events, "alarms").filter("kind = 'alarm'").select(
        "session_id", "seq", F.lit(fv.ALARM_SEVERITY).alias("severity"), "pattern", "line"
    )


@query("st_1_session_alarms", "SELECT session_id, seq, severity, pattern, line FROM alarms")
def _(spark, sf):
    return line_stream.session_alarms(_stream_table(spark, sf))


@query("st_2_session_verdicts", "SELECT session_id, seq, verdict FROM stream_verdicts")
def _(spark, sf):
    events = line_stream.session_events(_as_stream(spark, _stream_table(spark, sf), "verdict-lines"))
    return _drained(spark, events, "verdicts").filter("kind = 'verdict'").select(
        "session_id", "seq", F.col("pattern").alias("verdict")
    )


@query("st_2_verdicts_of_table", "SELECT session_id, seq, verdict FROM stream_verdicts")
def _(spark, sf):
    return line_stream.session_verdicts(_stream_table(spark, sf))


@query("st_2_ordered_verdicts", "SELECT session_id, seq, verdict FROM stream_verdicts")
def _(spark, sf):
    # Lines in files without any order, and then one line of a later time, which lets the watermark pass them all.
    folder, provider = work_dir(spark, "shuffled-lines"), "spark.sql.streaming.stateStore.providerClass"
    lines = _stream_table(spark, sf).withColumn("at", F.timestamp_seconds(F.col("seq") + 10 * 86400))
    lines.repartition(12, F.xxhash64("session_id", "seq", "line")).write.parquet(folder)
    last = spark.read.schema(lines.schema).parquet(folder).agg(F.timestamp_seconds(F.max("seq") + 12 * 86400).alias("at")).select(
        F.lit(-1).cast("long").alias("session_id"), F.lit(0).alias("seq"), F.lit(fv.STREAM_START).alias("line"), "at"
    )
    last.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 5).parquet(folder)
    before = spark.conf.get(provider)
    spark.conf.set(provider, line_stream.ROCKSDB)
    try:
        events = _drained(spark, line_stream.ordered_events(stream, "at", "1 day"), "ordered")
    finally:
        spark.conf.set(provider, before)
    return events.filter("kind = 'verdict'").select("session_id", "seq", F.col("pattern").alias("verdict"))


@query("st_3_scan_stream", f"SELECT {FINDING} FROM findings")
def _(spark, sf):
    arriving = _as_stream(spark, _files(spark, sf).select("path", "content"), "files")
    return _flat(_drained(spark, file_stream.scan_stream(arriving), "findings"))


@query("st_3_tree_stream", _TREE_SQL)
def _(spark, sf):
    root = _stored_tree(spark, sf)
    return _digests(_drained(spark, tree_stream(spark, root, settled=0), "tree-files"), root)


# Extensions -----------------------------------------------------------------

EXTRA = ScanOptions(
    extra_ignore=("sber", "abc"), extra_skip_extensions=(".pem",), extra_skip_dirs=("deploy",),
    threshold_critical=14, threshold_high=9, threshold_medium=6,
)


@query("ext_1_scan_options", f"SELECT {FINDING} FROM findings", {
    "files": f"SELECT *, {o.ext_of('path')} AS ext FROM code_files "
             f"WHERE NOT {o.skipped('path', 'dirs', EXTRA.extra_skip_dirs, EXTRA.extra_skip_extensions)}",
    "scored": o._scored("matches", EXTRA.extra_ignore),
    "findings": o._findings("hits", "attached", (14, 9, 6)),
})
def _(spark, sf):
    return _flat(_findings(spark, sf, opts=EXTRA))


@query("ext_2_file_predicate", f"""
SELECT {FINDING} FROM findings WHERE contains(file, '/src/') OR ends_with(file, '.go')""")
def _(spark, sf):
    chosen = F.col("path").contains("/src/") | F.col("path").endswith(".go")
    return _flat(scan.run_scan(_code(spark, sf).select("path", "content"), where=chosen))
