import json
import random

import pytest
from pyspark.sql import functions as F

from veilcheck.operators import advice, findings, history, ranking, review
from veilcheck.plans.scan import run_scan, scan_content
from veilcheck.schemas import FINDING, TRACES
from veilcheck.sinks import reports

SCHEMA = (
    "file string, line_number int, line_content string, secret_type string, matched_value string, score int, "
    "severity string, category string, source string, entropy double, context_match boolean, "
    f"structural_valid boolean, confidence double, taint_count int, taint_traces {TRACES}, rule_ord int, match_ord int"
)
TRACE = ("k", "a.py", 1, "Logging", "a.py", 3, "  logging.info(h)", [("a.py", 2, "h = k", "h", "propagated from k")])


def finding(file="a.py", line=1, kind="Generic Token", value="v", score=9, severity="HIGH", category="api_token",
            source="current", traces=(), rule_ord=17, match_ord=1):
    return (file, line, f"  k = '{value}'", kind, value, score, severity, category, source, 3.5, True, False, 0.71,
            len(traces), list(traces), rule_ord, match_ord)


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def test_schema_matches_columns():
    assert [c.split()[0] for c in SCHEMA.replace(TRACES, "x").split(", ")] == FINDING


def test_summary_is_zero_filled(table):
    rows = table([finding(), finding(severity="LOW")])
    assert findings.severity_summary(rows).first().asDict() == {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 0, "LOW": 1}
    assert findings.severity_summary(table([])).first().asDict() == dict.fromkeys(["CRITICAL", "HIGH", "MEDIUM", "LOW"], 0)


def test_dedup_keeps_the_first(table):
    rows = table([finding(rule_ord=5, score=3), finding(rule_ord=2, score=4), finding(source="history"),
                  finding(rule_ord=2, match_ord=2, score=8)])
    kept = findings.deduplicate(rows)
    assert sorted((r.source, r.score) for r in kept.collect()) == [("current", 4), ("history", 9)]
    assert findings.deduplicate(kept).count() == 2


def test_gate(spark, table):
    high = table([finding()])
    assert findings.ci_gate(high, "HIGH").first().asDict() == {"failed": True, "exit_code": 1}
    # Judged after the severity filter: only CRITICAL findings are left.
    assert findings.ci_gate(findings.min_severity(high, "CRITICAL"), "HIGH").first().failed is False
    groups = spark.createDataFrame([("a.py",), ("b.py",)], "file string")
    by_file = findings.ci_gate(high, "HIGH", ["file"], groups)
    assert sorted((r.file, r.failed) for r in by_file.collect()) == [("a.py", True), ("b.py", False)]


def test_unknown_severity_ranks_low(table):
    rows = table([finding(severity="ODD")])
    assert findings.min_severity(rows, "LOW").count() == 1 and findings.min_severity(rows, "MEDIUM").count() == 0


def test_order_and_rank(spark, table):
    rows = [finding(file=f, line=n, score=s, rule_ord=o) for f in "ab" for n in (1, 2) for s in (3, 9) for o in (4, 1)]
    random.Random(1).shuffle(rows)
    ranked = findings.rank_findings(table(rows).repartition(5)).collect()
    got = [(-r.score, r.file, r.line_number, r.rule_ord) for r in sorted(ranked, key=lambda r: r.idx)]
    assert got == sorted(got) and sorted(r.idx for r in ranked) == list(range(1, 17))


def test_numbering_one_hot_group(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("g"), "id")
    numbered = ranking.number_rows_by(df, ["g"], ["id"])
    hot = numbered.filter("g = 0").orderBy("id").collect()
    assert [r.idx for r in hot] == list(range(3000))
    assert numbered.filter("g <> 0").agg(F.max("idx")).first()[0] == 0


def test_advice(table):
    rows = advice.with_recommendations(table([finding(kind="Private Key"), finding(kind="Yandex Cloud OAuth Token")]))
    got = {r.secret_type: r for r in rows.collect()}
    assert got["Private Key"].priority == "high"
    default = [a for a in advice.ADVICE if a[0] == "default"][0]
    assert got["Yandex Cloud OAuth Token"].title == default[2]
    assert len(advice.ADVICE) == 19


def test_by_type_order(table):
    rows = [finding(kind=k) for k in ("JWT Token", "Zeta", "Private Key", "Alpha", "AWS Secret Key", "Alpha")]
    got = [(r.secret_type, r.found, r.priority) for r in advice.findings_by_type(table(rows)).collect()]
    assert got == [("AWS Secret Key", 1, "high"), ("Private Key", 1, "high"), ("Alpha", 2, "medium"),
                   ("JWT Token", 1, "medium"), ("Zeta", 1, "medium")]


def test_exposure_and_totals(table):
    rows = table([finding(traces=[TRACE]), finding(source="ai:other"), finding(kind="AI Security"),
                  finding(category="ai_security")])
    assert findings.exposure_counts(rows).first().asDict() == {"tainted": 1, "review_findings": 3}
    assert findings.scan_summary(rows).first().asDict() == {
        "total": 4, "CRITICAL": 0, "HIGH": 4, "MEDIUM": 0, "LOW": 0, "review_findings": 3}


def test_sarif_rules_take_first_place_and_last_text(table):
    rows = table([finding(kind="a b", score=9, category="first"), finding(kind="A B", score=3, category="last"),
                  finding(kind="c", score=5)])
    got = findings.sarif_rules(rows).orderBy("first_place").collect()
    assert [(r.rule_id, r.name, r.category) for r in got] == [("A_B", "A B", "last"), ("C", "c", "api_token")]


def _document(path):
    return "\n".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*")))


def test_json_document(table, tmp_path):
    rows = [finding(file=f"f{i % 7}", line=i, score=i % 5, traces=[TRACE] if i == 3 else []) for i in range(50)]
    reports.write_findings(table(rows + rows), str(tmp_path / "r"))
    report = json.loads(_document(tmp_path / "r"))
    assert report["total"] == 50 == len(report["findings"])
    order = [(-f["score"], f["file"], f["line"]) for f in report["findings"]]
    assert order == sorted(order)
    assert list(report["findings"][0]) == [
        "file", "line", "type", "category", "source", "ai_detection", "severity", "score", "confidence", "entropy",
        "value", "context_match", "structural_valid", "line_content", "taint_traces"]
    (traced,) = [f for f in report["findings"] if f["taint_traces"]]
    assert traced["taint_traces"][0]["depth"] == 1
    assert traced["taint_traces"][0]["sink_content"] == "logging.info(h)"
    assert traced["taint_traces"][0]["steps"] == [
        {"file": "a.py", "line": 2, "variable": "h", "action": "propagated from k", "content": "h = k"}]


def test_empty_json_document(table, tmp_path):
    reports.write_findings(table([]), str(tmp_path / "r"))
    assert json.loads(_document(tmp_path / "r")) == {"total": 0, "findings": []}


def test_sarif_document(table, tmp_path):
    rows = [finding(kind="B", severity="LOW", score=2), finding(kind="A", source="ai:x", score=9)]
    reports.write_sarif(table(rows), str(tmp_path / "s"))
    run = json.loads(_document(tmp_path / "s"))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["A", "B"]
    assert run["tool"]["driver"]["rules"][0]["properties"] == {"category": "api_token", "ai_detection": True}
    first, second = run["results"]
    assert first["message"]["text"] == "A (HIGH) at a.py:1; confidence=0.71 [LLM]"
    assert (first["level"], second["level"]) == ("error", "warning")
    assert second["locations"][0]["physicalLocation"] == {
        "artifactLocation": {"uri": "a.py"}, "region": {"startLine": 1}}


def test_text_rows(table):
    (row,) = reports.text_rows(table([finding(value="x" * 61, traces=[TRACE])])).collect()
    assert row.value.split("\n") == [
        "[HIGH] Generic Token (api_token)",
        "  📁 File   : a.py:1",
        "  🔑 Value  : " + "x" * 60 + "...",
        "  📊 Score  : 9 | Entropy: 3.5 | Confidence: 0.71",
        "  🧭 Source : current",
        "  🏷  Flags  : context✓, taint:1✓",
        "  📝 Line   : k = '" + "x" * 61 + "'",
        "  " + "─" * 50,
        "  🔗 Taint trace: k → Logging",
        "     📍 Source : a.py:1",
        "     ↓  a.py:2  [propagated from k]",
        "        h = k",
        "     💥 Sink   : a.py:3  [Logging]",
        "        logging.info(h)",
        "-" * 70,
    ]


def test_api_and_compact_rows(table):
    rows = table([finding(value="x" * 90, source="ai:z")])
    api = reports.api_rows(rows, recommendations=True).first().asDict(recursive=True)
    assert len(api) == 12 and len(api["value"]) == 80 and api["detector"] == "llm"
    assert api["recommendation"]["priority"] == "medium"
    assert len(reports.compact_json(rows).columns) == 10


def test_history(spark):
    rows = [
        (0, "c" * 40, 0, "a.py", "h1", "one"), (0, "c" * 40, 1, "dist", "h2", "two"),
        (0, "c" * 40, 2, "x/build/b.py", "h2", "two"), (0, "c" * 40, 3, "l.png", "h3", "x"),
        (1, "d" * 40, 0, "b.py", "h1", "one"), (1, "d" * 40, 1, "c.py", "h2", "two"),
        (1, "d" * 40, 2, "e.py", "h4", ""), (2, "e" * 40, 0, "f.py", "h4", ""), (2, "e" * 40, 1, "g.py", "h5", "five"),
    ]
    blobs = spark.createDataFrame(
        rows, "commit_ord int, commit_id string, path_ord int, path string, blob_hash string, content string")
    got = sorted((r.path, r.content, r.source) for r in history.history_files(blobs).collect())
    assert got == [("history/cccccccccccc/a.py", "one", "history"), ("history/dddddddddddd/c.py", "two", "history"),
                   ("history/eeeeeeeeeeee/g.py", "five", "history")]
    assert history.history_files(blobs, 1).count() == 1
    # One hash in a third of the rows still gives one winner.
    many = blobs.unionByName(spark.range(3000).select(
        F.lit(0).alias("commit_ord"), F.lit("c" * 40).alias("commit_id"), (F.col("id") + 10).cast("int").alias("path_ord"),
        F.concat(F.lit("z"), "id").alias("path"), F.lit("hot").alias("blob_hash"), F.lit("hot").alias("content")))
    assert history.history_files(many).filter("content = 'hot'").collect()[0].path == "history/cccccccccccc/z0"
    by_repo = blobs.withColumn("repo", F.lit("r")).unionByName(blobs.withColumn("repo", F.lit("s")))
    assert history.history_files(by_repo, 2, repo=["repo"]).count() == 4


def test_history_findings_meet_globs_by_virtual_path(spark, files):
    token = "crp_xK9mZ2qR7nL5pT0wY4cD8eF1gH3jB6vNq"
    blobs = spark.createDataFrame([(0, "f" * 40, 0, "src/a.py", "h", token)],
                                  "commit_ord int, commit_id string, path_ord int, path string, blob_hash string, content string")
    found = run_scan(files({"src/a.py": token}), blobs, exclude=["src/*"])
    assert [r.file for r in found.collect()] == ["history/ffffffffffff/src/a.py"]


@pytest.mark.parametrize("response, expected", [
    ("[БЕЗОПАСНО]", []), ("safe", []), ("[HIGH] - L1: x\nall [Safe] here", []), ("", []),
    ("[КРИТИЧЕСКАЯ] - L3: os.system('rm -rf /')\n[НИЗКАЯ] - L1: print('debug')",
     [("CRITICAL", 3, "os.system('rm -rf /')"), ("LOW", 1, "print('debug')")]),
    ("some explanation\n[ВЫСОКАЯ] - L2: eval(x)\n\n - not matching", [("HIGH", 2, "eval(x)")]),
    ("ВЫСОКАЯ - a - b", [("HIGH", None, "a - b")]),
    ("[ medium ] -  L 4 : x", [("MEDIUM", None, "L 4 : x")]),
    ("low - L07 :  y  ", [("LOW", 7, "y")]),
    ("[WHATEVER] - L1: x\nSAFE - L2: y\nhigh-L1: z", []),
])
def test_review_responses(spark, response, expected):
    df = spark.createDataFrame([("a.py", response)], "path string, response string")
    got = [(r.severity, r.line, r.code) for r in review.parse_reviews(df).orderBy("verdict_ord").collect()]
    assert got == expected


def test_review_findings(spark, files):
    verdicts = spark.createDataFrame([
        ("a.py", 1, "HIGH", 2, "quoted"), ("a.py", 2, "LOW", None, "three"), ("a.py", 3, "MEDIUM", None, "absent"),
        ("a.py", 4, "CRITICAL", 99, "y" * 300), ("a.py", 5, "LOW", 1, ""),
    ], "path string, verdict_ord int, severity string, line int, code string")
    rows = review.review_findings(verdicts, files({"a.py": "one\ntwo  \nthree\nthree"})).orderBy("match_ord").collect()
    assert [(r.line_number, r.line_content, r.matched_value[:6], r.score, r.confidence) for r in rows] == [
        (2, "two", "quoted", 9, 0.7), (3, "three", "three", 3, 0.55), (1, "one", "absent", 6, 0.55),
        (99, "y" * 200, "yyyyyy", 13, 0.7), (1, "one", "one", 3, 0.55)]
    assert len(rows[3].matched_value) == 80


def test_review_batch(files):
    texts = {"a.py": "eval(x)\n1", "b.py": "safe", "c.txt": "eval(x)", ".d.py": "eval(x)", "e.py": " \n", "f.sql": "eval(" + "x" * 60000,
             "g.js": "Select a\n+ b", "h.sql": "SELECT a + b"}
    rows = {r.path: r.prompt_text for r in review.review_batch(files(texts)).collect()}
    assert rows == {"a.py": "L1: eval(x)\nL2: 1", "h.sql": "L1: SELECT a + b"}
    assert {r.path for r in review.review_batch(files(texts), scan_all=True, max_files=2).collect()} == {"a.py", "b.py"}
    assert review.review_batch(files(texts), scan_all=True, max_files=0).count() == 4
    per_scan = files(texts).withColumn("scan", F.lit("s"))
    assert review.review_batch(per_scan, scan_all=True, max_files=1, scan=["scan"]).count() == 1


def test_scan_of_reviewed_files_appends(files):
    found = findings.union_findings(scan_content(files({"a.txt": "x"})), scan_content(files({"b.txt": "y"})))
    assert found.columns == FINDING and found.count() == 0


@pytest.mark.parametrize("group", [1, 7, 4096])
def test_verdicts_of_one_path_in_groups(spark, files, group):
    """One path with most verdicts, repeated codes, codes that are not there, and line ends of all kinds."""
    ends = ["\n", "\r\n", "\r", "\x0b", " "]
    lines = [f"x{i % 40} = call({i % 7})  " for i in range(120)]
    text = "".join(line + ends[i % 5] for i, line in enumerate(lines))
    codes = [f"call({i % 9})" if i % 3 else f"x{i} =" for i in range(200)] + [""]
    rows = [("hot.py", i, "HIGH", None if i % 4 else i, code) for i, code in enumerate(codes)] + [("b.py", 0, "LOW", None, "two"), ("gone.py", 0, "LOW", 9, "z")]
    verdicts = spark.createDataFrame(rows + rows[:3], "path string, verdict_ord int, severity string, line int, code string")
    got = review.locate_verdicts(verdicts, files({"hot.py": text, "b.py": "one\ntwo", "c.py": "x"}), group)
    texts = {"hot.py": lines, "b.py": ["one", "two"]}

    def expected(path, order, severity, line, code):
        there = texts.get(path, [])
        first = next((n for n, x in enumerate(there, 1) if code and code in x), 1)
        number = first if line is None else line
        return path, order, severity, code, number, there[number - 1].rstrip() if 1 <= number <= len(there) else code

    want = sorted(expected(*r) for r in rows + rows[:3])
    assert sorted(map(tuple, got.select("path", "verdict_ord", "severity", "code", "line_number", "line_content").collect())) == want


def test_documents_as_one_file(table, tmp_path):
    rows = [finding(file=f"f{i}.py", line=i, kind=f"K{i % 5}", value=f"é{i}") for i in range(500)]
    for _ in range(2):  # the second time it takes the first one's place
        reports.write_sarif(table(rows).repartition(9), str(tmp_path / "s.sarif"), one_file=True)
        reports.write_findings(table(rows).repartition(9), str(tmp_path / "r.json"), one_file=True)
    reports.write_text(table(rows[:1]), str(tmp_path / "t.txt"), one_file=True)
    whole = json.loads((tmp_path / "r.json").read_text())
    assert whole["total"] == len(whole["findings"]) == 500
    assert len(json.loads((tmp_path / "s.sarif").read_text())["runs"][0]["results"]) == 500
    assert "Found 1 potential" in (tmp_path / "t.txt").read_text()
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["r.json", "s.sarif", "t.txt"]


def test_one_file_is_written_and_read_by_many_tasks(spark, table, tmp_path, monkeypatch):
    # All lines once passed through one task, on their way out and back.
    placed = []
    join = reports._join_parts
    monkeypatch.setattr(reports, "_join_parts", lambda s, parts, to: (placed.extend(parts), join(s, parts, to)))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    rows = [finding(file=f"f\n{i}é.py", line=i, kind=f"K{i % 5}", value=f"é{i}") for i in range(800)] + [finding(file=None, kind=None)]
    path = tmp_path / "s.sarif"
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        reports.write_sarif(table(rows).repartition(9), str(path), one_file=True)
        got = reports.read_sarif(spark, str(path))
        assert got.rdd.getNumPartitions() > 4
        got = sorted(map(str, got.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    size = path.stat().st_size
    assert sum(n for _, n in placed) == size and len(placed) > 4 and max(n for _, n in placed) < size / 3
    lines = json.loads(path.read_text())["runs"][0]["results"]
    assert len(lines) == 801
    assert got == sorted(map(str, reports.sarif_results(findings.deduplicate(table(rows))).collect()))
    # The lines as other stores have them, written by one task.
    ordered = reports.sarif_document(table(rows)).orderBy("idx").collect()
    assert path.read_text() == "".join(r.value + "\n" for r in ordered)


def test_other_stores_get_one_file_too(spark, table, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.reports.link./out", tmp_path.as_uri())
    rows = [finding(file=f"f{i}.py", line=i) for i in range(60)]
    for _ in range(2):
        reports.write_sarif(table(rows).repartition(5), "viewfs://reports/out/s.sarif", one_file=True)
    reports.write_sarif(table(rows), str(tmp_path / "t.sarif"), one_file=True)
    assert (tmp_path / "s.sarif").read_text() == (tmp_path / "t.sarif").read_text()
    assert reports.read_sarif(spark, "viewfs://reports/out/s.sarif").count() == 60
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["s.sarif", "t.sarif"]


def test_no_findings_and_half_a_report(spark, table, tmp_path):
    path = tmp_path / "s.sarif"
    reports.write_sarif(table([finding()]).limit(0), str(path), one_file=True)
    assert json.loads(path.read_text())["runs"][0]["results"] == []
    assert reports.read_sarif(spark, str(path)).collect() == []
    path.write_text(path.read_text().rsplit("\n", 2)[0] + "\n")
    with pytest.raises(ValueError, match="whole report"):
        reports.read_sarif(spark, str(path))


def test_report_order_scans_once(spark, table):
    """A sort samples its input, so what it sorts must not be the scan itself."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = table([finding(score=i) for i in range(40)]).repartition(4)
    ordered = findings.in_report_order(rows.mapInPandas(counted, rows.schema))
    assert [r.score for r in ordered.collect()] == list(range(39, -1, -1)) and seen.value == 40


def test_commits_are_listed_to_the_tasks(spark):
    """A few commits hold all blobs, so texts are not exchanged by commit, whatever the size that Spark would broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blobs = spark.range(90).selectExpr("id % 3 as commit_ord", "id % 2 as repo", "repeat('x', 100) as content")
        for repo in (None, ["repo"]):
            kept = history.newest_commits(blobs, 2, repo)
            assert kept.count() == 60
            assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
