import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests import brute, corpus
from veilcheck.operators import context, taint
from veilcheck.operators.findings import corpus_verdict, deduplicate, evaluate_corpus, severity_summary
from veilcheck.operators.rules import rules
from veilcheck.options import ScanOptions
from veilcheck.plans.scan import detect, file_flows, run_scan, scan_content

TOKEN = "tinkoff_xK9mZ2qR7nL5pT0wY4cD8eF1gH3jB6"
OTHER = "crp_xK9mZ2qR7nL5pT0wY4cD8eF1gH3jB6vNq"


def scanned(files, texts, **options):
    found = scan_content(files(texts), **options)
    return sorted(found.collect(), key=lambda r: (r.file, r.line_number, r.rule_ord, r.match_ord))


def test_corpus_findings(files):
    rows = scanned(files, corpus.texts())
    assert [(
        r.file, r.line_number, r.secret_type, r.score, r.severity, r.entropy, r.context_match, r.structural_valid,
        len(r.taint_traces), r.confidence,
    ) for r in rows] == corpus.FINDINGS
    assert {r.matched_value for r in rows if r.secret_type == "Connection String"} == {"redis"}


def test_corpus_with_full_rules(spark, files):
    found = scan_content(files(corpus.texts()), rules("full"))
    assert severity_summary(found).first().asDict() == corpus.FULL_COUNTS
    labelled = spark.createDataFrame(corpus.manifest(), "project string, vulnerable boolean, language string")
    by_language = evaluate_corpus(found.withColumn("project", F.split("file", "/")[0]), labelled)
    verdict = corpus_verdict(by_language).first()
    assert by_language.count() == 10
    assert (verdict.vulnerable, verdict.vulnerable_found, verdict.clean, verdict.clean_quiet) == (11, 11, 11, 11)
    assert verdict.recall_ok and verdict.quiet_ok


def test_corpus_verdict_of_core(spark, files):
    found = scan_content(files(corpus.texts())).withColumn("project", F.split("file", "/")[0])
    labelled = spark.createDataFrame(corpus.manifest(), "project string, vulnerable boolean, language string")
    verdict = corpus_verdict(evaluate_corpus(found, labelled)).first()
    assert (verdict.vulnerable_found, verdict.clean_quiet, verdict.recall_ok, verdict.quiet_ok) == (7, 11, True, True)


def test_comment_is_context_but_not_matched(files):
    rows = scanned(files, {"a.txt": f"# api_key {OTHER}\n\n{TOKEN}\n\n\n\n{TOKEN}"})
    assert [(r.line_number, r.context_match) for r in rows] == [(3, True), (7, True)]
    rows = scanned(files, {"a.txt": f"crp_{'aB3dE5fG7h' * 4}"})
    assert [r.context_match for r in rows] == [False]


def test_line_ends_and_last_line(files):
    rows = scanned(files, {"a.txt": f"x\r\ny\x0c{OTHER} \x85{OTHER}\n"})
    assert [r.line_number for r in rows] == [3, 5]


def test_one_line_source_and_sink_has_no_trace(files):
    rows = scanned(files, {"a.py": f'K = "{TOKEN}"; print(K)'})
    assert rows and all(not r.taint_traces for r in rows)


def test_use_before_assignment_and_overwrite(files):
    text = f'print(K)\nK = "{TOKEN}"\nK = 1\nprint(K)\nsprint(K)\nprint(KK)'
    (row,) = scanned(files, {"a.py": text})
    assert [(t.sink_line, len(t.steps)) for t in row.taint_traces] == [(1, 0), (4, 0)]
    assert row.score == 8 + 3 + 2 + 2 - 0 if row.entropy > 4.5 else True


def test_steps_attach_to_findings_on_their_lines(files):
    text = f'a = "{TOKEN}"\nb = a + "{OTHER}"\nprint(b)'
    first, second = scanned(files, {"x.py": text})
    assert [(t.source_variable, t.source_line, [s.line_number for s in t.steps]) for t in first.taint_traces] == [
        ("a", 1, [2])]
    # The second line is a step of a's trace and the source of its own.
    assert sorted((t.source_variable, t.source_line) for t in second.taint_traces) == [("a", 1), ("b", 2)]
    assert first.taint_traces[0].steps[0].action == "propagated from a"


def test_two_rules_on_one_line_repeat_traces(files):
    text = f"token = '{TOKEN}'\nprint(token)"
    rows = scanned(files, {"a.py": text})
    assert {r.secret_type for r in rows} == {"Tinkoff API Token", "Generic Token"}
    assert [len(r.taint_traces) for r in rows] == [2, 2]


@pytest.mark.parametrize("path, traced", [("a.py", True), ("a.go", True), ("a.txt", False), ("a.yaml", False)])
def test_flow_only_in_code(files, path, traced):
    (row,) = scanned(files, {path: f"k = {TOKEN}\nprint(k)"})
    assert bool(row.taint_traces) is traced


def test_traces_equal_definition(spark):
    rng = random.Random(3)
    names = ["a", "b", "c", "dd"]
    lines = ["print({0})", "{0} = {1}", "{0} = f({1}, {2})", "x.{0}", "requests.get({1})", "# {0} = {1}", "{0} == {1}",
             "", "  {0} = '{1}'; print({2})", "logging.info(é{0})", "exec ({0})"]
    cases = []
    for i in range(60):
        body = [rng.choice(lines).format(*(rng.choice(names) for _ in range(3))) for _ in range(rng.randint(1, 14))]
        secrets = [(rng.choice(names), rng.randint(1, len(body))) for _ in range(rng.randint(0, 4))]
        cases.append((i, f"f{i}.py", "\n".join(body), secrets))
    df = spark.createDataFrame(
        [(i, p, t.split("\n"), s) for i, p, t, s in cases],
        "id int, path string, lines array<string>, secrets array<struct<variable:string,line_number:int>>",
    )
    got = {i: [] for i, *_ in cases}
    for row in taint.taint_traces(df).collect():
        got[row.id].append((row.source_variable, row.source_line, row.sink_type, row.sink_line,
                            tuple(s.line_number for s in row.steps)))
    for i, _, body, secrets in cases:
        assert got[i] == [(v, n, *t) for v, n in secrets for t in brute.traces(body, v, n)], (body, secrets)


def test_relational_attachment_agrees(spark, files):
    text = f'a = "{TOKEN}"\nb = a + "{OTHER}"\nprint(b)\nc = 1\nrequests.get(a)\ntoken = "{TOKEN}"; exec(token)\nprint(token)'
    texts = files({"x.py": text, "y.txt": TOKEN})
    found = scan_content(texts)
    joined = taint.attach_traces(found, file_flows(texts)).select(*found.columns)
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, found.collect()))


def test_counts_equal_traces(files):
    rng = random.Random(8)
    names = ["a", "b", "c"]
    shapes = ["{0} = '{3}'", "{0} = {1} + '{3}'", "print({0})", "{0} = '{3}'; print({0})", "{0} = f({1})", "exec({2})", "token = '{3}'"]
    texts = {
        f"f{i}.py": "\n".join(rng.choice(shapes).format(*(rng.choice(names) for _ in range(3)), rng.choice([TOKEN, OTHER])) for _ in range(12))
        for i in range(40)
    }
    rows = scan_content(files(texts)).collect()
    assert sum(r.taint_count for r in rows) > 200
    for row in rows:
        assert row.taint_count == len(row.taint_traces)
        body = texts[row.file]
        hits = sorted({(r.line_number, r.rule_ord, r.match_ord) for r in rows if r.file == row.file})
        want = []
        for number, _, _ in hits:
            name = body.splitlines()[number - 1].split(" = ")[0]
            want += [(name, number, *t) for t in brute.traces(body, name, number) if number == row.line_number or row.line_number in t[2]]
        got = [(t.source_variable, t.source_line, t.sink_type, t.sink_line, tuple(s.line_number for s in t.steps)) for t in row.taint_traces]
        assert got == want


def test_many_secrets_of_one_variable(files):
    """Every line is a secret and every next a risky call: calls are listed once, not once per secret."""
    body = f"v = '{OTHER}'\nprint(v)\n" * 4000
    found = scan_content(files({"a.py": body}))
    assert [tuple(r) for r in found.groupBy("taint_count").count().collect()] == [(4000, 4000)]
    (flow,) = file_flows(files({"a.py": body})).first().flows
    assert (len(flow.sources), len(flow.sinks), len(flow.steps)) == (4000, 4000, 0)


def test_low_scores_and_hashes(files):
    # A hash-like token keeps 4 - 3 + 1 (entropy) + 2 (context) = 4 points.
    rows = scanned(files, {"a.txt": "token = '0123456789abcdef0123456789abcdef'"})
    assert rows == []  # "1234" marks a placeholder
    rows = scanned(files, {"a.txt": "token = '9f86d081884c7d659a2feaa0c55ad015'"})
    assert [(r.score, r.severity) for r in rows] == [(4, "LOW")]


def test_rounded_entropy_in_confidence(spark):
    from veilcheck.plans.scan import rescore

    hit = spark.range(1).select(
        F.lit(6).alias("score"), F.lit(4.503).alias("entropy"), F.lit(False).alias("structural_valid"),
        F.lit(0).alias("taint_count"))
    row = rescore(hit).first()
    assert (row.entropy, row.confidence) == (4.5, 0.53)
    row = rescore(hit.withColumn("entropy", F.lit(4.51))).first()
    assert row.confidence == 0.62


def test_long_values_collapse(files):
    head = "xK9mZ2qR7nL5pT0wY4cD8eF1gH3jB6vN" * 3
    text = f"crp_{head}AAA crp_{head}BBB"
    found = scan_content(files({"a.txt": text}))
    assert found.count() == 2 and deduplicate(found).count() == 1
    assert len(found.first().matched_value) == 83


def test_extra_columns_are_kept(files):
    df = files({"a.txt": TOKEN}).withColumn("project", F.lit("p"))
    row = scan_content(df).first()
    assert (row.project, row.source) == ("p", "current")


def test_scan_is_map_only(files):
    plan = scan_content(files({"a.txt": TOKEN}), rules("full"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_run_scan_filters(spark, files):
    df = files({"src/a.py": TOKEN, "dist/a.py": TOKEN, "b.txt": TOKEN, "c.png": TOKEN, "k/d.env.py": OTHER})
    names = lambda **o: sorted(r.file for r in run_scan(df, **o).collect())
    assert names() == ["b.txt", "k/d.env.py", "src/a.py"]
    assert names(include=["*.py"]) == ["k/d.env.py", "src/a.py"]
    assert names(exclude=["src/*"]) == ["b.txt", "k/d.env.py"]
    assert names(where=F.col("path") != "b.txt") == ["k/d.env.py", "src/a.py"]
    # One file scores 11, the others 13: their own text names a service.
    assert names(min_severity="CRITICAL") == ["b.txt", "src/a.py"]
    with pytest.raises(ValueError):
        run_scan(df, min_severity="SEVERE")


def test_scanned_files_are_counted(files):
    seen = Observation("seen")
    found = run_scan(files({"a.txt": TOKEN, "b.txt": "x", "c.png": "y", "d.md": ""}), exclude=["d*"], observation=seen)
    assert found.count() == 1 and seen.get == {"files": 2}


def test_thresholds(files):
    opts = ScanOptions(threshold_critical=1)
    assert {r.severity for r in scanned(files, {"a.txt": TOKEN}, opts=opts)} == {"CRITICAL"}


def test_context_rows_agree_with_window_form(spark, files):
    from pyspark.sql.window import Window

    from veilcheck import fixed_values as fv

    text = "\n".join(["x", "my token", "", "# y", "z", "w", "v", "AUTHOR", "q"])
    rows = context.with_context(files({"a": text}))
    has = F.lower("line").rlike("|".join(fv.CONTEXT_KEYWORDS)).cast("int")
    near = Window.partitionBy("path").orderBy("line_number").rowsBetween(-2, 2)
    wrong = rows.withColumn("w", F.max(has).over(near) == 1).filter("w <> context_match")
    assert rows.count() == 9 and wrong.count() == 0


def test_many_unused_secrets_are_cheap(files):
    """The cost of a file full of secrets is its length, not length times secrets."""
    body = "\n".join(f"KEY_{i} = 'crp_{i:06d}aB3dE5fG7hI9jK1lM3nO5pQ7rS9t'" for i in range(20_000))
    found = detect(files({"a.py": body + "\nprint(KEY_7)"}))
    assert found.filter("taint_count > 0").count() == 1
    assert found.count() == sum("1234" not in f"{i:06d}" for i in range(20_000))


@pytest.mark.parametrize("path", ["long.py", "long.js", "long.txt"])
def test_long_texts_take_the_same_path(files, path):
    """A text of ten megabytes has the findings of its parts."""
    part = f"{'word ' * 20}\n" * 400 + f"{TOKEN}\nx\n# api_key\n{OTHER}\n"
    text = part * 250
    assert len(text) > 10_000_000
    per_part = [(r.line_number, r.secret_type, r.score) for r in scanned(files, {path: part * 3}) if 404 < r.line_number <= 808]
    rows = scanned(files, {path: text})
    inner = [r for r in rows if 404 < r.line_number <= 404 * 249]
    assert per_part and len(inner) == 248 * len(per_part)
    assert [(r.line_number - 404 * i, r.secret_type, r.score) for i in range(248) for r in inner[i * len(per_part):(i + 1) * len(per_part)]] == per_part * 248


def test_many_used_variables(files):
    """Each variable visits only its own uses: by calls, by assignments, and along one chain."""
    n = 3000
    secret = f"'{OTHER}'"
    bodies = {
        "calls.py": "".join(f"v{i} = {secret}\nprint(v{i})\n" for i in range(n)),
        "moves.py": "".join(f"v{i} = {secret}\nw{i} = v{i}\nprint(w{i})\n" for i in range(n)),
        "chain.py": f"v0 = {secret}\n" + "".join(f"v{i + 1} = v{i}\n" for i in range(n)) + f"print(v{n})\n",
    }
    found = scan_content(files(bodies)).groupBy("file").agg(F.count("*").alias("n"), F.sum("taint_count").alias("traces"))
    assert {(r.file, r.n, r.traces) for r in found.collect()} == {("calls.py", n, n), ("moves.py", n, n), ("chain.py", 1, 1)}
    (flow,) = file_flows(files({"c.py": bodies["chain.py"]})).first().flows
    assert [s.variable for s in flow.steps] == [f"v{i}" for i in range(1, n + 1)] and flow.sinks[0].depth == n
