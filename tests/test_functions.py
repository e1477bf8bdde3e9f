import fnmatch
import math
from pathlib import PurePosixPath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import brute
from veilcheck import fixed_values as fv
from veilcheck.functions import flow, labels, regex, scoring, text
from veilcheck.operators import context, paths
from veilcheck.options import ScanOptions

FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def run(spark, values, build, schema="v string"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)],
                               f"i long, {schema}")
    return [r[1] for r in sorted(df.select("i", build().alias("r")).collect())]


ODD = st.text(alphabet="ab#/ =\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u2028\u2029\xa0\u3000\t\U0001f600", max_size=12)


@given(st.lists(ODD, min_size=40, max_size=80))
@FEW
def test_lines_and_white_space(spark, values):
    values = [*values, "", "\n", "a\r\nb", "a\n\n", "x\r"]
    assert run(spark, values, lambda: text.split_lines("v")) == [v.splitlines() for v in values]
    flat = [v.replace("\n", " ") for v in values]
    assert run(spark, flat, lambda: text.strip("v")) == [v.strip() for v in flat]
    assert run(spark, flat, lambda: text.rstrip("v")) == [v.rstrip() for v in flat]
    assert run(spark, flat, lambda: text.matchable("v")) == [
        bool(v.strip()) and not v.strip().startswith(("#", "//")) for v in flat
    ]


def test_extensions(spark):
    names = ["a/.env", ".env.local", "b/a.ENV", "x.tar.gz", "noext", "dir.d/file", ".htpasswd", "a.", "k/.A"]
    want = [".env", ".local", ".env", ".gz", "", "", ".htpasswd", "", ".a"]
    assert run(spark, names, lambda: text.file_ext("v")) == want
    assert run(spark, names[:7], lambda: text.suffix("v")) == [PurePosixPath(n).suffix.lower() for n in names[:7]]


GLOBS = ["*.py", "src/*", "*test*", "?.js", "[ab].txt", "[!ab].txt", "a.b", "*/deep/*.yml", "[", "x[y", "*[]]*", "a+(b)"]


def test_globs(spark):
    names = ["a.py", "src/a.py", "src/x/test_b.go", "a.js", "ab.js", "a.txt", "c.txt", "acb", "a.b", "k/deep/q/z.yml",
             "[", "x[y", "a]b", "a+(b)", "A.PY"]
    for g in GLOBS:
        want = [fnmatch.fnmatchcase(PurePosixPath(n).name, g) or fnmatch.fnmatchcase(n, g) for n in names]
        assert run(spark, names, lambda: paths.matches_globs("v", [g], None)) == want, g
        assert run(spark, names, lambda: paths.matches_globs("v", None, [g])) == [not w for w in want], g


def test_skip_paths(spark):
    names = ["src/build", "build/a.py", "a.PNG", ".env", "x/.git/config", "x.lock", "vendored/a.go", "a/b/so"]
    assert run(spark, names, lambda: paths.is_skipped("v")) == [False, True, True, False, True, True, False, False]
    assert run(spark, names, lambda: paths.is_skipped("v", "parts")) == [
        True, True, True, False, True, True, False, False]
    more = ScanOptions(extra_skip_dirs=("vendored",), extra_skip_extensions=(".ENV",))
    assert run(spark, ["vendored/a.go", "a.env"], lambda: paths.is_skipped("v", "dirs", more)) == [True, True]
    with pytest.raises(ValueError):
        paths.is_skipped("v", "all")


@given(st.lists(st.text(alphabet="abcdefghij01234\u00e9\U0001f600-", max_size=70), min_size=30, max_size=60))
@FEW
def test_entropy(spark, values):
    values = [*values, "", "a", "abcdefgh", "aabbccdd", "0123456789abcdef"]
    got = run(spark, values, lambda: scoring.shannon_entropy("v"))
    assert all(math.isclose(g, brute.entropy(v), abs_tol=1e-12) for g, v in zip(got, values))
    # Exact where the thresholds are: powers of two.
    exact = ["abcdefghabcdefgh" + "ijkl" * 4, "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEF"]
    assert run(spark, exact, lambda: scoring.shannon_entropy("v")) == [brute.entropy(v) for v in exact]
    rounded = run(spark, values, lambda: scoring.round2(scoring.shannon_entropy("v")))
    assert rounded == [abs(round(brute.entropy(v), 2)) for v in values]


@pytest.mark.parametrize("tie", [0.125, 0.375, 0.625, 0.875, 2.5, 3.125, 3.0625, 2.675, 1.005])
def test_rounding(spark, tie):
    assert run(spark, [tie], lambda: scoring.round2(F.col("v")), "v double") == [
        round(tie, 2) if tie not in (2.675, 1.005) else pytest.approx(round(tie, 2), abs=0.011)]


def test_confidence_for_every_score(spark):
    cases = [(s, e, k, t) for s in range(0, 31) for e in (4.5, 4.51) for k in (False, True) for t in (False, True)]

    def plain(s, e, k, t):
        c = min(0.99, 0.15 + s / 16.0)
        c += 0.1 if e > 4.5 else 0
        c += 0.15 if k else 0
        c += 0.15 if t else 0
        return round(min(c, 0.99), 2)

    got = run(spark, cases, lambda: scoring.confidence("s", "e", "k", F.col("t")),
              "s int, e double, k boolean, t boolean")
    assert got == [plain(*c) for c in cases]
    assert plain(6, 4.51, False, False) == 0.62


@pytest.mark.parametrize("value, expected", [
    ("this_is_an_example_key", True), ("test_api_key_value_here", True), ("key_1234_value", True),
    ("your_api_key_here", True), ("<your-api-key>", True), ("********", True), ("todo: set token here", True),
    ("aaabbb", True), ("tinkoff_xK9mZ2qR7nL5pT0wY4cD8eF1gH3", False), ("aB3xK9mZ2qR7nL5p", False), ("abcd", False),
    ("\U0001f600\U0001f601\U0001f602", True),
])
def test_false_positives(spark, value, expected):
    assert run(spark, [value], lambda: scoring.is_false_positive("v")) == [expected]


def test_extra_placeholders(spark):
    opts = ScanOptions(extra_ignore=("acme",))
    assert run(spark, ["x-ACME-1z9", "x-acm-1z9q"], lambda: scoring.is_false_positive("v", opts)) == [True, False]


def test_hashes(spark):
    values = ["a" * 32, "A" * 40, " " + "0f" * 32 + "\x1f", "a" * 33, "g" * 32, "a" * 64 + "\n"]
    assert run(spark, values, lambda: scoring.is_likely_hash("v")) == [True, True, True, False, False, True]


@pytest.mark.parametrize("kind, value, valid", [
    ("JWT Token", "a.b.c", True), ("JWT Token", "a..c", False), ("JWT Token", "a.b", False),
    ("AWS Access Key", "AKIA" + "A" * 16, True), ("AWS Access Key", "AKIA" + "a" * 16, False),
    ("Yandex Cloud Service Account Key", "AQ" + "x" * 38, True),
    ("Private Key", "-----BEGIN RSA PRIVATE KEY-----", True), ("Private Key", "PRIVATE KEY", False),
    ("Some UUID", "12345678-1234-1234-1234-123456789ABC", True), ("Ozon Client ID", "client_id=1", False),
    ("HubSpot Key", "a" * 36, True), ("Connection String", "redis", False), ("Connection String", "a://b@c", True),
    ("Generic Token", "anything", False),
])
def test_structure(spark, kind, value, valid):
    got = run(spark, [(kind, value)], lambda: scoring.validate_structure("k", "v"), "k string, v string")
    assert got == [valid]


def test_severity(spark):
    assert run(spark, [1, 4, 5, 7, 8, 11, 12, 40], lambda: scoring.severity("v"), "v int") == [
        "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]
    strict = ScanOptions(threshold_medium=6)
    assert run(spark, [5], lambda: scoring.severity("v", strict), "v int") == ["LOW"]
    assert run(spark, ["LOW", "CRITICAL", "odd"], lambda: scoring.severity_rank("v")) == [0, 3, 0]


def test_assignments(spark):
    lines = ["x = 1", "  key=2", "x == y", "const x = 1", "$x = 1", "x: T = 1", "a.b = 1", "_9 =", "9a = 1", "x"]
    assert run(spark, lines, lambda: flow.assigned_variable("v")) == [
        "x", "key", "x", None, None, None, None, "_9", None, None]
    assert run(spark, lines, lambda: flow.assignment_target("v"))[7] is None
    assert run(spark, ["x == y"], lambda: flow.assignment_value("v")) == ["= y"]


@pytest.mark.parametrize("line, sink", [
    ("requests.post(u)", "HTTP request"), ("logging.info(print(x))", "Logging"), ("print (x)", "Console output"),
    ("sprint(x)", None), ("os.system('x')", "Shell execution"), ("eval(x)", None), ("exec(x)", "Dynamic code execution"),
    ("boto3.client()", "AWS SDK call"), ("x = 1", None),
])
def test_sinks(spark, line, sink):
    assert run(spark, [line], lambda: flow.sink_type("v")) == [sink]


def test_truncation(spark):
    assert run(spark, ["a" * 80, "a" * 81], lambda: text.truncate("v", 80)) == ["a" * 80, "a" * 80 + "..."]


def test_context_window_clips(spark):
    lines = ["api_key here", "1", "2", "3", "Author"]
    got = run(spark, [(lines,)], lambda: F.transform("v", lambda _, i: text.has_context(
        text.context_window(F.col("v"), i))), "v array<string>")
    assert got == [[True, True, True, True, True]]
    got = run(spark, [(["api_key", "", "", "", ""],)], lambda: F.transform("v", lambda _, i: text.has_context(
        text.context_window(F.col("v"), i))), "v array<string>")
    assert got == [[True, True, True, False, False]]


def test_threat_words(spark):
    words = [" критическая ", "High", "safe", "nonsense", "НИЗКАЯ"]
    assert run(spark, words, lambda: labels.threat_severity("v")) == ["CRITICAL", "HIGH", "SAFE", None, "LOW"]


def test_alarm_order(spark):
    lines = ["eyJ AKIA", "xoxp- ghp_", "-----BEGIN PRIVATE KEY", "nothing"]
    assert run(spark, lines, lambda: labels.alarm_pattern("v")) == ["AKIA", "ghp_", "PRIVATE KEY", None]


def test_numbered_text(spark):
    assert run(spark, [(["a", "", "b"],)], lambda: text.numbered_text("v"), "v array<string>") == ["L1: a\nL2: \nL3: b"]


def test_fixed_lists():
    assert (len(fv.CONTEXT_KEYWORDS), len(fv.PLACEHOLDER_PATTERNS), len(fv.SINKS)) == (23, 12, 19)
    assert (len(fv.SKIP_DIRS), len(fv.SKIP_EXTENSIONS), len(fv.REVIEW_EXTENSIONS)) == (12, 22, 15)


@pytest.mark.parametrize("pattern, found", [
    (r"\bos\.system\s*\(", ["(", "os.system"]), (r"ab?c+d", ["a", "d"]), (r"a|b", []), (r"(?i)abc", []), (r"a(?:b|c)d", ["a", "d"]),
    (r"x[]a]y[^]b]z[\]c]{2}-", ["-", "x", "y", "z"]), (r"a{2}b", ["b"]), (r"a(?i:b)c", []), (r"\d\.\w{2,}--(?<!q)k", [".", "--", "k"]), (r"a(b)?", ["a"]),
    (r"\x41b", []), (r"\Qa\E", []), (r"(a)\1", []), (r"\$\{a\}", ["${a}"]),
])
def test_literals_of_a_regex(pattern, found):
    assert regex.literals(pattern) == sorted(found)


def test_context_is_found_by_line(spark, files):
    """Searched once per line, the context equals that of the joined lines."""
    texts = ["x", "My PassWord", "", "y", "z", "KKEY vK", "clı", "ent_secret", "api_", "key", "a", "b", "c", "d"]
    rows = context.with_context(files({"a.py": "\n".join(texts)})).orderBy("line_number").collect()
    joined = [" ".join(texts[max(0, i - 2) : i + 3]).lower() for i in range(len(texts))]
    assert [r.context_match for r in rows] == [any(k in j for k in fv.CONTEXT_KEYWORDS) for j in joined]
    plan = context.with_context(files({"a.py": "x"}))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan


def test_sinks_are_searched_by_literals(spark):
    """No regex looks at a line that lacks a call's literals."""
    lines = spark.createDataFrame([("print x",), ("a print (x)",), ("my_exec(x)",), ("os.systemd (x)",), (None,)], "line string")
    named = lines.select(flow.sink_type("line").alias("s"))
    assert [r.s for r in named.collect()] == [None, "Console output", None, None, None]
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains") >= len(fv.SINKS)
