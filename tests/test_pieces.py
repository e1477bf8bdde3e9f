"""Files in pieces give the findings of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from tests import corpus
from veilcheck.plans.pieces import cut_files, scan_pieces
from veilcheck.plans.scan import scan_content
from veilcheck.sources.code_tree import read_code_tree
from veilcheck.sources.pieces import read_pieces

TOKEN = "tinkoff_xK9mZ2qR7nL5pT0wY4cD8eF1gH3jB6"
OTHER = "crp_xK9mZ2qR7nL5pT0wY4cD8eF1gH3jB6vNq"


def same(files, piece_lines, **options):
    whole, pieces = scan_content(files), scan_pieces(cut_files(files, piece_lines), **options)
    assert sorted(pieces.columns) == sorted(whole.columns)
    want, got = (sorted(map(repr, d.select(*whole.columns).collect())) for d in (whole, pieces))
    assert got == want
    return len(got)


@pytest.mark.parametrize("piece_lines", [1, 3, 1000])
def test_corpus(files, piece_lines):
    assert same(files(corpus.texts()), piece_lines) == len(corpus.FINDINGS)


def test_flows_over_pieces(files):
    rng = random.Random(11)
    names = ["a", "b", "c", "dd", "e"]
    shapes = [
        "{0} = '{3}'", "{0} = {1} + '{3}'", "print({0})", "{0} = '{3}'; print({0})", "{0} = f({1}, {2})", "exec({2})", "token = '{3}'",
        "# api_key", "", "{0} = {1}; requests.get({2})", "x.{0}",
    ]
    texts = {
        f"f{i}.{'py' if i % 5 else 'txt'}": "\n".join(
            rng.choice(shapes).format(*(rng.choice(names) for _ in range(3)), rng.choice([TOKEN, OTHER])) for _ in range(rng.randint(0, 30))
        )
        for i in range(40)
    }
    assert same(files(texts), 4) > 100


def test_a_chain_that_crosses_every_piece(files):
    lines = [f"v0 = '{TOKEN}'", *(f"v{i + 1} = v{i}" for i in range(12)), "print(v12)", "print(v3)"]
    # Backwards, each step waits for a later line, so only the first is one.
    assert same(files({"on.py": "\n".join(lines), "back.py": "\n".join([lines[0], *reversed(lines[1:])])}), 1) == 2


def test_count_without_traces(files):
    body = f"v = '{OTHER}'\nprint(v)\n" * 500
    found = scan_pieces(cut_files(files({"a.py": body}), 100))
    assert [tuple(r) for r in found.groupBy("taint_count").count().collect()] == [(500, 500)]


def test_paths_that_repeat_and_other_columns(files):
    a = files({"x.py": f"a = '{TOKEN}'\n\n\nprint(a)"}).withColumn("repo", F.lit("r1"))
    b = files({"x.py": f"b = '{TOKEN}'\n\n\na = b\nprint(a)"}).withColumn("repo", F.lit("r2"))
    assert same(a.unionByName(b), 2, keys=["repo", "path"]) == 2


def test_no_files_and_empty_files(files, spark):
    assert same(files({"a.py": "", "b.py": "\n\n\n\n"}), 2) == 0
    none = spark.createDataFrame([("a.py", None)], "path string, content string")
    assert scan_pieces(cut_files(none, 2)).collect() == [] == scan_pieces(cut_files(none.limit(0), 2)).collect()


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "\x85", " "])
@pytest.mark.parametrize("piece_bytes", [7, 64, 1 << 20])
def test_files_read_in_pieces(spark, tmp_path, end, piece_bytes):
    rng = random.Random(piece_bytes)
    shapes = ["a = '{0}'", "b = a", "print(b)", "# api_key é", "", "x" * 200, "c = b + '{0}'; print(c)", "exec(a)"]
    for i in range(3):
        text = end.join(rng.choice(shapes).format(TOKEN) for _ in range(20 * i)) + (end if i == 1 else "")
        (tmp_path / f"f{i}.py").write_bytes(text.encode() + b"\xff" * i)
    whole, pieces = scan_content(read_code_tree(spark, str(tmp_path))), read_pieces(spark, str(tmp_path), piece_bytes=piece_bytes)
    lines = pieces.select("path", F.posexplode("lines").alias("i", "line"), "first_line").select("path", (F.col("first_line") + F.col("i")).alias("n"), "line")
    want = [(str(tmp_path / f"f{i}.py"), n, line) for i in range(3) for n, line in enumerate((tmp_path / f"f{i}.py").read_bytes().decode(errors="ignore").splitlines(), 1)]
    assert sorted(map(tuple, lines.collect())) == sorted(want)
    if end in ("\n", "\r\n") and piece_bytes == 64:
        got = scan_pieces(pieces)
        assert sorted(map(repr, got.select(*whole.columns).collect())) == sorted(map(repr, whole.collect())) != []
