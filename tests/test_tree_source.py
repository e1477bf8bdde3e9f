"""The tree as a data source: lazily, and as a stream over restarts."""

import os
import time

import pytest

from tests import corpus
from veilcheck.plans.scan import scan_content
from veilcheck.sources.code_tree import read_code_tree
from veilcheck.sources.tree_source import tree_stream, tree_table
from veilcheck.streaming import files as file_stream

TEXTS = {".env": "A=1", "_x.py": "x", "sub/.env": "B=2\r\n", "sub/.hid/a.txt": "h", "node_modules/a.js": "n", "a.PNG": "p", "deep/a/b/c/d.yml": "y", "empty.txt": ""}
SEEN = {".env": "A=1", "_x.py": "x", "sub/.env": "B=2\n", "sub/.hid/a.txt": "h", "deep/a/b/c/d.yml": "y", "empty.txt": ""}


def put(folder, texts):
    for path, text in texts.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_bytes(text.encode())


def names(df, folder):
    return sorted((r.path[len(str(folder)) + 1 :], r.content) for r in df.select("path", "content").collect())


@pytest.mark.parametrize("task_bytes", [1, 1 << 20])
def test_table_equals_the_eager_reader(spark, tmp_path, task_bytes):
    put(tmp_path, TEXTS)
    table = tree_table(spark, str(tmp_path), task_bytes=task_bytes)
    assert names(table, tmp_path) == names(read_code_tree(spark, str(tmp_path)), tmp_path) == sorted(SEEN.items())
    assert table.rdd.getNumPartitions() == (len(SEEN) - 1 if task_bytes == 1 else 1)
    assert names(tree_table(spark, str(tmp_path), include=["*.env"]), tmp_path) == [(".env", "A=1"), ("sub/.env", "B=2\n")]
    # Listed anew for each query.
    put(tmp_path, {"later.py": "z"})
    assert len(names(tree_table(spark, [str(tmp_path), str(tmp_path / "gone")]), tmp_path)) == len(SEEN) + 1


def test_stream_finds_every_file_once_across_restarts(spark, tmp_path):
    source = tmp_path / "in"
    put(source, TEXTS)
    out = [str(tmp_path / x) for x in ("out", "state")]
    run = lambda **o: file_stream.run_available(tree_stream(spark, str(source), settled=0, **o), *out)
    read = lambda: names(spark.read.parquet(out[0]), source)
    run()
    assert read() == sorted(SEEN.items())
    run()
    assert read() == sorted(SEEN.items())
    put(source, {"new/.env": "C=3"})
    # An old file that is moved in is new here.
    put(tmp_path, {"old.py": "o"})
    os.utime(tmp_path / "old.py", (1, 1))
    os.rename(tmp_path / "old.py", source / "old.py")
    for _ in range(3):  # such a run is one trigger
        run(max_files=1)
    assert read() == sorted([*SEEN.items(), ("new/.env", "C=3"), ("old.py", "o")])
    put(source, {".env": "A=2"})
    run()
    assert read() == sorted([*SEEN.items(), ("new/.env", "C=3"), ("old.py", "o"), (".env", "A=2")])


def test_files_settle_first(spark, tmp_path):
    put(tmp_path / "in", {"a.py": "x"})
    stream = tree_stream(spark, str(tmp_path / "in"), settled=3600)
    file_stream.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).count() == 0


def test_scan_of_the_stream(spark, files, tmp_path):
    put(tmp_path / "in", corpus.texts())
    time.sleep(0.01)
    found = file_stream.scan_stream(tree_stream(spark, str(tmp_path / "in"), settled=0).drop("changed"))
    file_stream.run_available(found, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    assert got.count() == scan_content(files(corpus.texts())).count() == len(corpus.FINDINGS)
