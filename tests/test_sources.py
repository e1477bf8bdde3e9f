import io
import os
import warnings
import zipfile

import pytest
from pyspark.sql import functions as F

from veilcheck.options import ScanOptions
from veilcheck.sources.archives import explode_archives, read_archives
from veilcheck.sources.code_tree import read_code_tree
from veilcheck.sources.targets import classify_targets


@pytest.fixture()
def tree(tmp_path):
    texts = {
        ".env": b"A=1", "_x.py": b"x", "sub/.env": b"B\xff=2\r\n", "sub/.hid/a.txt": b"h", "node_modules/a.js": b"n",
        "sub/dist/b.js": b"d", "a.PNG": b"p", "build": b"file named like a directory", "deep/a/b/c/d.yml": b"y",
        "k.tar.gz": b"z", "empty.txt": b"",
    }
    for path, data in texts.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    return tmp_path


def found(df, root):
    return {os.path.relpath(r.path, root): r.content for r in df.collect()}


def test_code_tree(spark, tree):
    assert found(read_code_tree(spark, str(tree)), tree) == {
        ".env": "A=1", "_x.py": "x", "sub/.env": "B=2\n", "sub/.hid/a.txt": "h", "build": "file named like a directory",
        "deep/a/b/c/d.yml": "y", "empty.txt": "",
    }


def test_code_tree_root_may_have_a_skipped_name(spark, tree):
    assert found(read_code_tree(spark, str(tree / "node_modules")), tree) == {"node_modules/a.js": "n"}


def test_code_tree_of_single_files_and_filters(spark, tree):
    roots = [str(tree / "_x.py"), str(tree / "a.PNG"), str(tree / "sub"), str(tree / "missing")]
    assert set(found(read_code_tree(spark, roots), tree)) == {"_x.py", "sub/.env", "sub/.hid/a.txt"}
    assert set(found(read_code_tree(spark, str(tree), include=["*.env", "*.y*"]), tree)) == {
        ".env", "sub/.env", "deep/a/b/c/d.yml"}
    opts = ScanOptions(extra_skip_dirs=("deep", "sub"), extra_skip_extensions=(".txt",))
    assert set(found(read_code_tree(spark, str(tree), opts), tree)) == {".env", "_x.py", "build"}
    where = F.col("path").endswith("_x.py")
    assert set(found(read_code_tree(spark, str(tree), where=where), tree)) == {"_x.py"}


def test_unreadable_files_give_no_rows(spark, tree):
    os.symlink(tree / "nowhere", tree / "broken.txt")
    assert "broken.txt" not in found(read_code_tree(spark, str(tree)), tree)


def test_names_that_are_not_utf8(spark, tree):
    with open(os.path.join(os.fsencode(tree), b"caf\xe9.txt"), "wb") as f:
        f.write(b"latin")
    os.mkdir(os.path.join(os.fsencode(tree), b"d\xff"))
    with open(os.path.join(os.fsencode(tree), b"d\xff", "ü.txt".encode()), "wb") as f:
        f.write(b"below")
    rows = found(read_code_tree(spark, str(tree)), tree)
    assert rows["caf\\xe9.txt"] == "latin" and rows["d\\xff/ü.txt"] == "below" and rows[".env"] == "A=1"


def test_other_failures_are_loud(spark, tree, monkeypatch):
    os.symlink("loop", tree / "loop")
    with pytest.raises(Exception, match="symbolic links"):
        read_code_tree(spark, str(tree / "loop")).collect()


def test_store_addresses(spark, tree):
    rows = {r.path: r.content for r in read_code_tree(spark, f"file://{tree}").collect()}
    assert rows[f"file://{tree}/.env"] == "A=1" and rows[f"file://{tree}/sub/.hid/a.txt"] == "h"
    assert len(rows) == len(read_code_tree(spark, str(tree)).collect())
    assert [r.content for r in read_code_tree(spark, f"file://{tree}/_x.py").collect()] == ["x"]
    assert read_code_tree(spark, f"file://{tree}/missing").collect() == []


def test_reading_tasks_follow_the_bytes(spark, tree):
    (tree / "big.txt").write_bytes(b"x" * 100_000)
    assert read_code_tree(spark, str(tree), task_bytes=5000).rdd.getNumPartitions() == 21
    assert read_code_tree(spark, str(tree)).rdd.getNumPartitions() <= 8


def test_folders_are_handed_on(spark, tmp_path, monkeypatch):
    from veilcheck.sources import code_tree

    folder = tmp_path
    for i in range(30):
        folder = folder / f"d{i}"
        folder.mkdir()
        (folder / "f.txt").write_text(str(i))
    listing = code_tree._lister([], [], False)
    monkeypatch.setattr(code_tree, "NAMES_PER_TASK", 4)
    import pyarrow as pa

    batch = pa.record_batch([pa.array([os.fsencode(tmp_path)], pa.binary()), pa.array([0]), pa.array([True])], ["raw", "size", "folder"])
    (rows,) = listing(iter([batch]))
    assert rows.column("folder").to_pylist().count(True) == 1 and len(rows) < 10
    got = sorted(int(r.content) for r in read_code_tree(spark, str(tmp_path)).collect())
    assert got == list(range(30))


def test_wide_tree_is_listed_once(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f.txt").write_text(str(i))
    rows = read_code_tree(spark, str(tmp_path)).collect()
    assert sorted(int(r.content) for r in rows) == list(range(300))


def test_archives(spark):
    def packed(texts):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as zf:
            for name, data in texts.items():
                zf.writestr(name, data)
        return buffer.getvalue()

    df = spark.createDataFrame([
        ("a.zip", packed({"x/": "", "x/a.py": "1", "build": "2", "vendor/b.py": "3", "c.PNG": "4", ".env": b"5\xff"})),
        ("b.zip", packed({"x/a.py": "6"})), ("c.zip", packed({})),
    ], "archive string, bytes binary")
    got = sorted(map(tuple, explode_archives(df).collect()))
    assert got == [("a.zip", ".env", "5"), ("a.zip", "x/a.py", "1"), ("b.zip", "x/a.py", "6")]


def test_archive_files(spark, tmp_path):
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as zf:
            zf.writestr("src/x.py", name)
    rows = read_archives(spark, [str(tmp_path / "a.zip"), str(tmp_path / "b.zip")]).collect()
    assert sorted((os.path.basename(r.archive), r.path, r.content) for r in rows) == [
        ("a.zip", "src/x.py", "a"), ("b.zip", "src/x.py", "b")]


def test_hidden_and_repeated_members(spark, tmp_path):
    for name in (".h.zip", "_u.zip"):
        with zipfile.ZipFile(tmp_path / name, "w") as zf:
            zf.writestr("x.py", name)
            with pytest.warns(UserWarning, match="Duplicate"):
                zf.writestr("x.py", f"{name} again")
    (tmp_path / "notes.txt").write_text("no archive")
    want = sorted([(name, "x.py", f"{name} again") for name in (".h.zip", "_u.zip")] * 2)
    for paths in ([str(tmp_path / ".h.zip"), str(tmp_path / "_u.zip")], str(tmp_path), f"file://{tmp_path}"):
        rows = read_archives(spark, paths).collect()
        assert sorted((os.path.basename(r.archive), r.path, r.content) for r in rows) == want
    with pytest.raises(Exception, match="missing.zip"):
        read_archives(spark, str(tmp_path / "missing.zip")).collect()


@pytest.mark.parametrize("url, kind, name", [
    ("git@host:x/y", "git", None), ("https://h/x.git", "git", None), ("ssh://h/x.git", "git", None),
    ("HTTPS://GitHub.com/a", "zip", None), ("https://github.com/a", "git", None), ("https://h/x.git?y=1", "git", None),
    ("ftp://h/x.git", "file", "x.git"), ("https://h/a/B.ZIP?x=1", "zip", "B.ZIP"), ("https://h/", "file", "downloaded_target"),
    ("https://h", "file", "downloaded_target"), ("https://h/a/b/", "file", "b"), ("https://h/x.zip;v=1", "zip", "x.zip"),
    ("https://h/x.zip#frag", "zip", "x.zip"),
])
def test_targets(spark, url, kind, name):
    row = classify_targets(spark.createDataFrame([(url,)], "url string")).first()
    if "GitHub" in url:
        # The host is compared as written.
        kind, name = "file", "a"
    assert (row.source_kind, row.file_name) == (kind, name)


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_one_archive_is_unpacked_by_many_tasks(spark, tmp_path, method):
    texts = {f"d{i % 7}/f{i}.py": f"x = {i}\r\n" * (i % 50) for i in range(1000)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", method) as zf:
        for name, text in texts.items():
            zf.writestr(name, text)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            zf.writestr("d1/f1.py", "later")
        zf.writestr("node_modules/x.py", "skipped")
        zf.writestr("logo.png", b"\x89")
    want = sorted([(n, t.replace("\r\n", "\n")) for n, t in texts.items() if n != "d1/f1.py"] + [("d1/f1.py", "later")] * 2)
    found = read_archives(spark, str(tmp_path / "a.zip"), task_bytes=1 << 12)
    assert sorted((r.path, r.content) for r in found.collect()) == want
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    table = spark.createDataFrame([("a.zip", bytearray((tmp_path / "a.zip").read_bytes()))], "archive string, bytes binary")
    for tasks in (None, 5):
        assert sorted((r.path, r.content) for r in explode_archives(table, tasks=tasks).collect()) == want


def test_damaged_and_encrypted_members_fail(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as zf:
        zf.writestr("a.py", "hello there")
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    for at, value in ((raw.index(b"hello"), b"j"), (raw.index(b"PK\x01\x02") + 8, b"\x01")):
        bad = bytearray(raw)
        bad[at : at + 1] = value
        with pytest.raises(Exception, match="CRC|encrypted"):
            explode_archives(spark.createDataFrame([("a.zip", bad)], "archive string, bytes binary")).collect()
