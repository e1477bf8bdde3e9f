"""The Merkle manifest against a tree built in one piece, and its cases."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from veilcheck.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[1], row[2], row[3], text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """All levels, and for each node its siblings on every level, from the bottom to the top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = level[i - i % 8 : i - i % 8 + 8]
            path.append((run[: i % 8], run[i % 8 + 1 :]))
            i //= 8
        paths.append(path)
    return levels, paths


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {}
    for lang in langs:
        mine = [(r, leaf(r, r[4])) for r in rows if r[2] == lang]
        mine.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        groups[lang] = (mine, *tree([x[1] for x in mine]))
    tops, top_paths = tree([groups[lang][1][-1][0] for lang in langs])
    out = []
    for lang, above in zip(langs, top_paths):
        mine, levels, paths = groups[lang]
        for (row, digest), path in zip(mine, paths):
            whole = path + above
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = leaf(row, row[4] and row[4].translate(low)) if tampered else digest
            for left, right in whole:
                node = h(*left, node, *right)
            proof = h(*(s for left, right in whole for s in left + right))
            out.append((row[0], digest, levels[-1][0], tops[-1][0], proof, node, node == tops[-1][0]))
    return sorted(out, key=str)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted((tuple(r) for r in merkle.manifest(docs, **more).select(NAMES).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 530])
def test_sizes(spark, n):
    rows = [(i * 7, f"s{i % 3}", ["en", "de", None, "é"][i % 4 if i % 3 else 0], i, f"Text {i}") for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_more_leaves_than_a_block(spark):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(2 * merkle.BLOCK + 3)] + [(i, "s", "de", 1, f"T{i}") for i in range(-3, 0)]
    assert run(spark, rows) == brute(rows)


def test_more_groups_than_a_block(spark):
    rows = [(i, "s", f"l{i}", 1, f"T{i}") for i in range(merkle.BLOCK + 2)]
    assert run(spark, rows) == brute(rows)


def test_nulls_ties_repeats_long_texts(spark):
    rows = [(None, None, None, None, None)] * 3 + [(3, "a", "en", 1, "A"), (3, "a", "en", 1, "B")] * 5 + [(9, "", "", 0, ""), (5, "ß", "en", 2, "Ünï ABC" * 100_000), (6, None, "en", None, "no capitals")]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_clashing_names(spark):
    assert run(spark, []) == []
    rows = [(i, "s", "en", i, f"X{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("grp", "id", "node", "pos", "n", "leaf", "part", "row", "block", "root", "path", "tie"):
        docs = docs.withColumn(name, F.lit("z"))
    assert sorted((tuple(r) for r in merkle.manifest(docs).select(NAMES).collect()), key=str) == brute(rows)


def test_versions_share_all_but_their_ancestors(spark):
    rows = [(i, "s", "en" if i % 3 else "de", 1, f"T{i}") for i in range(300)]
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), tamper=lambda i: i % 50 == 0, with_copies=True).collect()
    for r in found:
        if r.doc_id % 50:
            assert (r.copies, r.n_copied, r.verified) == ([], 0, True)
        else:
            # de: 100 leaves and en: 200 make three levels each, the groups one more.
            assert (len(r.copies), r.n_copied, r.verified) == (5, 5, False)
            assert r.copies[0] == leaf(rows[r.doc_id], f"t{r.doc_id}") and r.copies[-1] == r.folded_root
    assert len({r.copies[-1] for r in found if r.copies}) == 6
