"""SimHash components against comparing all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilcheck import session
from veilcheck.llm import near_dup
from veilcheck.llm.near_dup import build_tree, contract, fingerprint, keep_one, links, local_components, near_duplicates

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, bits):
    """The least row that each row reaches, over all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def noisy(rng, n, centres=40, flips=4):
    """Fingerprints that crowd around a few centres."""
    base = [rng.getrandbits(64) for _ in range(centres)]
    found = [rng.choice(base) ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(0, flips)))) for _ in range(n)]
    return sorted(set(found) | {rng.getrandbits(64) for _ in range(n)})


def signed(values):
    return np.array(values, np.uint64).view(np.int64).tolist()


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "one two", "a b c", "A B c D", "x y z " * 50, "é ñ ß Ünder", "a\x0bb\x0cc\rd e"])
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_fingerprint_of_a_very_long_text():
    rng = random.Random(3)
    text = " ".join(str(rng.randrange(5000)) for _ in range(70_000))
    assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_tree_brings_every_close_pair_together():
    prints = np.array(noisy(random.Random(1), 3000), np.uint64)
    tree = build_tree(prints, 32, 2)
    assert tree.shards > 8
    rows, homes = tree.route(prints, 2)
    shards = {}
    for row, home in zip(rows.tolist(), homes.tolist(), strict=True):
        shards.setdefault(row, set()).add(home)
    assert len(shards) == len(prints)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 2):
            assert shards[i] & shards[int(j)]
    assert len(rows) < 3 * len(prints)


def test_local_components():
    prints = noisy(random.Random(2), 150)
    assert local_components(np.array(prints, np.uint64), 2).tolist() == roots(prints, 2)


@pytest.mark.parametrize(("bits", "dense"), [(2, False), (3, False), (2, True)])
def test_links_of_many_small_shards(spark, monkeypatch, bits, dense):
    monkeypatch.setattr(near_dup, "SHARD_ROWS", 40)
    monkeypatch.setattr(near_dup, "FULL_SHARD", 120)
    if dense:  # no split is good enough, so the values that fingerprints reach decide
        monkeypatch.setattr(near_dup, "SPLIT_SHARE", 0.0)
    prints = noisy(random.Random(bits), 400)
    found = links(spark.createDataFrame([(x,) for x in signed(prints)], "fp long"), bits)
    stars = {r.a: r.b for r in contract(found).collect()}
    want = roots(prints, bits)
    groups = {}
    for value, root in zip(signed(prints), want, strict=True):
        groups.setdefault(root, set()).add(value)
    got = {}
    for value in signed(prints):
        got.setdefault(stars.get(value, value), set()).add(value)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    assert all(root == min(group) for root, group in got.items())


def test_contract_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(101, 100)], "a long, b long")
    assert {(r.a, r.b) for r in contract(edges).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}


def texts(rng):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(150)]
    for i in range(150, 260):
        base = rng.choice(rows[:60])[1].split()
        if base and rng.random() < 0.6:
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((i, " ".join(base)))
    return [*rows, (300, None), (301, ""), (302, " \n"), (5, rows[5][1]), (303, "A b C"), (304, "a B c")]


def test_components_of_documents(spark):
    rows = texts(random.Random(5))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", fp string, component_id int")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect())
    prints = [slow_fingerprint(t) for _, t in rows]
    root = roots(prints, 2)
    least = {}
    for (doc, _), r in zip(rows, root, strict=True):
        least[r] = min(doc, least.get(r, doc))
    assert got == sorted((doc, f"{p:016x}", least[r]) for (doc, _), p, r in zip(rows, prints, root, strict=True))
    kept = [r.doc_id for r in keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(least.values()))
    assert keep_one(docs).columns == docs.columns


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (None, "q")], SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(7, 7), (None, 7), (None, 7), (None, None)], key=str)
    assert keep_one(docs).count() == 4
    assert near_duplicates(docs.limit(0)).collect() == []
    assert keep_one(docs.limit(0)).collect() == []


def test_a_third_of_all_rows_alike(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text again").otherwise(F.repeat(F.concat(F.lit(" w"), F.col("id")), 5)).alias("text"))
    found = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert all(found[i] == 0 for i in range(0, 900, 3))


def test_an_id_with_two_texts_leaves_a_row_of_each_group(spark):
    a, b, c = "one two three four five", "six seven eight nine ten", "others altogether in here now"
    rows = [(1, a), (5, a), (5, b), (7, b), (5, b), (9, c), (9, c), (None, a)]
    kept = [(r.doc_id, r.text) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (5, b), (9, c), (None, a)], key=str)


def test_dense_shards_of_odd_and_even_distances(spark):
    import numpy as np

    from veilcheck.llm.near_dup import _dense_links

    rng = np.random.default_rng(5)
    prints = [int(p) ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 5), replace=False)) for p in rng.integers(0, 1 << 62, 6) for _ in range(25)]
    table = spark.createDataFrame([(p, 0) for p in prints], "fp long, shard int")
    for max_bits in (0, 1, 2, 3):
        roots = {p: p for p in prints}

        def root(p):
            while roots[p] != p:
                p = roots[p]
            return p

        for row in _dense_links(table, max_bits).collect():
            assert row.b < row.a and bin(row.a ^ row.b).count("1") <= max_bits
            roots[root(row.a)] = root(row.b)
        for x in set(prints):
            for y in set(prints):
                assert bin(x ^ y).count("1") > max_bits or root(x) == root(y)


def test_small_tables_are_written_in_few_files(spark, monkeypatch):
    # With many shuffle partitions, each of them once wrote a file for each of some twenty tables.
    files = {}

    def counted(df, name, *rows):
        table = session.written(df, name, *rows)
        files[name] = max(files.get(name, 0), len(table.inputFiles()))
        return table

    monkeypatch.setattr(near_dup, "written", counted)
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    rows = [*texts(random.Random(6)), (3, "an id that comes twice")]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        kept = keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
        chain = contract(spark.range(60).selectExpr("id + 1 AS a", "id AS b")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"distinct", "least", "large", "linked", "components", "members", "verdicts", "right"} <= set(files)
    assert {name: n for name, n in files.items() if n > 1 and name not in ("prints", "shards", "edges")} == {}
    assert len(kept) > 100
    assert len(chain) == 60 and {r.b for r in chain} == {0}


def test_written_table_has_a_task_for_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "FILE_ROWS", 100)
    rows = spark.range(0, 1000, 1, 40)
    assert len(session.written(rows, "numbers").inputFiles()) == 40
    table = session.written(rows, "numbers", 1000)
    assert len(table.inputFiles()) == 10
    assert sorted(r.id for r in table.collect()) == list(range(1000))
    assert len(session.written(rows.limit(0), "numbers", 0).inputFiles()) == 1
