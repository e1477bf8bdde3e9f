"""Ranked lexical search against scores of every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilcheck.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, best):
    """Rows (item, rank, doc, score) of every pair's score."""
    held = [(i, cut(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, t in held if t), sum(len(t) for _, t in held)
    n_with = Counter(w for _, t in held for w in set(t))
    out = []
    for item, text in items:
        rows = []
        for doc, terms in held:
            if terms:
                m = 75 + (25 * len(terms) * n_docs) // n_terms
                tf = Counter(terms)
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n_with[w] + 1))) * (1000000000 * tf[w] // (1000 * tf[w] + 12 * m)) for w in cut(text) if tf[w])
                if score > 0:
                    rows.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(rows, key=lambda r: r[:3])[:best], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, best=lexical.BEST, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = lexical.search_items(d, spark.createDataFrame(items, "item_id long, text string"), best, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def texts(seed, n, words=60, low=1, high=60):
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    shares = [1 / (i + 1) for i in range(words)]
    return [" ".join(draw.choices(names, shares, k=draw.randint(low, high))) for _ in range(n)]


@pytest.mark.parametrize("best", [1, 7, 20])
def test_all_pairs(spark, best):
    docs, items = list(enumerate(texts(1, 600))), list(enumerate(texts(2, 30, high=12)))
    assert run(spark, docs, items, best) == brute(docs, items, best)


def test_copies_and_ties(spark):
    docs = [(i, "same words here") for i in range(300)] + [(1000 + i, t) for i, t in enumerate(texts(3, 80, 10))] + [(5, "same words here")] * 3
    items = [(0, "same words"), (1, "Same same SAME"), (2, "w1 w2"), (2, "w3"), (3, "w1")]
    assert run(spark, docs, items) == brute(docs, items, 20)


def test_nulls_empty_long_and_unknown(spark):
    docs = [(None, "a b c"), (None, "a"), (1, None), (2, ""), (3, "... --- !!"), (4, "Äpfel äpfel ÄPFEL apfel"), (5, "a " * 400_000 + "rare"), (6, "x" * 2_000_000 + " b"), (7, "a\x00b\x1fc_d")]
    items = [(0, "a b"), (1, None), (2, ""), (3, "nothing of it"), (4, "Äpfel"), (None, "rare rare c d"), (5, "!?")]
    assert run(spark, docs, items) == brute(docs, items, 20)


def test_repeated_items_get_their_rows_again(spark):
    docs, items = list(enumerate(texts(4, 50))), [(7, "w1 w5"), (7, "w1 w5"), (7, "w2")]
    assert run(spark, docs, items) == brute(docs, items, 20)


def test_items_in_parts_and_clashing_names(spark):
    docs, items = list(enumerate(texts(5, 200))), list(enumerate(texts(6, 25, high=9)))
    assert run(spark, docs, items, part_bytes=100) == brute(docs, items, 20)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    other = spark.createDataFrame(items, "item_id long, text string")
    for name in ("id", "item", "score", "part", "rank", "copies", "terms"):
        table, other = table.withColumn(name, F.lit("z")), other.withColumn(name, F.lit("y"))
    assert sorted((tuple(r) for r in lexical.search_items(table, other).collect()), key=str) == brute(docs, items, 20)


def test_empty_tables(spark):
    assert run(spark, [], [(0, "a")]) == []
    assert run(spark, [(0, "a")], []) == []
    assert run(spark, [(0, None)], [(0, "a")]) == []


def test_node_pairs_bound_and_prune():
    """On one batch: bounds hold for every pair, and most pairs are never scored."""
    items = lexical.read_items([type("Row", (), {"id": i, "text": t, "copies": 1}) for i, t in enumerate(texts(8, 40, 400, 5, 12))])
    docs, number = texts(9, 2000, 400, 20, 60), items.vocabulary
    vectors = [Counter(number[w.encode()] for w in cut(t) if w.encode() in number) for t in docs]
    weights = np.array([0] + [lexical.weight(2000, sum(1 for v in vectors if t in v)) for t in range(1, len(number) + 1)])
    row = {
        "ids": np.arange(2000), "lengths": np.array([len(cut(t)) for t in docs]), "sizes": np.array([len(v) for v in vectors]),
        "terms": np.array([t for v in vectors for t in sorted(v)]), "counts": np.array([v[t] for v in vectors for t in sorted(v)]),
    }
    batch = lexical.Batch(row, 2000, int(row["lengths"].sum()), weights)
    order, root = lexical.item_tree(items, weights)
    best = lexical.Best(np.zeros(40, np.int64), 20)
    lexical.search(batch, root, best)
    lexical.search(batch, root, again := lexical.Best(best.least, 20))
    for place, item in enumerate(order):
        columns, values = batch.coordinates(lexical.ItemNode(0, 1, items.terms[item], items.counts[item] * weights[items.terms[item]]))
        ids, scores = batch.scores(np.arange(len(batch.levels[0])), columns, values)
        assert sorted(best.scores[place], reverse=True) == sorted(scores, reverse=True)[:20]
        for level, nodes in enumerate(batch.levels):
            bounds = nodes[:, columns] @ values
            width = lexical.LEAF_DOCS * lexical.FANOUT**level
            assert (bounds[np.arange(2000) // width] >= scores).all()
    assert again.pairs < 0.5 * 40 * 2000
