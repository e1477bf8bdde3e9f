"""Decontamination against comparing every window of every item's size."""

import random
from collections import Counter

import pytest

from veilcheck.llm.decontaminate import contaminated, keep_clean

BENCH, DOCS = "item_id long, text string", "doc_id long, text string"


def shingles(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def slow_pairs(docs, items, similarity=0.8):
    found = set()
    for doc, text in docs:
        words = (text or "").lower().split()
        for item, passage in items:
            want = (passage or "").lower().split()
            if not want:
                continue
            k, size = min(5, len(want)), len(want)
            own = shingles(want, k)
            for first in range(max(1, len(words) - size + 1)):
                window = shingles(words[first : first + size], k)
                both = sum((window & own).values())
                if both and both / (sum(window.values()) + sum(own.values()) - both) >= similarity:
                    found.add((doc, item))
    return found


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 8, 15, 30, 30, 45, 60])))) for i in range(40)]
    items += [(40, None), (41, ""), (42, items[0][1]), (43, "so so so so so so so so so so so so")]
    docs = []
    for i in range(160):
        words = rng.choices(vocabulary, k=rng.randint(0, 120))
        if i % 2:
            passage = rng.choice(items[:40])[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.choice([0, len(passage) - 1, rng.randrange(len(passage))])
                passage = rng.choice([passage[:at] + [rng.choice(vocabulary)] + passage[at + 1 :], passage[:at] + passage[at + 1 :] or passage, passage[:at] + ["new"] + passage[at:]])
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if rng.random() < 0.1 else w for w in passage]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    docs += [(200, None), (201, ""), (202, items[4][1]), (202, items[4][1]), (203, "so " * 400), (204, " ".join(rng.choices(vocabulary, k=20_000)) + " " + items[5][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_and_only_similar_windows(spark, seed):
    docs, items = fixture(seed)
    found = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, BENCH)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == slow_pairs(docs, items)
    assert all(r.similarity >= 0.8 for r in found)


def test_parts_of_a_large_benchmark(spark):
    docs, items = fixture(4)
    found = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, BENCH), part_words=200).collect()
    assert {(r.doc_id, r.item_id) for r in found} == slow_pairs(docs, items)


def test_repeats_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 5), (1, "a b c d e f g", 5), (None, "x a b c d e f g x", 6), (2, None, 7)], DOCS + ", item_id long")
    items = spark.createDataFrame([(None, "A B C D E F G"), (9, "nothing of this sort is there")], BENCH)
    found = contaminated(docs, items)
    assert sorted(map(str, ((r.doc_id, r.item_id, r.first_word, r.words) for r in found.collect()))) == sorted(map(str, [(1, None, 0, 7), (1, None, 0, 7), (None, None, 1, 7)]))
    kept = keep_clean(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, None, 7)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], BENCH)
    assert contaminated(docs, items).collect() == []
    assert keep_clean(docs, items).count() == 1
    assert contaminated(docs.limit(0), spark.createDataFrame([(1, "a b")], BENCH)).collect() == []


def test_parts_are_searched_one_after_the_other(spark):
    docs, items = fixture(6)
    table, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, BENCH)
    held = {d for d, _ in slow_pairs(docs, items)}
    for part_words in (200, 1 << 20):
        kept = keep_clean(table, bench, part_words=part_words).collect()
        assert sorted(r.doc_id for r in kept) == sorted(d for d, _ in docs if d not in held)


def test_windows_without_enough_shingles_are_left_out():
    """A long text with many single shingles of many items of one size makes few windows, and loses no match."""
    import numpy as np

    from veilcheck.llm.decontaminate import Benchmark
    from veilcheck.llm.words import text_hashes

    rng = random.Random(1)
    items = [(i, " ".join(rng.choices([f"v{k}" for k in range(4000)], k=30))) for i in range(3000)]
    text = " ".join(" ".join(rng.choice(items)[1].split()[k : k + 6]) for k in rng.choices(range(24), k=4000)) + " " + items[7][1]
    benchmark = Benchmark(items)
    words, starts = text_hashes([text.encode()])
    windows = benchmark.windows(words, starts, 0.8)
    assert sum(map(len, windows.values())) < 20 and len(words) > 20_000
    assert [h["item_id"] for h in benchmark.search([text.encode()], 0.8)[0]] == [7]
    assert np.concatenate(list(windows.values())).max() == len(words) - 30
