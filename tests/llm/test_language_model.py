"""Automaton scores against the model written out."""

import math
import random
import zlib
from collections import Counter

import pytest

from veilcheck.llm import language_model
from veilcheck.llm.language_model import DISCOUNT, MIN_ARC_COUNT, scores

DOCS = "doc_id long, text string"


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*lowered.encode().split(), b""]


def out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


class Model:
    def __init__(self, rows, least=MIN_ARC_COUNT):
        train = [tokens(t) for d, t in rows if not out(d)]
        self.words = Counter(w for ts in train for w in ts)
        pairs = Counter(pair for ts in train for pair in zip([b"", *ts], ts, strict=False))
        self.pairs = {p: n for p, n in pairs.items() if n >= least}
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.rest = {}
        for state in {a for a, _ in self.pairs}:
            kept = sum((n - DISCOUNT) / self.words[a] for (a, _), n in self.pairs.items() if a == state)
            low = sum(self.root(b) for a, b in self.pairs if a == state)
            self.rest[state] = (1 - kept) / (1 - low)

    def root(self, word):
        return (self.words[word] + 1) / (self.n + self.v + 1)

    def chance(self, before, word):
        if (before, word) in self.pairs:
            return (self.pairs[before, word] - DISCOUNT) / self.words[before]
        return self.rest.get(before, 1) * self.root(word)

    def score(self, text):
        ts = tokens(text)
        return sum(math.log10(self.chance(a, b)) for a, b in zip([b"", *ts], ts, strict=False))


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(300)]
    rows += [(300 + i, "The Same text\tof many Documents é É") for i in range(60)]
    return [*rows, (900, None), (901, ""), (902, "\n \n"), (None, "without an id"), (None, None), (3, rows[3][1]), (903, "unseen-" * 3 + " nothing-like-it"), (904, "w1 w2 " * 30_000)]


@pytest.mark.parametrize("part_entries", [1 << 24, 40])
def test_scores(spark, part_entries):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], DOCS + ", held_out string, score double").repartition(5)
    model, got = Model(rows), scores(docs, part_entries=part_entries).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for doc, text in rows:
        ts = tokens(text)
        base = sum(math.log10(model.root(w)) for w in ts)
        assert any(
            (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(doc), len(ts), sum(w in model.words for w in ts), model.n)
            and math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, model.score(text), rel_tol=1e-9)
            for r in by_id[doc]
        )


def test_probabilities_sum_to_one():
    model = Model(corpus(2))
    unknown = 1 / (model.n + model.v + 1)
    for before in [b"", b"w1", b"the", b"never seen"]:
        rest = model.rest.get(before, 1) * unknown
        assert math.isclose(sum(model.chance(before, w) for w in model.words) + rest, 1, rel_tol=1e-9)


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = scores(docs).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert got.s / got.n > got.b / got.n


def test_counting_in_small_steps(spark, monkeypatch):
    monkeypatch.setattr(language_model, "COUNT_AT_ONCE", 50)
    rows = corpus(3)
    model, got = Model(rows), {r.doc_id: r.score for r in scores(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(math.isclose(got[d], model.score(t), rel_tol=1e-9) for d, t in rows if d is not None)


def test_empty_and_nothing_to_learn_from(spark):
    assert scores(spark.createDataFrame([], DOCS)).collect() == []
    alone = next(i for i in range(100) if out(i))
    row = scores(spark.createDataFrame([(alone, "a b")], DOCS)).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)
