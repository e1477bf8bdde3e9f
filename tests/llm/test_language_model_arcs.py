"""Every bigram has an arc, and the automaton's parts stay on Spark."""

import math

import pytest
from pyspark import SparkContext

from tests.llm.test_language_model import DOCS, Model, corpus
from veilcheck.llm import language_model
from veilcheck.llm.language_model import scores


@pytest.mark.parametrize("part_entries", [1 << 24, 40])
def test_no_entry_passes_through_the_driver(spark, monkeypatch, part_entries):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    monkeypatch.setattr(language_model, "COUNT_AT_ONCE", 5_000)

    def refuse(*_args, **_named):
        raise AssertionError("sent through the driver")

    monkeypatch.setattr(type(docs), "toArrow", refuse)
    monkeypatch.setattr(SparkContext, "broadcast", refuse)
    model, got = Model(rows), {r.doc_id: r.score for r in scores(docs, part_entries=part_entries).collect()}
    assert all(math.isclose(got[d], model.score(t), rel_tol=1e-9) for d, t in rows if d is not None)


def test_a_bigram_seen_once_has_an_arc(spark):
    rows = [(0, "one two three"), (1, "two three four"), (3, "five one two"), (6, "three two"), (9, None), (900, "one two six three")]
    model, got = Model(rows, least=1), scores(spark.createDataFrame(rows, DOCS)).collect()
    assert model.pairs[b"five", b"one"] == 1
    for r in got:
        assert math.isclose(r.score, model.score(dict(rows)[r.doc_id]), rel_tol=1e-9)
    assert all(r.score != r.base_score for r in got if not r.held_out)


def test_every_bigram_of_a_larger_table(spark):
    rows = corpus(5)
    model, got = Model(rows, least=1), {r.doc_id: r.score for r in scores(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    assert 1 in model.pairs.values()
    assert all(math.isclose(got[d], model.score(t), rel_tol=1e-9) for d, t in rows if d is not None)
