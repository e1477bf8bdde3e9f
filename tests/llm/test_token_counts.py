"""Automaton counts against cutting words up piece by piece."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilcheck.llm import token_counts
from veilcheck.llm.token_counts import Automaton, Counts, count_tokens, read_vocabulary

DOCS = "doc_id long, text string"


def slow_count(vocabulary, word):
    total = 0
    while word:
        piece = next((word[:n] for n in range(len(word), 0, -1) if word[:n] in vocabulary), None)
        if piece is None:
            return 1
        total, word = total + 1, word[len(piece) :]
    return total


TOKENS = st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=14)


@settings(max_examples=400, deadline=None)
@given(TOKENS, st.lists(st.text("abcd", max_size=14).map(str.encode), max_size=12))
def test_automaton(vocabulary, words):
    automaton = Automaton(sorted(vocabulary))
    for word in words:
        assert automaton.count(word) == slow_count(vocabulary, word)


@pytest.fixture(scope="module")
def vocabulary(spark):
    return read_vocabulary(spark)


def test_public_vocabulary(vocabulary):
    assert len(vocabulary) == 50_256
    known, held = set(vocabulary), Counts(Automaton(vocabulary))
    rng = random.Random(1)
    words = ["the", "internationalisation", "Unbelievable!!!", "éèê", "日本語", "🙂🙂", "a" * 3000, "x_y-z.0123456789"]
    words += ["".join(rng.choices("etaoinshrdluéß0.,", k=rng.randint(1, 25))) for _ in range(1500)]
    for word in words:
        assert held[word.encode()] == slow_count(known, b" " + word.encode())


def test_documents(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN_WORDS", 10)
    rows = [(i, " ".join(random.Random(i).choices(["alpha", "beta", "naïve", "x1", "Zug"], k=i))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\t\n \r"), (None, "null id"), (3, rows[3][1]), (53, "long " * 20_000), (54, "w" * 1500), (55, "a\x1cb c\u00a0d")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", n_words int, n_bytes string")
    known = set(vocabulary)
    want = []
    for doc, text in rows:
        words = (text or "").encode().split()
        want.append((doc, len((text or "").encode()), len(words), sum(slow_count(known, b" " + w) for w in words)))
    assert sorted(map(str, (tuple(r) for r in count_tokens(docs).collect()))) == sorted(map(str, want))


def test_empty_and_large_vocabulary(spark, monkeypatch):
    assert count_tokens(spark.createDataFrame([], DOCS)).collect() == []
    monkeypatch.setattr(token_counts, "MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError, match="at most 10"):
        read_vocabulary(spark)


def test_long_words_are_not_remembered():
    from veilcheck.llm import token_counts
    from veilcheck.llm.token_counts import Automaton, Counts

    counts = Counts(Automaton([b" ", b"a", b"aa", b"b", b" a"]))
    words = [b"a" * n for n in range(1, 200)] + [b"b" * 5000]
    assert [counts[w] for w in words] == [counts.automaton.count(b" " + w) for w in words]
    assert max(map(len, counts)) == token_counts.KNOWN_BYTES
