"""The automaton by itself: probabilities of a state, and reading in parts."""

import math
import random

import numpy as np
import pytest

from tests.llm.test_language_model import Model
from veilcheck.llm import language_model
from veilcheck.llm.language_model import Automaton, arc_keys
from veilcheck.llm.words import word_hashes


def build(rows):
    model = Model(rows, least=1)
    names = sorted(model.words, key=lambda w: int(word_hashes([w])[0]))
    hashes = word_hashes(names)
    number = {w: i for i, w in enumerate(names)}
    pairs = list(model.pairs)
    keys = arc_keys(hashes[[number[a] for a, _ in pairs]], hashes[[number[b] for _, b in pairs]])
    order = np.argsort(keys)
    arcs = np.array([math.log10(model.chance(*p)) for p in pairs])
    failures = np.array([math.log10(model.rest.get(w, 1.0)) for w in names])
    return model, number, Automaton(hashes, keys[order], arcs[order], failures, np.array([math.log10(model.root(w)) for w in names]))


ROWS = [(i, " ".join(random.Random(i).choices(["a", "b", "c", "d", "e", "f"], [9, 5, 3, 2, 1, 1], k=random.Random(i).randint(0, 30)))) for i in range(40)]


def test_every_state_is_a_distribution():
    model, number, automaton = build(ROWS)
    words = np.arange(len(number))
    for word, state in number.items():
        weights, after = automaton.step(np.full(len(words), state), words)
        # What is left goes to words that were never seen.
        unseen = model.rest.get(word, 1.0) / (model.n + model.v + 1)
        assert math.isclose((10**weights).sum() + unseen, 1.0, rel_tol=1e-9)
        assert (after == words).all()


@pytest.mark.parametrize("segment", [1, 2, 7, 512])
def test_parts_of_a_text_are_read_alike(monkeypatch, segment):
    monkeypatch.setattr(language_model, "SEGMENT", segment)
    model, number, automaton = build(ROWS)
    texts = [t for _, t in ROWS] + ["a b " * 900]
    tokens = [[number[w] for w in [*t.encode().split(), b""]] for t in texts]
    starts = np.cumsum([0, *map(len, tokens)])[:-1]
    got = automaton.read(np.concatenate([np.array(t) for t in tokens]), starts, number[b""])
    assert np.allclose(got, [model.score(t) for t in texts], rtol=1e-12)


def test_a_walk_token_by_token():
    _, number, automaton = build(ROWS)
    weights = {k: w for k, w in zip(automaton.arcs.tolist(), automaton.arc_weights)}
    words = [number[w] for w in [*(ROWS[7][1]).encode().split(), b""]]
    state, total = number[b""], 0.0
    for word in words:
        key = int(arc_keys(automaton.words[[state]], automaton.words[[word]])[0])
        total += weights[key] if key in weights else automaton.failure_weights[state] + automaton.root_weights[word]
        state = word
    assert math.isclose(total, automaton.read(np.array(words), np.array([0]), number[b""])[0], rel_tol=1e-12)
