"""Packing: everything in its place, in short enough and full enough bins."""

import random

import numpy as np
import pytest

from veilcheck.llm import packing
from veilcheck.llm.packing import LENGTHS, pack, pack_sequences

DOCS = "doc_id long, text string"


def check(rows, lengths):
    """Pieces of a bin follow each other without a gap, and the bin is the shortest that holds them."""
    bins = {}
    for size, bin_, offset, length in rows:
        bins.setdefault((bin_, length), []).append((offset, size))
    for (_, length), inside in bins.items():
        end = 0
        for offset, size in sorted(inside):
            assert offset == end
            end += size
        assert length == min(c for c in lengths if c >= end)
    return bins


@pytest.mark.parametrize("seed", range(5))
def test_pack(seed):
    rng = random.Random(seed)
    sizes = sorted((min(LENGTHS[-1], int(rng.lognormvariate(7, 1.2)) + 1) for _ in range(2000)), reverse=True)
    at, offset, length = pack(sizes)
    bins = check(zip(sizes, at, offset, length, strict=True), LENGTHS)
    assert sum(sizes) / sum(c for _, c in bins) > 0.98


def test_pack_is_best_fit():
    # Worked by hand: 6 and 5 open bins of ten; 4 fits the fuller one exactly, 3 the other, 2 what is left there.
    at, offset, length = pack([6, 5, 4, 3, 2], (10,), 0)
    assert at.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 6, 5, 8] and length.tolist() == [10] * 5


def test_bins_shrink_and_the_cheapest_opens():
    at, _, length = pack([3], (4, 8, 16))
    assert length.tolist() == [4]
    # A high fixed cost favours one long bin over several short ones.
    assert len(set(pack([4] * 4, (4, 16), 8)[0].tolist())) == 1
    assert len(pack([], (4, 8))[0]) == 0


def test_documents_are_covered(spark):
    rng = random.Random(9)
    rows = [(i, "é" * rng.randint(0, 1500)) for i in range(300)] + [(400, "x" * 100_000), (401, None), (402, ""), (None, "abc"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", bin int")
    got = pack_sequences(docs).collect()
    check([(r.length, r.bin, r.bin_offset, r.bin_length) for r in got], LENGTHS)
    for doc, text in rows:
        size = len((text or "").encode()) + 1
        pieces = sorted((r.start, r.length) for r in got if r.doc_id == doc)
        if doc != 5:
            assert [s for s, _ in pieces] == list(range(0, size, LENGTHS[-1])) and sum(n for _, n in pieces) == size
    assert sum(r.length for r in got if r.doc_id == 5) == len(rows[5][1].encode()) + 1 + 12
    assert sum(r.length for r in got) == sum(len((t or "").encode()) + 1 for _, t in rows)


def test_given_lengths_many_groups_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_PIECES", 50)
    docs = spark.createDataFrame([(i % 3 and i, i % 40) for i in range(900)] + [(1000, None), (1001, -5)], "doc_id long, n int")
    got = pack_sequences(docs, length_col="n", lengths=(16, 64), group_pieces=100).collect()
    assert len(got) == 902
    check([(r.length, r.bin, r.bin_offset, r.bin_length) for r in got], (16, 64))
    assert sum(r.length for r in got) == sum(max(1, i % 40) for i in range(900)) + 2
    again = pack_sequences(docs.repartition(7), length_col="n", lengths=(16, 64), group_pieces=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty(spark):
    assert pack_sequences(spark.createDataFrame([], DOCS)).collect() == []


def test_numbers_are_plain(spark):
    row = pack_sequences(spark.createDataFrame([(1, "ab")], DOCS)).first()
    assert row == (1, 0, 0, 3, 0, LENGTHS[0], 0) and not isinstance(row.bin, np.integer)


def slow_pack(sizes, lengths, fixed_cost):
    """Best fit by looking at every bin each time."""
    bins, out = [], []
    for i, size in enumerate(sizes):
        fitting = [(b["length"] - b["used"], n) for n, b in enumerate(bins) if b["length"] - b["used"] >= size]
        if fitting:
            bin_ = min(fitting)[1]
        else:
            free = sum(b["length"] - b["used"] for b in bins)
            spare = max(0, sum(sizes[i + 1 :]) - free)
            length = min((c for c in lengths if c >= size), key=lambda c: ((c + fixed_cost) / min(c, size + spare), c))
            bins.append({"length": length, "used": 0})
            bin_ = len(bins) - 1
        out.append((bin_, bins[bin_]["used"]))
        bins[bin_]["used"] += size
    return [(b, o, min(c for c in lengths if c >= bins[b]["used"])) for b, o in out]


@pytest.mark.parametrize("seed", range(12))
def test_pack_equals_brute_force(seed):
    rng = random.Random(seed)
    lengths = tuple(sorted(rng.sample(range(4, 200), rng.randint(1, 5))))
    sizes = sorted((rng.randint(1, lengths[-1]) for _ in range(rng.randint(0, 300))), reverse=True)
    cost = rng.choice([0, 1, 16, 64])
    assert list(zip(*map(list, pack(sizes, lengths, cost)), strict=True)) == slow_pack(sizes, lengths, cost)


def test_documents_equal_brute_force(spark):
    """One group: the whole table packed by looking at every bin."""
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 40_000)) for i in range(150)]
    got = pack_sequences(spark.createDataFrame(rows, DOCS), group_pieces=1 << 20).collect()
    pieces = sorted((-min(LENGTHS[-1], len(t) + 1 - start), i, start // LENGTHS[-1]) for i, t in rows for start in range(0, len(t) + 1, LENGTHS[-1]))
    want = slow_pack([-n for n, _, _ in pieces], LENGTHS, packing.FIXED_COST)
    assert sorted((r.doc_id, r.piece, r.bin, r.bin_offset, r.bin_length) for r in got) == sorted((i, p, *w) for (_, i, p), w in zip(pieces, want, strict=True))
