"""Range shards against one ordering of everything."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest

from veilcheck.llm import sharding
from veilcheck.llm.sharding import find_ranges, quantiles, shard_by_bytes

DOCS = "doc_id long, text string"


def slow_shards(rows, shards=16):
    """Shard and slot by position; ids are unique."""
    sized = sorted((-(1 << 63) if d is None else d, d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    total, before, slots, found = sum(r[2] for r in sized), 0, {}, []
    for _, doc, size, crc in sized:
        shard = shards * (2 * before + size) // (2 * total)
        found.append((doc, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return found


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(i * 7 % n, "é" * int(rng.paretovariate(0.8) * 5) if rng.random() < 0.9 else None) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"SAMPLE_KEYS": 20}, {"SAMPLE_KEYS": 40, "RANGES_PER_SHARD": 2}, {"SAMPLE_KEYS": 0}])
def test_shards(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(sharding, name, value)
    rows = [*texts(500), (None, "no id"), (501, ""), (502, "x" * 3000)]
    docs = spark.createDataFrame([(*r, 3, "b") for r in rows], DOCS + ", shard int, law string").repartition(4)
    got = shard_by_bytes(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got))) == sorted(map(str, slow_shards(rows)))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_sizes_are_near_equal_and_ranges_follow_the_key(spark):
    got = shard_by_bytes(spark.createDataFrame([(i, "x" * (i % 50)) for i in range(4000)], DOCS)).collect()
    sums = [sum(r.size for r in got if r.shard == k) for k in range(16)]
    assert max(sums) - min(sums) <= 2 * 50
    ends = [(min(r.doc_id for r in got if r.shard == k), max(r.doc_id for r in got if r.shard == k)) for k in range(16)]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_a_frequent_id_is_cut_as_well(spark):
    rows = [(7, "the same")] * 600 + [(i, f"other {i}") for i in range(300)]
    got = shard_by_bytes(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 900
    sums = [sum(r.size for r in got if r.shard == k) for k in range(16)]
    assert max(sums) - min(sums) <= 2 * 11
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_overfull_ranges_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLE_KEYS", 16)
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", 1)
    seen = []
    monkeypatch.setattr(sharding, "_ranged", lambda rows, splitters, f=sharding._ranged: seen.append(len(splitters)) or f(rows, splitters))
    rows = [(i, "x" * (i % 7)) for i in range(3000)]
    got = shard_by_bytes(spark.createDataFrame(rows, DOCS)).collect()
    assert len(seen) > 1 and seen == sorted(set(seen))
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == sorted(slow_shards(rows))


def test_find_ranges():
    splitters = np.array([[3, 5], [3, 9], [8, 0]])
    keys, ties = np.array([1, 3, 3, 3, 3, 7, 8, 8, 9]), np.array([0, 4, 5, 8, 9, 0, -1, 0, 0])
    assert find_ranges(keys, ties, splitters).tolist() == [0, 0, 1, 1, 2, 2, 2, 3, 3]


def test_quantiles():
    sample = pd.DataFrame({"key": range(100), "tie": 0, "weight": 1.0})
    assert quantiles(sample, 4)[:, 0].tolist() == [25, 50, 75]
    assert len(quantiles(sample.head(0), 4)) == 0


def test_empty_and_single(spark):
    assert shard_by_bytes(spark.createDataFrame([], DOCS)).collect() == []
    row = shard_by_bytes(spark.createDataFrame([(4, None)], DOCS)).first()
    assert (row.doc_id, row.size, row.text_crc32, row.slot) == (4, 1, 0, 0) and 0 <= row.shard < 16
