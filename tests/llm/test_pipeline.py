"""The pipeline against its stages written out."""

import random

import pytest

import corpus_pipeline
from veilcheck.llm.words import pieces

from tests.llm.test_decontaminate import slow_pairs
from tests.llm.test_host_quality import slow_measure
from tests.llm.test_near_dup import roots, slow_fingerprint


def corpus():
    rng = random.Random(11)
    words = [f"word{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(12)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(40, 120))), "en", f"s{i % 5}", 0) for i in range(200)]
    for i in range(200, 260):  # copies, and copies with a change
        text = rows[rng.randrange(100)][1].split()
        if i % 2:
            text[0] = "changed"
        rows.append((i, " ".join(text), "en", "s0", 0))
    for i in range(260, 290):
        text = rng.choices(words, k=80)
        at = rng.randrange(80)
        rows.append((i, " ".join(text[:at] + items[i % 12][1].split() + text[at:]), "en", "s1", 0))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, rows[5][1], "en", None, 1), (5, rows[5][1], "en", "s0", 0), (303, " ".join(rng.choices(words, k=30_000)), "en", "s2", 0)]
    rows += [(400 + i, "junk", "en", "bad", 0) for i in range(30)] + [(430, " ".join(rng.choices(words, k=70)), "en", "bad", 0)]
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "decontamination", "packing"]
    good = [r for r in rows if slow_measure(r[1])[0] >= 50 and r[3] != "bad"]
    root = roots([slow_fingerprint(r[1]) for r in good], 2)
    single = {min(g[0] for g, other in zip(good, root, strict=True) if other == r) for r in set(root)}
    dirty = {doc for doc, _ in slow_pairs([(r[0], r[1]) for r in good if r[0] in single], items)}
    wanted = [{r[0] for r in good}, single, single - dirty]
    found, at = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns and at.dtypes == docs.dtypes
        found.append({r.doc_id for r in at.select("doc_id").collect()})
    assert found == wanted
    assert at.count() == len(wanted[-1])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {r[0]: r[1] for r in rows}
    assert {r.doc_id for r in packed} == wanted[-1]
    assert sum(r.length for r in packed) == sum(len(text[d].encode()) + 1 for d in wanted[-1])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_pieces_are_whole(limit):
    import pyarrow as pa

    texts = ["abc", None, "", "é" * 40, "x", None]
    parts = list(pieces(pa.array(texts), limit))
    assert [t for part in parts for t in part] == [None if t is None else t.encode() for t in texts]
    assert list(pieces(pa.array([], pa.string()))) == []
