"""Quality measures and host verdicts against plain Python."""

import random
import re
from collections import Counter

import pytest

from veilcheck.llm.host_quality import MAX_HOST_RATE, MAX_STRENGTH, MIN_STRENGTH, host_rates, judge, keep_good, measure

DOCS = "doc_id long, text string, source string"


def slow_measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(line in lines[:i] for i, line in enumerate(lines)), len(hit)


@pytest.mark.parametrize(
    "text",
    [None, "", " \n\t", "a", "a b c", "a b c a b c", "a a a a a", "x y\nx y\n\nx y \n", "é ü # $ | <b>  ", "a\x0bb\x0cc\rd e\x1cf", "one two three four " * 40, "&" * 10_000, "p q r s p q r t q r s"],
)
def test_measure(text):
    assert measure(None if text is None else text.encode()) == slow_measure(text)


def test_measure_of_random_texts():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("ab \n#|é", k=rng.randint(0, 120)))
        assert measure(text.encode()) == slow_measure(text)


def slow_rates(hosts):
    n, f, j = sum(h[0] for h in hosts.values()), sum(h[1] for h in hosts.values()), len(hosts)
    mean = f / n
    strength = MAX_STRENGTH
    if j > 1 and n > j:
        between = sum(c * (b / c - mean) ** 2 for c, b in hosts.values()) / (j - 1)
        within = sum(c * (b / c) * (1 - b / c) for c, b in hosts.values()) / (n - j)
        size = (n - sum(c * c for c, _ in hosts.values()) / n) / (j - 1)
        if between > within:
            rho = (between - within) / (between + (size - 1) * within)
            strength = min(MAX_STRENGTH, max(MIN_STRENGTH, (1 - rho) / rho))
    return {h: (b + mean * strength) / (c + strength) for h, (c, b) in hosts.items()}


@pytest.mark.parametrize("hosts", [{"a": (10, 9), "b": (100, 10), "c": (80, 4), "d": (2, 2)}, {"a": (5, 1)}, {"a": (1, 1), "b": (1, 0)}, {"a": (50, 0), "b": (50, 0)}, {"a": (9, 9), "b": (7, 0)}])
def test_rates(spark, hosts):
    rows = [(h, i < bad) for h, (n, bad) in hosts.items() for i in range(n)] + [(None, True)] * 3
    got = {r.host: r.rate for r in host_rates(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert got == pytest.approx(slow_rates(hosts))


def rows():
    rng = random.Random(2)
    good = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(60))
    found = [(i, good() if i % 9 else "short", f"s{i % 4}") for i in range(80)]
    found += [(100 + i, "bad" if i < 19 else good(), "worst") for i in range(20)]
    return [*found, (200, good(), None), (201, None, None), (202, "", "s0"), (203, good(), "new"), (0, found[0][1], "s0")]


def test_bad_hosts_go_with_all_their_documents(spark):
    docs = spark.createDataFrame([(*r, "x", True) for r in rows()], DOCS + ", host string, kept boolean")
    got = {r.doc_id: r for r in judge(docs).collect()}
    assert judge(docs).count() == len(rows())
    hosts = {}
    for _, text, host in rows():
        if host:
            hosts.setdefault(host, []).append(slow_measure(text)[0] < 50)
    rates = slow_rates({h: (len(x), sum(x)) for h, x in hosts.items()})
    assert rates["worst"] > MAX_HOST_RATE > max(v for h, v in rates.items() if h != "worst")
    for doc, text, host in rows():
        assert tuple(got[doc][1:6]) == slow_measure(text)
        assert got[doc].base_failed == (slow_measure(text)[0] < 50)
        assert got[doc].kept == (not got[doc].base_failed and host != "worst")
    good = keep_good(docs)
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(d for d, _, h in rows() if got[d].kept)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert judge(docs).collect() == [] and keep_good(docs).collect() == []
