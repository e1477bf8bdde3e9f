"""URL rules against a plain reading, and the model on URLs that it has not seen."""

import random
import re

import pytest

from veilcheck.llm.url_filter import RULES, UNWANTED, judge_urls, labelled_urls

PAGES = "page_id long, url string"


def slow_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def slow_rule(host, path):
    fits = [(len(h + p), h + p, action) for action, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, None))[1:]


URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://EXAMPLE.ORG/es/", "https://example.org/es", "https://a.example.org/es/x?q#f", "https://example.org/en/1",
    "https://example.org/en/2", "https://notexample.org/es/1", "https://com/fr/", "https://x.com/fr/a", "https://x.com/de/a#x", "https://xcom/de/a", "x://y://z.org/",
    "https://example.org?x=/es/", "https://org/", "https://org", "http://É.com/de/ü", "http://a.b\n.org/es/\nx", "https://example.org/es/" + "x" * 50_000,
    "https://example.com/fr/1://a.org/", "http://user@host.org:80/de/", "//example.org/es/",
]


def labelled(rng, n):
    good = ["alpha", "river", "garden", "history", "museum", "letters", "weather", "cooking", "science", "village"]
    rows = []
    for i in range(n):
        bad = rng.random() < 0.2
        name = f"{rng.choice(['', 'www.', 'm.'])}{rng.choice(good)}{f'-{rng.choice(UNWANTED)}' if bad else f'-{rng.choice(good)}'}{rng.randrange(50)}.net"
        rows.append((i, f"https://{name}/{rng.choice(['en', 'it'])}/{rng.randrange(1000)}", float(bad)))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([r[1:] for r in labelled(random.Random(1), 600)], "url string, label double")


def test_hosts_paths_and_rules(spark, table):
    pages = spark.createDataFrame([(i, u, "x", 0.5) for i, u in enumerate(URLS)] + [(3, URLS[3], "y", 0.1), (None, URLS[5], "z", 0.1)], PAGES + ", verdict string, label double")
    got = judge_urls(pages, table).collect()
    assert len(got) == len(URLS) + 2
    for row in got:
        if row.page_id is None:
            continue
        url = URLS[row.page_id]
        assert (row.host, row.path) == slow_host_path(url)
        rule, action = slow_rule(row.host, row.path)
        assert row.rule == rule and row.verdict in ("allow", "block") and (action is None or row.verdict == action)


def test_held_out_accuracy(spark, table):
    rows = labelled(random.Random(2), 400)
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame([r[:2] for r in rows], PAGES), table).collect()}
    right = sum((got[i].verdict == "block") == bool(label) for i, _, label in rows)
    assert right / len(rows) > 0.97
    assert all((got[i].unwanted > 0.5) == (got[i].verdict == "block") for i, _, _ in rows)


def test_one_label_or_none(spark, table):
    pages = spark.createDataFrame([(1, "https://a.net/x"), (2, "https://b.org/x")], PAGES)
    verdicts = lambda t: {r.page_id: r.verdict for r in judge_urls(pages, t).collect()}
    assert verdicts(table.limit(0)) == {1: "allow", 2: "allow"}
    assert verdicts(table.filter("label = 0")) == {1: "allow", 2: "allow"}
    assert verdicts(table.filter("label = 1")) == {1: "block", 2: "allow"}


def test_labelled_urls(spark):
    pages = spark.createDataFrame([(i, f"https://{'casino' if i % 4 == 0 else 'house'}{'-' if i % 8 else ''}x{i}.net/") for i in range(100)] + [(100, None)], PAGES)
    rows = labelled_urls(pages, rows=50).collect()
    assert len(rows) == 50 and rows == labelled_urls(pages.repartition(5), rows=50).collect()
    assert all(r.label == float("casino-" in r.url) for r in rows if "casinox" not in r.url)


def test_empty(spark, table):
    assert judge_urls(spark.createDataFrame([], PAGES), table).collect() == []
    assert labelled_urls(spark.createDataFrame([], PAGES)).collect() == []
