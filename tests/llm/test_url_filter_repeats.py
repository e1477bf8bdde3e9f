"""URLs that repeat thousands of times."""

from pyspark.sql import functions as F

from veilcheck.llm.url_filter import judge_urls, labelled_urls

PAGES = "page_id long, url string"


def test_repeated_urls_do_not_fill_the_labelled_table(spark):
    urls = [f"https://{name}-{i}.net/a" for i in range(10) for name in ("river", "casino")]
    pages = spark.createDataFrame([(i, urls[i % 20]) for i in range(4000)], PAGES).repartition(4)
    got = labelled_urls(pages, rows=20)
    assert sorted(r.url for r in got.collect()) == sorted(urls) and {r.label for r in got.collect()} == {0.0, 1.0}
    verdicts = {r.host.split("-")[0]: r.verdict for r in judge_urls(pages, got).collect()}
    assert verdicts == {"river": "allow", "casino": "block"}


def test_the_cut_by_hash_leaves_the_same_urls(spark):
    urls = [(i, f"https://h{i % 700}.example/p{i % 3000}") for i in range(6000)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = [r.url for r in labelled_urls(pages, rows=20).collect()]
    want = pages.select("url").distinct().orderBy(F.xxhash64("url"), "url").limit(20)
    assert sorted(got) == sorted(r.url for r in want.collect()) and len(got) == 20
