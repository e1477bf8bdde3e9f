"""Quality rules judged per document and per host.

Each document is measured and fails the base rules or not.  Failures are
counted by host, each host's rate is shrunk towards the rate of all by a beta
prior that is estimated from the hosts themselves, and a host whose shrunk rate
is too high fails with all its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcheck.llm.words import pieces
from veilcheck.session import written

MIN_WORDS = 50
MAX_REPEAT_SHARE = 0.5
#: A host fails if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength, in documents; the upper one holds where hosts do not differ.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    size = np.uint64(len(known))
    pairs = ids[:-1] * size + ids[1:]
    if len(known) >= 1 << 21:  # three ids do not fit in 64 bits
        pairs, size = np.unique(pairs, return_inverse=True)[1].astype(np.uint64), np.uint64(len(known))
    windows = pairs[:-1] * size + ids[2:]
    ordered = np.sort(windows)
    again = ordered[1:] == ordered[:-1]
    if not again.any():
        return 0
    hit = np.isin(windows, ordered[1:][again])
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows; a null text has none."""
    raw = text or b""
    words, chars = raw.split(), raw.decode()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(chars) - sum(map(chars.count, _BLANKS)),
        sum(map(chars.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measures(text: Column) -> Column:
    """A struct of the measures of a text."""
    names = [field.split()[0] for field in MEASURES.split(", ")]

    @F.arrow_udf(f"struct<{MEASURES.replace(' long', ':long')}>")
    def run(texts: pa.Array) -> pa.Array:
        rows = np.array([measure(text) for part in pieces(texts) for text in part], np.int64).reshape(-1, len(names))
        return pa.StructArray.from_arrays([pa.array(rows[:, i].copy()) for i in range(len(names))], names)

    return run(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > int(100 * MAX_REPEAT_SHARE) * n_words)


def host_rates(measured: DataFrame, host_col: str = "host") -> DataFrame:
    """``(host, n_docs, n_failed, rate)`` of ``measured(host, base_failed)``; rows without a host take no part.

    The prior of the rates is a beta distribution about the rate of all
    documents.  Its strength follows from the correlation of failures within
    hosts (one-way analysis of variance), kept between fixed bounds.  With one
    host, or one document per host, the upper bound holds.
    """
    hosts = (
        measured.filter(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col).alias("host"))
        .agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    )
    hosts = written(hosts, "hosts")
    total = hosts.agg(
        F.sum("n").cast("double").alias("n"),
        F.sum("f").cast("double").alias("f"),
        F.count("*").cast("double").alias("j"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
        # The sums of squares of both levels, from sums of counts alone.
        F.sum(F.col("f").cast("double") * F.col("f") / F.col("n")).alias("f2"),
    )
    between = F.try_divide(F.col("f2") - F.try_divide(F.col("f") * F.col("f"), F.col("n")), F.col("j") - 1)
    within = F.try_divide(F.col("f") - F.col("f2"), F.col("n") - F.col("j"))
    size = F.try_divide(F.col("n") - F.try_divide(F.col("n2"), F.col("n")), F.col("j") - 1)
    # (1 - rho) / rho of the intraclass correlation rho.
    prior = total.select(between.alias("between"), within.alias("within"), size.alias("size"), F.try_divide("f", "n").alias("mean"))
    strength = F.try_divide(F.col("size") * F.col("within"), F.col("between") - F.col("within"))
    strength = F.when(F.col("between") > F.col("within"), strength)
    bounded = F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), F.coalesce(strength, F.lit(MAX_STRENGTH))))
    prior = prior.select(bounded.alias("strength"), "mean")
    weight, mean = prior.select("strength").scalar(), prior.select("mean").scalar()
    return hosts.select("host", F.col("n").alias("n_docs"), F.col("f").alias("n_failed"), ((F.col("f") + mean * weight) / (F.col("n") + weight)).alias("rate"))


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Id, host, measures and base verdict of each document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), measures(F.col(text_col)).alias("m")).select("id", "host", "m.*")
    return rows.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, the measures, ``base_failed``, ``host_rate`` and ``kept``.

    A document is kept unless it fails the base rules or its host fails.  A
    document without a host is judged by the base rules alone (``host_rate``
    null); a null text counts as empty and fails.  Repeated rows yield a row
    and count for their host each.
    """
    rows = written(measured(docs, id_col, text_col, host_col), "measured")
    hosts = written(host_rates(rows).select("host", F.col("rate").alias("host_rate")), "host_rates")
    kept = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= MAX_HOST_RATE)
    return rows.join(hosts, "host", "left").withColumn("kept", kept).withColumnRenamed("id", id_col).drop("host")


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns; texts are measured where they lie, and only hosts that fail travel."""
    rows = docs.select(F.col(host_col).alias("host"), measures(F.col(text_col)).alias("m")).select("host", "m.*")
    rates = host_rates(rows.select("host", base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed")))
    failed = written(rates.filter(F.col("rate") > MAX_HOST_RATE).select(F.col("host").alias(host_col)), "failed_hosts")
    mark = "_" + max(docs.columns, key=len)  # a name that no column has
    passed = docs.withColumn(mark, measures(F.col(text_col)))
    passed = passed.filter(~base_failed(F.col(f"{mark}.n_words"), F.col(f"{mark}.n_repeat_words"))).select(docs.columns)
    return passed.join(failed, host_col, "left_anti").select(docs.columns)


#: The same measures, prior and verdicts over plain lists and windows; ids are unique.
SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
     w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
     p AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i,
             unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS three FROM w),
     g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS found FROM p),
     c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(3) r(k) WHERE found > 1 GROUP BY doc_id),
     m AS (SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
     b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(100 * MAX_REPEAT_SHARE)} * n_words AS base_failed FROM m),
     h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
     s AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS j, sum(n * n) AS n2, sum(f * f / n) AS f2 FROM h),
     v AS (SELECT f / n AS mean, (f2 - f * f / n) / nullif(j - 1, 0) AS between_, (f - f2) / nullif(n - j, 0) AS within_, (n - n2 / n) / nullif(j - 1, 0) AS size FROM s),
     z AS (SELECT mean, greatest({MIN_STRENGTH}, least({MAX_STRENGTH},
             coalesce(CASE WHEN between_ > within_ THEN size * within_ / (between_ - within_) END, {MAX_STRENGTH}))) AS strength FROM v),
     q AS (SELECT source, (f + mean * strength) / (n + strength) > {MAX_HOST_RATE} AS failed FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(failed, false) AS kept
FROM b LEFT JOIN q ON q.source = b.source
"""
