"""URL filter: host and path rules, and a logistic regression for all other URLs.

The model sees hashed character n-grams of host and path.  It is trained from a
small labelled table of URLs; rules are decided before it.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcheck.functions.text import bind
from veilcheck.session import written

#: Action, host and path of each rule; a rule fits its host and all subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Labelled rows that the model is trained from, at most.
TRAIN_ROWS = 4000
#: So many times as many URLs as that are compared.
MARGIN = 4
GRAMS = (3, 4, 5)
FEATURES = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of host names that mark a URL of the labelled table as unwanted.
UNWANTED = ("adult", "ads", "bet", "bets", "casino", "cheap", "gambling", "loan", "loans", "lottery", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "win", "xxx")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty without ``://``."""
    found = lambda group: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(found(1), _UPPER, _LOWER), found(2)


def rule_columns(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its action; null without one."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: ((host == r[1]) | host.endswith(f".{r[1]}")) & path.startswith(r[2])
    return F.coalesce(*(F.when(fits(r), r[1] + r[2]) for r in ordered)), F.coalesce(*(F.when(fits(r), r[0]) for r in ordered))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, told apart; ``^`` and ``$`` mark the ends of each."""

    def run(mark: str, chars: Column, n: int) -> Column:
        every = F.transform(chars, lambda c, i: F.concat(F.lit(mark), c, *(F.get(chars, i + k) for k in range(1, n))))
        return F.slice(every, F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(0)))

    def of(mark: str, part: Column) -> Column:
        # Bound, so that a URL is split once and not for every gram.
        return bind(F.split(F.concat(F.lit("^"), part, F.lit("$")), ""), lambda chars: F.concat(*(run(mark, chars, n) for n in GRAMS)))

    return F.concat(of("h", host), of("p", path))


def _features(table: DataFrame) -> DataFrame:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(table.withColumn("grams", grams(F.col("host"), F.col("path"))))


def labelled_urls(urls: DataFrame, url_col: str = "url", rows: int = TRAIN_ROWS) -> DataFrame:
    """A small labelled table ``(url, label)``: the URLs of least hash, unwanted (1) if a word of the host is in ``UNWANTED``.

    ``rows`` bounds the sample, which holds a URL once; which URLs it holds does
    not depend on their order.  URLs whose hash is far from the least ones are
    left out before any are compared.  An action: the table is written.  Null
    URLs are left out; an empty table gives an empty one.
    """
    url = F.col(url_col)
    words = F.split(host_and_path(url)[0], "[^a-z]+")
    label = F.arrays_overlap(words, F.array(*map(F.lit, UNWANTED))).cast("double")
    every = urls.filter(url.isNotNull()).select(url.alias("url"), label.alias("label"))
    different = every.agg(F.approx_count_distinct("url").alias("n")).first().n
    low = every
    if different > 2 * MARGIN * rows:
        least = every.filter(F.xxhash64("url") < int(MARGIN * rows / different * (1 << 64)) - (1 << 63))
        # A hash that happens to leave too few is not used.
        low = least if least.distinct().limit(rows).count() == rows else every
    return written(low.distinct().orderBy(F.xxhash64("url"), "url").limit(rows), "labelled")


def train(labelled: DataFrame):
    """The model of a labelled table ``(url, label)``; None where one of the labels is missing.

    Both labels weigh the same in all, however few rows one has.
    """
    host, path = host_and_path(F.col("url"))
    # One partition: sums have one order, and the model is the same in every run.
    table = labelled.filter(F.col("label").isNotNull()).select("url", "label", host.alias("host"), path.alias("path")).coalesce(1).sortWithinPartitions("url", "label")
    count = {r.label: r["count"] for r in table.groupBy("label").count().collect()}
    if len(count) < 2:
        return None
    weight = F.when(F.col("label") == 1, 0.5 / count[1.0]).otherwise(0.5 / count[0.0]) * sum(count.values())
    data = _features(table.withColumn("weight", weight))
    fit = LogisticRegression(maxIter=100, regParam=1e-3, standardization=False, weightCol="weight", aggregationDepth=2, maxBlockSizeInMB=4)
    return fit.fit(data.select("features", "label", "weight"))


def judge_urls(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict`` (``allow`` or ``block``) and ``unwanted`` (the model's probability).

    The longest fitting rule decides; where none fits, the model does.  A null
    URL, or one without ``://``, has empty host and path and is judged by the
    model's bias and end marks.  If the labelled table lacks one of the labels,
    URLs without a rule get the other label's verdict, and are allowed if it is
    empty; ``unwanted`` is then null.  Repeated rows yield a row each.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    model = train(labelled)
    if model:
        rows = model.transform(_features(rows))
        unwanted, other = F.element_at(vector_to_array("probability"), 2), F.when(F.col("prediction") == 1, "block").otherwise("allow")
    else:
        only = labelled.filter(F.col("label") == 1).isEmpty()
        unwanted, other = F.lit(None).cast("double"), F.lit("allow" if only else "block")
    return rows.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(action, other).alias("verdict"), unwanted.alias("unwanted"))

