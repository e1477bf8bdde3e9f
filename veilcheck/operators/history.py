"""History: which blobs of which commits to scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed_values as fv
from ..options import DEFAULT_OPTIONS, ScanOptions
from ..session import written
from .paths import skip_paths

PLACE = ["commit_ord", "path_ord"]
MOST_LISTED = 1 << 17


def newest_commits(blobs: DataFrame, n: int = fv.HISTORY_COMMITS, repo: list[str] | None = None) -> DataFrame:
    """The blobs of the newest ``n`` commits (of each ``repo``, if given).  An action: the commits are written first.

    A few commits hold all blobs, so an exchange by commit would give one task
    most of the text.  Their list goes to the tasks instead; only one of more
    than MOST_LISTED commits is left to Spark, which divides such tasks.
    """
    repo = repo or []
    # Commits first: distinct pairs shrink on the map side and carry no text.
    commits = blobs.select(*repo, "commit_ord").distinct()
    if repo:
        rank = F.row_number().over(Window.partitionBy(*repo).orderBy("commit_ord"))
        newest = commits.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    else:
        newest = commits.orderBy("commit_ord").limit(n)
    newest = written(newest, "newest-commits")
    listed = F.broadcast(newest) if newest.count() <= MOST_LISTED else newest
    return blobs.join(listed, [*repo, "commit_ord"], "left_semi")


def first_places(keys: DataFrame, repo: list[str] | None = None) -> DataFrame:
    """Where each blob hash occurs first, in (commit, path) order.

    Needs no text, and combines on the map side: a hash that fills a third of
    the table costs no more than any other.
    """
    repo = repo or []
    return keys.groupBy(*repo, "blob_hash").agg(F.min(F.struct(*PLACE)).alias("_place")).select(*repo, "_place.*")


def first_blob(blobs: DataFrame, repo: list[str] | None = None) -> DataFrame:
    """The first occurrence of each blob hash; a blob's place is a unique join key."""
    return blobs.join(first_places(blobs, repo), [*(repo or []), *PLACE], "left_semi")


def history_files(blobs: DataFrame, max_commits: int = fv.HISTORY_COMMITS, opts: ScanOptions = DEFAULT_OPTIONS,
                  repo: list[str] | None = None) -> DataFrame:
    """``files(path, content, source)`` to scan from ``blobs``.

    What to scan is decided on the keys alone, of each ``repo`` by itself if
    given.  Texts of older commits, skipped paths and empty blobs are dropped
    before they are exchanged for the final semi-join.  An empty blob claims its
    hash before it is dropped.
    """
    kept = skip_paths(newest_commits(blobs, max_commits, repo), "parts", opts)
    first = kept.filter(F.col("content") != "").join(
        first_places(kept.drop("content"), repo), [*(repo or []), *PLACE], "left_semi"
    )
    path = F.concat(
        F.lit("history/"), F.substring("commit_id", 1, fv.HISTORY_COMMIT_DIGITS), F.lit("/"), "path"
    )
    return first.select(
        *(repo or []), path.alias("path"), "content", F.lit("history").alias("source")
    )
