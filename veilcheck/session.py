"""Session helpers: the shared folder, written tables and reliable checkpoints."""

from __future__ import annotations

import tempfile
from functools import wraps
from uuid import uuid4

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Rows of a few numbers that one file of a written table should hold.
FILE_ROWS = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the context's checkpoint folder.

    Spark sets it from ``spark.checkpoint.dir``; a folder given with
    ``SparkContext.setCheckpointDir`` counts as well.  Only a local session, as
    in tests, may go without: it takes a temporary folder.  A cluster without
    the setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="veilcheck-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex[:12]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so lost executors cannot change them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again.

    Like a checkpoint it cuts the lineage, and the size of the files lets Spark
    choose a join by what is really there.  ``rows``, the most narrow rows that
    there can be, keeps a small table from being written as a file per shuffle
    partition: there is a task for every ``FILE_ROWS`` of them at most.
    """
    path = work_dir(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_gateway(build):
    """Memoises a function that builds Columns: large expressions are built once per JVM."""
    cache: dict = {}

    @wraps(build)
    def cached(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in cache:
            cache[key] = build(*args)
        return cache[key]

    return cached
