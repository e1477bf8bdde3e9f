"""Tables of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_texts(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet table of texts; ``spark.sql.files.maxPartitionBytes`` sizes the tasks that scan it."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
