"""Numbering the rows of a whole table in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed

# monotonically_increasing_id counts a task's rows in its low 33 bits.
_ROW_BITS = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[Column], start: int = 0) -> DataFrame:
    """Adds ``idx``, the position of each row in ``order``.  An action: it computes and writes the rows.

    One window over the table would pull it into one task.  Instead the rows are
    range-partitioned and sorted, each task numbers its own, and only one count
    per task is summed to get the offsets.  The sorted rows are checkpointed, so
    both uses see the same partitions.
    """
    ordered = checkpointed(
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    # One row per sort task: its size follows the partition count, not the data.
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn("idx", F.col("_offset") + F.col("_pos") + start)
        .drop("_part", "_pos", "_offset")
    )


def number_rows_by(df: DataFrame, by: list[str], order: list[str], start: int = 0) -> DataFrame:
    """Adds ``idx``, the position of each row within its group.

    A group is a run of the overall order, so its first position is all that is
    needed; no task has to hold a group.
    """
    numbered = number_rows(df, [F.col(c) for c in [*by, *order]])
    first = numbered.groupBy(*by).agg(F.min("idx").alias("_first"))
    return numbered.join(first, by).withColumn("idx", F.col("idx") - F.col("_first") + start).drop("_first")
