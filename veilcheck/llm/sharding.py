"""Range sharding with sampled splitters: shards of nearly equal bytes.

Records are ordered by key.  A sample that draws each key in proportion to its
record's size gives quantiles, which cut the keys into many more ranges than
there are shards.  Ranges that turn out overfull are sampled and cut again.
Range totals then tell where each range lies among all bytes, and a running sum
within each (bounded) range puts every record into its shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilcheck.session import written

SHARDS = 16
#: Keys that a sample draws (on the average), the records that a range should have at most, and the least number of ranges per shard.
SAMPLE_KEYS, RANGE_ROWS, RANGES_PER_SHARD = 1 << 15, 1 << 16, 64
#: A range of more than so many times the mean bytes is cut again; the driver holds at most this many ranges.
OVERFULL, MAX_RANGES = 2, 1 << 17
_NO_KEY = -(1 << 63)


def find_ranges(keys: np.ndarray, ties: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """How many splitters (rows of key and tie, sorted) are at most ``(key, tie)``."""
    low, high = np.searchsorted(splitters[:, 0], keys, "left"), np.searchsorted(splitters[:, 0], keys, "right")
    found = low.copy()
    shared = np.flatnonzero(low < high)
    for key in np.unique(keys[shared]):
        at = shared[keys[shared] == key]
        a, b = low[at[0]], high[at[0]]
        found[at] = a + np.searchsorted(splitters[a:b, 1], ties[at], "right")
    return found


def quantiles(sample: pd.DataFrame, ranges: int) -> np.ndarray:
    """``ranges - 1`` splitters of a sample ``(key, tie, weight)`` that cut its weight evenly."""
    sample = sample.sort_values(["key", "tie"])
    before = np.cumsum(sample.weight.to_numpy()) - sample.weight.to_numpy()
    total = sample.weight.sum()
    at = np.unique(np.searchsorted(before, np.arange(1, ranges) * total / ranges))
    return sample[["key", "tie"]].to_numpy(np.int64)[at[at < len(sample)]]


def _sample(rows: DataFrame, total: int) -> pd.DataFrame:
    """Keys drawn in proportion to size, each with the bytes that it stands for."""
    draw = F.pmod(F.xxhash64("tie", "key"), F.lit(1 << 52)) / (1 << 52)
    share = F.least(F.lit(1.0), F.col("size") * (SAMPLE_KEYS / max(1, total)))
    return rows.filter(draw < share).select("key", "tie", (F.col("size") / share).alias("weight")).toArrow().to_pandas()


def _ranged(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tie = (batch.column(c).to_numpy() for c in ("key", "tie"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(find_ranges(key, tie, splitters))], [*batch.schema.names, "part"])

    return rows.mapInArrow(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", part long")


def _totals(rows: DataFrame) -> pd.DataFrame:
    sums = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    return sums.toArrow().to_pandas().sort_values("part")


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    ``size`` is the UTF-8 bytes of the text (none if null) plus one.  Shards
    are consecutive in the id; a document whose middle byte lies in the k-th of
    the equal parts of all bytes is in shard k, so that shards differ by less
    than two documents.  ``slot`` counts a shard's documents from zero in the order of
    ids.  Null ids come first; rows that share an id are told apart by a number
    of their own, so that a frequent id is cut like any other keys.  An empty
    table gives an empty result; ``law`` is ``bytes`` and ``grown_shard`` null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"))
    own = F.xxhash64("id", "crc", F.monotonically_increasing_id())
    rows = written(keyed.select("*", F.coalesce("id", F.lit(_NO_KEY)).alias("key"), own.alias("tie")), "keys")
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    ranges = min(MAX_RANGES, max(RANGES_PER_SHARD * shards, math.ceil(seen.n / RANGE_ROWS)))
    splitters = quantiles(_sample(rows, seen.bytes), ranges)
    while True:
        table = written(_ranged(rows, splitters), "ranges")
        totals = _totals(table)
        over = totals[(totals.n > 1) & (totals.bytes > OVERFULL * seen.bytes / ranges + totals.largest)]
        if over.empty or len(splitters) >= MAX_RANGES:
            break
        inside = table.join(F.broadcast(table.sparkSession.createDataFrame(over[["part"]])), "part", "left_semi")
        more = quantiles(_sample(inside, int(over.bytes.sum())), math.ceil(over.bytes.sum() * ranges / seen.bytes) + len(over))
        finer = np.unique(np.concatenate([splitters, more]), axis=0)
        if len(finer) == len(splitters):
            break
        splitters = finer
    totals["before"] = totals.bytes.cumsum() - totals.bytes
    spark = docs.sparkSession
    # At most MAX_RANGES rows.
    starts = F.broadcast(spark.createDataFrame(totals[["part", "before"]].astype("int64"), "part long, before long"))
    order = Window.partitionBy("part").orderBy("key", "tie")
    running = table.withColumns({"upto": F.sum("size").over(order), "nth": F.row_number().over(order)}).join(starts, "part")
    middle = F.expr(f"({shards} * (2 * (before + upto) - size)) div {max(1, 2 * seen.bytes)}")
    placed = running.withColumn("shard", middle.cast("int"))
    placed = written(placed.select("id", "size", "crc", "part", "shard", "nth"), "placed")
    # A range lies in one shard, or in a few that follow each other.
    cuts = placed.groupBy("shard", "part").agg(F.min("nth").alias("first"), F.count("*").alias("n")).toArrow().to_pandas().sort_values(["shard", "part"])
    cuts["offset"] = cuts.groupby("shard").n.cumsum() - cuts.n - cuts["first"]
    offsets = F.broadcast(spark.createDataFrame(cuts[["shard", "part", "offset"]].astype({"shard": "int32", "part": "int64", "offset": "int64"}), "shard int, part long, offset long"))
    return placed.join(offsets, ["shard", "part"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("nth") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


#: The same placement by one ordering of everything; CRC-32 by its table of 256 values.
SQL = """
WITH RECURSIVE g(i, c, k) AS (
       SELECT i, CAST(i AS BIGINT), 0 FROM range(256) r(i)
       UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM g WHERE k < 8),
     t AS (SELECT list(c ORDER BY i) AS tab FROM g WHERE k = 8),
     b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
     k AS (SELECT doc_id, len(bytes) + 1 AS size,
             xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
     r AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total FROM k),
     s AS (SELECT *, CAST((16 * (2 * upto - size)) // (2 * total) AS INTEGER) AS shard FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""
