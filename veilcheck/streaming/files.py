"""Continuous scanning of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.findings import DEDUP_KEY
from ..operators.rules import RuleSet
from ..options import DEFAULT_OPTIONS, ScanOptions
from ..plans.scan import scan_content


def scan_stream(files: DataFrame, rule_set: RuleSet | None = None, opts: ScanOptions = DEFAULT_OPTIONS,
                event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Findings of a stream ``files(path, content, ...)``.

    The scan needs no state.  With ``event_time``, repeats of a finding that
    arrive within ``delay`` of each other are dropped, which takes state for
    that long only.
    """
    if event_time:
        files = files.withWatermark(event_time, delay)
    found = scan_content(files, rule_set, opts)
    return found.dropDuplicatesWithinWatermark(DEDUP_KEY) if event_time else found


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Processes everything that has arrived into Parquet files, and waits for it."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
