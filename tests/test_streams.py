import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests import corpus
from veilcheck.plans.scan import scan_content
from veilcheck.streaming import files as file_stream
from veilcheck.streaming import lines as line_stream

LINES = [
    (1, 0, "AKIA before"), (1, 1, "CMD:SCAN_START"), (1, 2, " # ghp_x "), (1, 3, ""), (1, 4, "x"), (1, 5, "CMD:SCAN_END"),
    (1, 6, "eyJ after"), (1, 7, "CMD:SCAN_END"),
    (2, 0, "CMD:SCAN_START"), (2, 1, "eyJ"), (2, 2, " CMD:SCAN_START "), (2, 3, "clean"), (2, 4, "CMD:SCAN_END"),
    (3, 0, "xoxb-"), (3, 1, "CMD:SCAN_END"), (4, 0, "CMD:SCAN_START"), (4, 1, "AIza open end"),
]
SCHEMA = "session_id long, seq int, line string"
VERDICTS = [(1, 5, "AUTHORIZE_EXPORT"), (1, 7, "SCAN_CLEAN"), (2, 4, "SCAN_CLEAN"), (3, 1, "SCAN_CLEAN")]
ALARMS = [(1, 2, "ghp_", "# ghp_x"), (2, 1, "eyJ", "eyJ"), (4, 1, "AIza", "AIza open end")]


def drained(spark, stream, folder):
    file_stream.run_available(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_batch_alarms_and_verdicts(spark):
    lines = spark.createDataFrame(LINES, SCHEMA)
    alarms = line_stream.session_alarms(lines).select("session_id", "seq", "pattern", "line")
    assert sorted(map(tuple, alarms.collect())) == ALARMS
    assert sorted(map(tuple, line_stream.session_verdicts(lines).collect())) == VERDICTS
    assert line_stream.prefix_alarms(lines).count() == 6


def test_stream_equals_batch_across_triggers(spark, tmp_path):
    # Two triggers: sessions 1 and 2 are cut in the middle.
    source = str(tmp_path / "in")
    lines = spark.createDataFrame(LINES, SCHEMA)
    events = lambda: line_stream.session_events(spark.readStream.schema(SCHEMA).parquet(source))
    lines.filter("seq < 3").repartition(1).write.parquet(source)
    drained(spark, events(), tmp_path)
    lines.filter("seq >= 3").repartition(1).write.mode("append").parquet(source)
    out = drained(spark, events(), tmp_path)
    alarms = out.filter("kind = 'alarm'").select("session_id", "seq", "pattern", "line")
    verdicts = out.filter("kind = 'verdict'").select("session_id", "seq", "pattern")
    assert sorted(map(tuple, alarms.collect())) == ALARMS
    assert sorted(map(tuple, verdicts.collect())) == VERDICTS


def test_one_session_with_most_lines(spark):
    lines = spark.createDataFrame([(0, 0, "CMD:SCAN_START"), (0, 100_001, "CMD:SCAN_END")], SCHEMA).unionByName(
        spark.range(1, 100_001).select(F.lit(0).cast("long").alias("session_id"), F.col("id").cast("int").alias("seq"),
                                       F.concat(F.lit("eyJ"), "id").alias("line")))
    assert line_stream.session_alarms(lines).count() == 100_000
    assert line_stream.session_verdicts(lines).collect()[0].verdict == "AUTHORIZE_EXPORT"


def test_one_session_with_many_intervals(spark):
    """A hundred thousand intervals of one session, every third one with an alarm."""
    n = F.col("id")
    lines = spark.range(100_000).select(F.explode(F.array(
        F.struct((n * 3).alias("seq"), F.lit("CMD:SCAN_START").alias("line")),
        F.struct((n * 3 + 1).alias("seq"), F.when(n % 3 == 0, "eyJ").otherwise("x").alias("line")),
        F.struct((n * 3 + 2).alias("seq"), F.lit("CMD:SCAN_END").alias("line")),
    )).alias("r")).select(F.lit(5).cast("long").alias("session_id"), F.col("r.seq").cast("int").alias("seq"), "r.line")
    assert line_stream.session_alarms(lines).count() == 33_334
    counts = {r.verdict: r["count"] for r in line_stream.session_verdicts(lines).groupBy("verdict").count().collect()}
    assert counts == {"AUTHORIZE_EXPORT": 33_334, "SCAN_CLEAN": 66_666}


def test_file_stream_equals_batch(spark, files, tmp_path):
    texts = files(corpus.texts())
    texts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
    out = drained(spark, file_stream.scan_stream(stream), tmp_path)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, scan_content(texts).collect()))


def test_file_stream_drops_repeats(spark, files, tmp_path):
    texts = files(corpus.texts()).withColumn("at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    texts.write.parquet(str(tmp_path / "in"))
    read = lambda: file_stream.scan_stream(
        spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in")), event_time="at")
    drained(spark, read(), tmp_path)
    texts.write.mode("append").parquet(str(tmp_path / "in"))
    assert drained(spark, read(), tmp_path).count() == len(corpus.FINDINGS)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_in_any_order_across_triggers(spark, tmp_path, seed):
    """Every line in a trigger of its own, shuffled, gives the verdicts of the table."""
    source, rng = str(tmp_path / "in"), random.Random(seed)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", line_stream.ROCKSDB)
    table = spark.createDataFrame(LINES, SCHEMA)
    rows = [(*r, datetime(2026, 1, 1) + timedelta(seconds=r[1])) for r in LINES]
    rng.shuffle(rows)
    # A line of another session, hours later, lets the watermark pass all others.
    for part in (rows[:6], rows[6:12], rows[12:] + rows[:2], [(9, 0, "CMD:SCAN_END", datetime(2026, 1, 2))]):
        spark.createDataFrame(part, SCHEMA + ", at timestamp").coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    stream = spark.readStream.schema(SCHEMA + ", at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    try:
        out = drained(spark, line_stream.ordered_events(stream, "at"), tmp_path).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r.session_id, r.seq, r.pattern) for r in out if r.kind == "verdict") == VERDICTS
    assert sorted((r.session_id, r.seq, r.pattern, r.line) for r in out if r.kind == "alarm") == ALARMS
    assert sorted(map(tuple, line_stream.session_verdicts(table).collect())) == VERDICTS


def test_ordered_events_ask_for_their_state_store(spark, tmp_path):
    spark.createDataFrame([], SCHEMA + ", at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA + ", at timestamp").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="RocksDB"):
        line_stream.ordered_events(stream, "at")


def test_state_is_by_groups_of_sessions(spark, tmp_path):
    """State and calls do not grow with the sessions, and session numbers beyond a double's digits stay whole beside a null."""
    first = 2**62 + 1
    ids = spark.range(first, first + 3000).withColumnRenamed("id", "session_id").unionByName(
        spark.createDataFrame([(None,)], "session_id long"))
    rows = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(x).alias("line")) for i, x in enumerate(
        ["CMD:SCAN_START", "eyJ", "plain", "CMD:SCAN_END", "CMD:SCAN_START"])])
    ids.select("session_id", F.inline(rows)).coalesce(2).write.parquet(str(tmp_path / "in"))
    events = line_stream.session_events(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    run = file_stream.run_available(events, str(tmp_path / "out"), str(tmp_path / "state"))
    assert run.recentProgress[-1].stateOperators[0].numRowsTotal <= line_stream.SESSION_GROUPS
    out = spark.read.schema(events.schema).parquet(str(tmp_path / "out"))
    assert out.filter("kind = 'verdict' AND pattern = 'AUTHORIZE_EXPORT' AND seq = 3").select("session_id").distinct().count() == 3001
    assert out.count() == 2 * 3001 and out.filter("session_id IS NULL").count() == 2
    assert out.agg(F.min("session_id"), F.max("session_id")).first() == (first, first + 2999)
