"""Alarms and verdicts on a stream of lines.

``lines(session_id, seq, line)`` holds sessions: a start marker, lines, an end
marker.  A line with an alarm substring inside a session is an alarm; the end
marker yields the session's verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from .. import fixed_values as fv
from ..functions import labels, text
from ..session import checkpointed

EVENT_SCHEMA = "session_id long, seq int, kind string, pattern string, line string"


def _signals(lines: DataFrame, *more: Column) -> DataFrame:
    """Markers and alarm candidates, with more columns; all other lines end here, before any shuffle."""
    # White space at the ends is no part of what is looked for, so lines are left out before they are stripped.
    raw = F.col("line")
    lines = lines.filter(raw.contains(fv.STREAM_START) | raw.contains(fv.STREAM_END) | labels.alarm_pattern(raw).isNotNull())
    line = text.strip("line")
    kind = (
        F.when(line == fv.STREAM_START, "start")
        .when(line == fv.STREAM_END, "end")
        .when(labels.alarm_pattern(line).isNotNull(), "alarm")
    )
    return lines.select(
        "session_id", "seq", kind.alias("kind"),
        F.when(kind == "alarm", labels.alarm_pattern(line)).alias("pattern"),
        F.when(kind == "alarm", line).alias("line"), *more,
    ).filter("kind is not null")


def prefix_alarms(lines: DataFrame) -> DataFrame:
    """Lines with an alarm substring, whether or not a session is open.  Stateless."""
    return _signals(lines).filter("kind = 'alarm'").select(
        "session_id", "seq", F.lit(fv.ALARM_SEVERITY).alias("severity"), "pattern", "line"
    )


def _with_last_marker(signals: DataFrame) -> DataFrame:
    """Signals with the kind and ``seq`` of the session's marker before them, ``last`` (null without one).  An action.

    Signals are sorted by session and sequence over range partitions, and the
    last marker is carried forward within each; what a session brings along from
    earlier partitions is one marker per partition.  A session with most of the
    signals is spread over as many tasks as its size needs, and no signal is
    paired with more than one marker.
    """
    ordered = checkpointed(signals.orderBy("session_id", "seq").withColumn("_part", F.spark_partition_id()))
    marker = F.when(F.col("kind") != "alarm", F.struct("kind", "seq"))
    within = Window.partitionBy("_part", "session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("session_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per session and partition; null where the partition has alarms only.
    per_part = ordered.groupBy("_part", "session_id").agg(F.max_by(marker, F.when(marker.isNotNull(), F.col("seq"))).alias("_marker"))
    brought = per_part.select("_part", "session_id", F.last("_marker", ignorenulls=True).over(earlier).alias("_brought"))
    carried = ordered.withColumn("_own", F.last(marker, ignorenulls=True).over(within))
    return carried.join(brought, ["_part", "session_id"]).select(*signals.columns, F.coalesce("_own", "_brought").alias("last"))


def session_alarms(lines: DataFrame) -> DataFrame:
    """Alarms inside sessions, for a table of lines."""
    return _with_last_marker(_signals(lines)).filter("kind = 'alarm' AND last.kind = 'start'").select(
        "session_id", "seq", F.lit(fv.ALARM_SEVERITY).alias("severity"), "pattern", "line"
    )


def session_verdicts(lines: DataFrame) -> DataFrame:
    """One verdict per end marker, for a table of lines."""
    signals = _with_last_marker(_signals(lines))
    opened = F.when(F.col("last.kind") == "start", F.col("last.seq")).alias("opened")
    ends = signals.filter("kind = 'end'").select("session_id", "seq", opened)
    # Alarms only need to exist: those of one interval combine on the map side.
    alarmed = (
        signals.filter("kind = 'alarm' AND last.kind = 'start'").groupBy("session_id", opened)
        .agg(F.lit(True).alias("alarmed"))
    )
    verdict = F.when(F.col("alarmed"), fv.VERDICT_ALARM).otherwise(fv.VERDICT_CLEAN)
    return ends.join(alarmed, ["session_id", "opened"], "left").select("session_id", "seq", verdict.alias("verdict"))


_EVENT_COLUMNS = ["session_id", "seq", "kind", "pattern", "line"]
# Sessions share state by hash.  A state outlives the run, so the number of groups is fixed.
SESSION_GROUPS = 1024
_SCANNING = "session_id array<long>, unnumbered array<boolean>, alarmed array<boolean>"


def _grouped(signals: DataFrame):
    """Signals by groups of sessions: a call per session would cost more than its few signals."""
    group = F.pmod(F.xxhash64("session_id"), F.lit(SESSION_GROUPS)).cast("int").alias("group")
    # One without a number has 0 and a flag, since pandas would turn the numbers beside a null into doubles.
    number = F.coalesce("session_id", F.lit(0)).alias("session_id")
    others = [c for c in signals.columns if c != "session_id"]
    return signals.select(group, number, F.isnull("session_id").alias("unnumbered"), *others).groupBy("group")


def _judged(signals: pd.DataFrame, scanning: dict) -> pd.DataFrame:
    """The events of signals, each session's in the order of the rows.

    ``scanning`` has the open sessions, each with whether it had an alarm, and is brought up to date.
    """
    out = []
    columns = [signals[c] for c in ["session_id", "unnumbered", *_EVENT_COLUMNS[1:]]]
    for number, unnumbered, seq, kind, pattern, line in zip(*columns):
        session = None if unnumbered else int(number)
        seq = None if pd.isna(seq) else int(seq)
        if kind == "start":
            scanning[session] = False
        elif kind == "end":
            alarmed = scanning.pop(session, False)
            out.append((session, seq, "verdict", fv.VERDICT_ALARM if alarmed else fv.VERDICT_CLEAN, None))
        elif session in scanning:
            scanning[session] = True
            out.append((session, seq, "alarm", pattern, line))
    events = pd.DataFrame(out, columns=_EVENT_COLUMNS, dtype=object)
    return events.astype({"session_id": "Int64", "seq": "Int32"})


def _scanning(state: tuple | None) -> dict:
    return {None if unnumbered else number: alarmed for number, unnumbered, alarmed in zip(*state)} if state else {}


def _scanning_state(scanning: dict) -> tuple:
    return [s or 0 for s in scanning], [s is None for s in scanning], list(scanning.values())


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One trigger's signals of a group of sessions, in sequence; state is the open sessions."""
    # Only signals get here, and the source's options (such as maxFilesPerTrigger) limit a trigger's share of them.
    signals = pd.concat(list(batches)).sort_values(["unnumbered", "session_id", "seq"])
    scanning = _scanning(state.get if state.exists else None)
    events = _judged(signals, scanning)
    if scanning:
        state.update(_scanning_state(scanning))
    elif state.exists:
        state.remove()
    yield events


def session_events(stream: DataFrame) -> DataFrame:
    """Alarms and verdicts of a stream of lines that arrive in order, in one stateful pass.

    A session may span triggers; state has the open sessions, each with a flag.  Rows: ``kind`` is
    ``alarm`` (with pattern and line) or ``verdict`` (with the verdict as pattern).
    """
    return _grouped(_signals(stream)).applyInPandasWithState(
        _advance, EVENT_SCHEMA, _SCANNING, "append", GroupStateTimeout.NoTimeout
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_WAITING = {
    "session_id": "long", "unnumbered": "boolean", "at": "long", "seq": "int", "kind": "string", "pattern": "string", "line": "string",
}
# Waiting signals in one entry of the list.
_CHUNK = 4096


class _InOrder(StatefulProcessor):
    """Signals of a group of sessions, put in order before they are judged.

    A signal waits until the watermark has passed it, so that all before it have
    come.  State: the open sessions, the waiting signals in chunks, and the
    time of the next timer.  A timer judges what is due and sets the next.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scanning = handle.getValueState("scanning", _SCANNING)
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} array<{t}>" for c, t in _WAITING.items()))
        self.next = handle.getValueState("next", "at long")

    def _wake_at(self, at: int) -> None:
        planned = self.next.get()[0] if self.next.exists() else None
        if planned is None or at < planned:
            if planned is not None:
                self.handle.deleteTimer(planned)
            self.handle.registerTimer(at)
            self.next.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = None
        for batch in rows:
            self.waiting.appendList(_chunks(batch))
            first = int(batch["at"].min())
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake_at(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        chunks = [dict(zip(_WAITING, chunk)) for chunk in self.waiting.get()]
        waiting = pd.concat([pd.DataFrame(chunk) for chunk in chunks], ignore_index=True)
        place = ["unnumbered", "session_id", "at", "seq"]
        # Of a signal that is repeated, the one that came last counts.
        waiting = waiting.drop_duplicates(place, keep="last").sort_values(place)
        due = waiting["at"] <= now
        scanning = _scanning(self.scanning.get() if self.scanning.exists() else None)
        events = _judged(waiting[due], scanning)
        self.scanning.update(_scanning_state(scanning))
        self.next.clear()
        later = waiting[~due]
        if len(later):
            self.waiting.put(_chunks(later))
            self._wake_at(int(later["at"].min()))
        else:
            self.waiting.clear()
        yield events

    def close(self) -> None:
        pass


def _chunks(signals: pd.DataFrame) -> list[tuple]:
    """Signals as list entries, each an array per column."""
    return [
        tuple(signals[c].iloc[i : i + _CHUNK].tolist() for c in _WAITING) for i in range(0, len(signals), _CHUNK)
    ]


def ordered_events(stream: DataFrame, event_time: str, delay: str = "1 hour") -> DataFrame:
    """``session_events`` of a stream whose lines may arrive in any order.

    Lines carry the time they were written, ``event_time``, which does not fall
    as ``seq`` rises.  A line may come up to ``delay`` later than any that was
    written after it; what comes later still is dropped, as the watermark says.
    A signal is judged once the watermark has passed it.  Lines of one time go
    by ``seq``; one that is repeated counts once.  What waits of a session is
    its signals of the last ``delay``.  Sessions without a number are one
    session; lines without a time or a sequence number are left out.

    The state needs Spark's RocksDB provider, ``spark.sql.streaming.stateStore.providerClass``.
    """
    if stream.sparkSession.conf.get(_PROVIDER) != ROCKSDB:
        raise ValueError(f"set {_PROVIDER} to {ROCKSDB}")
    signals = _signals(stream.withWatermark(event_time, delay), F.col(event_time).alias("_time")).filter("_time IS NOT NULL AND seq IS NOT NULL")
    timed = signals.withColumn("at", F.unix_millis("_time"))
    return _grouped(timed).transformWithStateInPandas(_InOrder(), EVENT_SCHEMA, "append", "eventTime")
