"""Following a secret variable through its file to risky calls.

The file's assignments and risky calls are its *events*, in line order.  A
sorted array of (word, event) is the graph from each name to its uses: a
bisection finds the events that mention a name after it was tainted.  A variable
is followed along this graph, earliest event first, so it visits only events
that mention a name it has reached, and a file of many variables costs what its
variables' own uses cost.  All of it stays in the file's row.

A variable is followed once, however many of its assignments hold a secret: its
*flow* lists the steps and the risky calls, each call with the number of steps
before it.  A secret's traces are the calls of its variable's flow, each with
its steps, apart from those on the secret's own line.  The *touches* of a file,
sorted by line, tell for each line which flows start or pass there, and with how
many traces; traces are written out only where somebody selects them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import flow
from ..functions.arrays import between, count_first, runs
from ..functions.text import bind, col, rstrip
from ..schemas import FLOWS, SINK, STEP, TOUCHES, TRACE, TRACES
from ..session import per_gateway


def flow_events(lines: Column) -> Column:
    """Assignments and risky calls in line order; an assignment precedes a call on its line."""

    def events(line, i):
        target, sink = flow.assignment_target(line), flow.sink_type(line)

        def event(target, sink, text):
            return F.struct(
                (i + 1).alias("line_number"), line.alias("line"), target.alias("target"), sink.alias("sink"),
                flow.words(text).alias("words"),
            )

        none = F.lit(None).cast("string")
        both = F.array(event(target, none, flow.assignment_value(line)), event(none, sink, line))
        return F.filter(both, lambda e: e["target"].isNotNull() | e["sink"].isNotNull())

    return F.flatten(F.transform(lines, events))


def mentions_of(events: Column) -> Column:
    """Which events mention which word, sorted by word and event."""
    return F.sort_array(F.flatten(F.transform(
        events, lambda e, i: F.transform(e["words"], lambda w: F.struct(w.alias("word"), i.alias("at")))
    )))


def rounds_of(events: Column, names: Column | None = None) -> Column:
    """Rounds enough, as rounds of rounds, to visit some names (one) and every name that the events assign."""
    targets = F.array_distinct(F.filter(F.transform(events, lambda e: e["target"]), lambda t: t.isNotNull()))
    return F.sequence(F.lit(1), F.ceil(F.sqrt(F.size(targets) + (1 if names is None else names))).cast("int"))


def _uses(mentions: Column, name: Column, since: Column) -> Column:
    """The mentions of a name in events after one."""
    return between(
        mentions, lambda m: (m["word"] < name) | ((m["word"] == name) & (m["at"] <= since)), lambda m: m["word"] <= name
    )


# Tainted names, each with the event that tainted it; what is tainted before the events has a number below zero.
NAMES = "array<struct<at:int,name:string>>"


def reached(events: Column, mentions: Column, rounds: Column, name: Column) -> Column:
    """The names that a name taints, itself first."""
    return _reached(events, mentions, rounds, _only(name), F.lit(0))


def _only(name: Column) -> Column:
    return F.array(F.struct(F.lit(-1).alias("at"), name.alias("name")))


def _reached(events: Column, mentions: Column, rounds: Column, names: Column, without: Column) -> Column:
    """The names that some names ``struct<at, name>`` taint, with these, each with the event that does, in that order."""
    start = F.struct(F.array().cast(NAMES).alias("known"), names.cast(NAMES).alias("waiting"))

    def visit(state, _):
        # The name that is tainted earliest cannot be tainted earlier by way of another.
        return F.when(F.size(state["waiting"]) == 0, state).otherwise(
            bind(F.array_min(state["waiting"]), lambda first: moved(state, first))
        )

    def moved(state, first):
        def assigned(m):
            e = F.get(events, m["at"])
            return F.struct(m["at"].alias("at"), F.when(e["line_number"] != without, e["target"]).alias("name"))

        found = F.concat(state["waiting"], F.transform(_uses(mentions, first["name"], first["at"]), assigned))
        return F.struct(
            F.concat(state["known"], F.array(first)).alias("known"),
            F.filter(found, lambda w: (
                w["name"].isNotNull() & (w["name"] != first["name"])
                & ~F.exists(state["known"], lambda k: k["name"] == w["name"])
            )).alias("waiting"),
        )

    # A name is visited once.  Rounds of rounds, so that little is spent on those that are not needed.
    def visits(state, _):
        return F.when(F.size(state["waiting"]) == 0, state).otherwise(F.aggregate(rounds, state, visit))

    return F.aggregate(rounds, start, visits, lambda state: state["known"])


def call_on(sinks: Column, line_number: Column) -> Column:
    """The number of steps before the call on a line, -1 without one."""
    return bind(F.get(sinks, count_first(sinks, lambda k: k["sink_line"] < line_number)), lambda k: (
        F.when(k["sink_line"] == line_number, k["depth"]).otherwise(F.lit(-1))
    ))


# The stages of a file's flows: each adds columns to the row.


@per_gateway
def _stages() -> list[dict[str, Column]]:
    events, mentions, rounds = F.col("_events"), F.col("_mentions"), F.col("_rounds")

    def placed(s, i):
        # A secret's own line takes no part.  That can change the flow only if it
        # assigns another variable; all other secrets of a variable share its flow.
        target = flow.assignment_target(F.get("_lines", s["line_number"] - 1))
        without = F.coalesce(F.when(target != s["variable"], s["line_number"]), F.lit(0))
        return F.struct(
            F.concat_ws(" ", F.when(without > 0, without), s["variable"]).alias("key"), i.alias("ord"),
            s["line_number"].alias("line"), s["variable"].alias("variable"), without.alias("without"),
        )

    def started(own):
        first = F.get(own, F.lit(0))
        return F.struct(
            own.alias("own"), first["without"].alias("without"),
            _reached(events, mentions, rounds, _only(first["variable"]), first["without"]).alias("known"),
        )

    found = F.when(F.size("_secrets") > 0, flow_events(F.col("_lines")))
    used = F.array_intersect(
        F.transform("_secrets", lambda s: s["variable"]), F.flatten(F.transform(events, lambda e: e["words"]))
    )
    live = F.filter(
        F.transform("_secrets", placed), lambda s: F.size(_uses(mentions, s["variable"], F.lit(-1))) > 0
    )
    return [
        {"_events": found},
        # Only where a secret's variable is used at all.
        {"_mentions": F.when(F.size(used) > 0, mentions_of(events)), "_rounds": rounds_of(events)},
        {"_live": F.when(mentions.isNotNull(), F.sort_array(live))},
        {"_flows": F.transform(runs(F.col("_live"), "key"), started)},
        *_followed(),
        {"_flows": F.transform("_flows", _whole)},
        {"_flows": F.coalesce("_flows", F.array()).cast(FLOWS)},
        {"_touches": touches_of(F.col("_flows"))},
    ]


def _followed() -> list[dict[str, Column]]:
    """Steps and risky calls of ``_flows`` that start with known names, stage by stage."""
    events, mentions, path = F.col("_events"), F.col("_mentions"), F.col("path")

    def hit(k, i):
        return F.transform(_uses(mentions, k["name"], k["at"]), lambda m: F.struct(
            m["at"].alias("at"), i.alias("ord"), k["name"].alias("name")
        ))

    def met(v):
        hits = F.sort_array(F.flatten(F.transform(v["known"], hit)))
        return F.struct(v["own"].alias("own"), v["without"].alias("without"), hits.alias("hits"))

    def touched(v):
        # The earliest tainted name that an event mentions is the one reported.
        firsts = F.filter(v["hits"], lambda h, i: (i == 0) | (F.get(v["hits"], i - 1)["at"] != h["at"]))
        found = F.transform(firsts, lambda h: F.struct(
            h["at"].alias("at"), h["name"].alias("name"), F.get(events, h["at"]).alias("event")
        ))
        return F.struct(
            v["own"].alias("own"), F.filter(found, lambda h: h["event"]["line_number"] != v["without"]).alias("touched")
        )

    def parted(v):
        moves = F.filter(v["touched"], lambda h: h["event"]["target"].isNotNull())
        calls = F.filter(v["touched"], lambda h: h["event"]["target"].isNull())
        return F.struct(v["own"].alias("own"), moves.alias("moves"), calls.alias("calls"))

    def step(h):
        e = h["event"]
        return F.struct(
            path.alias("file"), e["line_number"].alias("line_number"), rstrip(e["line"]).alias("line_content"),
            e["target"].alias("variable"), F.concat(F.lit("propagated from "), h["name"]).alias("action"),
        ).cast(STEP)

    def sink(h, moves):
        e = h["event"]
        return F.struct(
            e["sink"].alias("sink_type"), e["line_number"].alias("sink_line"), rstrip(e["line"]).alias("sink_content"),
            count_first(moves, lambda m: m["at"] < h["at"]).alias("depth"),
        ).cast(SINK)

    def listed(v):
        return F.struct(
            v["own"].alias("own"), F.transform(v["moves"], step).alias("steps"),
            F.transform(v["calls"], lambda h: sink(h, v["moves"])).alias("sinks"),
        )

    return [{"_flows": F.transform("_flows", stage)} for stage in (met, touched, parted, listed)]


def _whole(v: Column) -> Column:
    return F.struct(
        F.get(v["own"], F.lit(0))["variable"].alias("variable"),
        F.transform(v["own"], lambda s: F.struct(
            s["ord"].alias("ord"), s["line"].alias("line"), call_on(v["sinks"], s["line"]).alias("own")
        )).alias("sources"),
        v["steps"].alias("steps"), v["sinks"].alias("sinks"),
    )


@per_gateway
def piece_stages() -> list[dict[str, Column]]:
    """Stages that make ``_flows(own, steps, sinks)`` of a piece's ``_events`` and ``_started(own, names)``."""
    events, mentions, rounds = F.col("_events"), F.col("_mentions"), F.col("_rounds")

    def started(v):
        return F.struct(
            v["own"].alias("own"), F.lit(0).alias("without"),
            _reached(events, mentions, rounds, v["names"], F.lit(0)).alias("known"),
        )

    most = F.array_max(F.transform("_started", lambda v: F.size(v["names"])))
    return [
        {"_mentions": mentions_of(events), "_rounds": rounds_of(events, most)}, {"_flows": F.transform("_started", started)},
        *_followed(),
    ]


def with_flows(files: DataFrame) -> DataFrame:
    """Adds ``_flows`` and ``_touches`` to ``files(path, _lines, _secrets, ...)``.

    Secrets are ``struct<variable, line_number>``; ``sources`` of a flow lists
    its secrets in the order given, one that is given twice twice.  Variables
    that no right-hand side and no risky call mentions are left out first: a
    file full of unused secrets costs its length, not its length times its
    secrets.
    """
    kept = files.columns
    for columns in _stages():
        files = files.withColumns(columns)
    return files.select(*kept, "_flows", "_touches")


def touches_of(flows: Column) -> Column:
    """By line, the flows that start there or pass, and the number of their traces that do."""

    def of(f, number):
        def entry(line, n):
            return F.struct(line.alias("line"), number.alias("flow"), n.cast("int").alias("n"))

        def entries(lines, owns):
            sinks, steps, n = f["sinks"], f["steps"], F.size(lines)

            def here(line):
                return count_first(lines, lambda x: x <= line) - count_first(lines, lambda x: x < line)

            def start(line):
                # Every call but the one on the line itself.
                call = F.when(call_on(sinks, line) >= 0, 1).otherwise(0)
                return entry(line, here(line) * (F.size(sinks) - call))

            def passed(step, i):
                # Each source elsewhere has all later calls but the one on its own line.
                line, depth = step["line_number"], i + 1
                return bind(here(line), lambda h: entry(line, (
                    (n - h) * (F.size(sinks) - count_first(sinks, lambda k: k["depth"] < depth))
                    - (n - count_first(owns, lambda own: own < depth))
                    + F.when(call_on(sinks, line) >= depth, h).otherwise(0)
                )))

            return F.concat(F.transform(F.array_distinct(lines), start), F.transform(steps, passed))

        by_line = F.sort_array(F.transform(f["sources"], lambda s: s["line"]))
        owns = F.sort_array(F.transform(f["sources"], lambda s: s["own"]))
        found = bind(by_line, lambda lines: bind(owns, lambda owns: entries(lines, owns)))
        return F.when(F.size(f["sinks"]) == 0, F.array().cast(TOUCHES)).otherwise(found.cast(TOUCHES))

    return F.sort_array(F.filter(F.flatten(F.transform(flows, of)), lambda t: t["n"] > 0)).cast(TOUCHES)


def _touched(touches: Column, line_number: Column) -> Column:
    return between(touches, lambda t: t["line"] < line_number, lambda t: t["line"] <= line_number)


def trace_count(touches: Column, line_number: Column) -> Column:
    """How many traces start at a line or pass through it."""
    return F.aggregate(_touched(touches, line_number), F.lit(0), lambda total, t: total + t["n"])


def traces_through(flows: Column, touches: Column, path: Column, line_number: Column) -> Column:
    """The traces that start at a line or pass through it, in the order of their secrets."""
    numbers = F.array_distinct(F.transform(_touched(touches, line_number), lambda t: t["flow"]))
    return traces_at(F.transform(numbers, lambda i: F.get(flows, i)), path, line_number)


def traces_at(flows: Column, path: Column, line_number: Column | None = None) -> Column:
    """Of some flows, the traces that start at a line or pass through it (all without a line), in the order of their secrets."""

    def of(f):
        if line_number is None:
            return F.flatten(F.transform(f["sources"], lambda s: calls(f, s, F.lit(0))))
        step = F.array_position(F.transform(f["steps"], lambda s: s["line_number"]), line_number)
        return bind(step, lambda at: F.flatten(F.transform(
            F.filter(f["sources"], lambda s: (at > 0) | (s["line"] == line_number)),
            lambda s: calls(f, s, F.when(s["line"] == line_number, 0).otherwise(at)),
        )))

    def calls(f, s, least):
        later = F.filter(f["sinks"], lambda k: (k["sink_line"] != s["line"]) & (k["depth"] >= least))
        return F.transform(later, lambda k: trace(f, s, k))

    def trace(f, s, k):
        steps = F.filter(F.slice(f["steps"], F.lit(1), k["depth"]), lambda x: x["line_number"] != s["line"])
        whole = F.struct(
            f["variable"].alias("source_variable"), path.alias("source_file"), s["line"].alias("source_line"),
            k["sink_type"].alias("sink_type"), path.alias("sink_file"), k["sink_line"].alias("sink_line"),
            k["sink_content"].alias("sink_content"), steps.alias("steps"),
        ).cast(TRACE)
        return F.struct(s["ord"].alias("ord"), k["sink_line"].alias("sink_line"), whole.alias("trace"))

    listed = F.sort_array(F.flatten(F.transform(flows, of)))
    return F.transform(listed, lambda t: t["trace"]).cast(TRACES)


def taint_flows(files: DataFrame) -> DataFrame:
    """``flows`` of ``files(path, lines, secrets)``, one row per file that has any; other columns are kept.

    Files without flows are left out by a generator: a filter on the flows would
    be pushed to the text, and follow everything once more to decide.
    """
    others = [c for c in files.columns if c not in ("path", "lines", "secrets")]
    found = with_flows(files.select(*others, "path", F.col("lines").alias("_lines"), F.col("secrets").alias("_secrets")))
    some = F.filter(F.array(F.struct(F.col("_flows").alias("flows"))), lambda f: F.size(f["flows"]) > 0)
    return found.select(*others, "path", F.inline(some))


def taint_traces(files: DataFrame) -> DataFrame:
    """One row per trace of ``files(path, lines, secrets)``; other columns are kept."""
    flows = taint_flows(files)
    others = [c for c in flows.columns if c not in ("path", "flows")]
    return flows.select(*others, F.inline(traces_at(F.col("flows"), F.col("path"))))


def attach_traces(findings: DataFrame, flows: DataFrame) -> DataFrame:
    """Adds ``taint_traces`` and ``taint_count`` to findings, from ``flows(path, flows)`` kept as a table.

    Each file's touches are joined by file and line, so a finding meets only the
    flows that start at its line or pass there.
    """
    kept = [c for c in findings.columns if c not in ("taint_traces", "taint_count")]
    of_line = flows.select(F.col("path").alias("file"), "flows", F.inline(touches_of(F.col("flows")))).select(
        "file", F.col("line").alias("line_number"), "n", F.get("flows", F.col("flow")).alias("flow")
    )
    keys = ["file", "line_number"]
    counts = of_line.groupBy(*keys).agg(F.sum("n").cast("int").alias("_n"))
    touching = of_line.groupBy(*keys).agg(F.collect_set("flow").alias("_flows"))
    # Keys are unique on both right sides: a column that nobody selects costs no join.
    joined = findings.select(*kept).join(counts, keys, "left").join(touching, keys, "left")
    return joined.select(
        *kept, F.coalesce("_n", F.lit(0)).alias("taint_count"),
        traces_at(F.coalesce("_flows", F.array().cast(FLOWS)), F.col("file"), F.col("line_number")).alias("taint_traces"),
    )


def is_flow_file(ext: Column | str) -> Column:
    return col(ext).isin(fv.FLOW_EXTENSIONS)
