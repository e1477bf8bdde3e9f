"""The scan of files beyond one task: pieces of lines, with the lines around them.

A piece carries the two lines before and after its own, so its matches and their
context are found where it lies.  Only what follows a variable through the file
crosses pieces, and only for files that hold secrets:

* The events of a piece (assignments and risky calls) say which names a name
  taints by the piece's end.  That is worked out within the piece, for the names
  that somebody asks for.
* A secret's variable asks all pieces that mention it; each name that it taints
  asks all later pieces.  A round of this carries all variables of all files
  over any number of pieces, so there are as many rounds as a chain of
  assignments crosses pieces, whatever the length of the file.
* With the names tainted before it, each piece lists its steps and risky calls.
  Their numbers, summed up over the pieces of a variable, count the traces that
  start at a line or pass there.

Findings are those of ``scan_content``.  Nothing but events is exchanged, and
no task holds more of a file than a piece.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed_values as fv
from ..functions import text
from ..functions.arrays import count_first
from ..operators import taint
from ..operators.rules import RuleSet
from ..options import DEFAULT_OPTIONS, ScanOptions
from ..schemas import FLOW, FLOWS
from ..session import written
from .scan import as_findings, detect_lines, with_hits

#: Lines of a piece of a text that lies in a table.
PIECE_LINES = 1 << 17
PIECE = ["piece", "n_pieces", "first_line", "before", "lines", "after"]


def cut_files(files: DataFrame, piece_lines: int = PIECE_LINES) -> DataFrame:
    """``(..., piece, n_pieces, first_line, before, lines, after)`` of ``files(path, content, ...)``; other columns are kept.

    ``lines`` are the piece's own, ``before`` and ``after`` up to two more on
    each side.  Pieces are dealt out over tasks, which moves each line once.  An
    empty or null text is one piece without lines.
    """
    kept = [c for c in files.columns if c not in ("content", *PIECE)]
    rows = files.select(*kept, F.coalesce(text.split_lines("content"), F.array().cast("array<string>")).alias("_lines"))
    n = F.greatest(F.lit(1), F.ceil(F.size("_lines") / piece_lines)).cast("int")

    def piece(i):
        start = i * piece_lines
        first = F.greatest(start - fv.CONTEXT_RADIUS, F.lit(0))
        return F.struct(
            i.alias("piece"), n.alias("n_pieces"), (start + 1).alias("first_line"),
            F.slice("_lines", first + 1, start - first).alias("before"),
            F.slice("_lines", start + 1, F.lit(piece_lines)).alias("lines"),
            F.slice("_lines", start + piece_lines + 1, F.lit(fv.CONTEXT_RADIUS)).alias("after"),
        )

    cut = rows.select(*kept, F.inline(F.transform(F.sequence(F.lit(0), n - 1), piece)))
    return cut.repartition("path", "piece")


def _piece_hits(pieces: DataFrame, rule_set: RuleSet | None, opts: ScanOptions) -> DataFrame:
    """One row per scored match on a piece's own lines, numbered as in the file."""
    kept = [c for c in pieces.columns if c not in ("before", "lines", "after", "first_line", "n_pieces")]
    rows = pieces.select(
        *kept, "first_line", F.size("before").alias("_skip"), F.size("lines").alias("_own"),
        F.concat("before", "lines", "after").alias("_lines"),
    )
    own = F.filter("_hits", lambda h: (h["line_number"] > F.col("_skip")) & (h["line_number"] <= F.col("_skip") + F.col("_own")))
    placed = F.transform(own, lambda h: h.withField("line_number", h["line_number"] + F.col("first_line") - 1 - F.col("_skip")))
    return with_hits(rows, rule_set, opts).select(*kept, F.inline(placed))


def _events(pieces: DataFrame, secrets: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, path, piece, first_line, _events)`` of the files that hold secrets."""
    columns = list(dict.fromkeys([*keys, "path"]))
    found = F.transform(
        taint.flow_events(F.col("lines")), lambda e: e.withField("line_number", e["line_number"] + F.col("first_line") - 1)
    )
    files = secrets.select(*keys).distinct()
    rows = pieces.filter(taint.is_flow_file(text.file_ext("path"))).select(*columns, "piece", "first_line", found.alias("_events"))
    return rows.join(files, keys, "left_semi")


def _words(events: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(events, lambda e: e["words"])))


def _uses(events: DataFrame, keys: list[str]) -> DataFrame:
    """Which piece mentions which name, and whether in an assignment."""
    moved = _words(F.filter("_events", lambda e: e["target"].isNotNull()))
    called = _words(F.filter("_events", lambda e: e["target"].isNull()))
    both = F.concat(
        F.transform(moved, lambda x: F.struct(x.alias("name"), F.lit(True).alias("moves"))),
        F.transform(F.array_except(called, moved), lambda x: F.struct(x.alias("name"), F.lit(False).alias("moves"))),
    )
    return events.select(*keys, "piece", F.inline(both))


def _links(events: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, piece, name, target, at)``: what a name that is tainted before a piece taints there, and on which line."""
    names = asked.groupBy(*keys, "piece").agg(F.collect_set("name").alias("_names"))

    def of(name):
        known = taint.reached(F.col("_events"), F.col("_mentions"), F.col("_rounds"), name)
        return F.transform(F.filter(known, lambda k: k["at"] >= 0), lambda k: F.struct(
            name.alias("name"), k["name"].alias("target"), F.get("_events", k["at"])["line_number"].alias("at")
        ))

    rows = events.join(names, [*keys, "piece"]).withColumns(
        {"_mentions": taint.mentions_of(F.col("_events")), "_rounds": taint.rounds_of(F.col("_events"))}
    )
    return rows.select(*keys, "piece", F.inline(F.flatten(F.transform("_names", of))))


def _tainted(events: DataFrame, uses: DataFrame, secrets: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, variable, name, at, since)``: the names that a variable taints, on which line and in which piece.  An action."""
    known = secrets.select(*keys, "variable").distinct().select(
        *keys, "variable", F.col("variable").alias("name"), F.lit(0).alias("at"), F.lit(-1).alias("since")
    )
    known = written(known, "names")
    moves, new, each = uses.filter("moves").drop("moves"), known, [*keys, "variable", "name"]
    while True:
        asked = new.join(moves, [*keys, "name"]).filter("piece > since")
        links = written(_links(events, asked.select(*keys, "piece", "name").distinct(), keys), "links")
        met = new.join(links.withColumnRenamed("at", "_at"), [*keys, "name"]).filter("piece > since").select(
            *keys, "variable", F.col("target").alias("name"), F.struct(F.col("_at").alias("at"), F.col("piece").alias("since")).alias("_first")
        )
        first = met.groupBy(*each).agg(F.min("_first").alias("_first"))
        better = first.join(known.withColumnRenamed("at", "_known").drop("since"), each, "left").filter("_known IS NULL OR _first.at < _known")
        new = written(better.select(*each, "_first.at", "_first.since"), "names")
        if new.isEmpty():
            return known
        earliest = F.min(F.struct("at", "since")).alias("_first")
        known = written(known.unionByName(new).groupBy(*each).agg(earliest).select(*each, "_first.at", "_first.since"), "names")


def _flows(events: DataFrame, uses: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, piece, variable, steps, sinks)`` of each variable in each piece; ``depth`` counts the piece's own steps."""
    here = known.join(uses.select(*keys, "name", "piece"), [*keys, "name"]).filter("piece > since")
    started = here.groupBy(*keys, "piece", "variable").agg(F.collect_list(F.struct("at", "name")).alias("names"))
    started = started.groupBy(*keys, "piece").agg(F.collect_list(F.struct("variable", "names")).alias("_entering"))

    # What was tainted before the piece comes first, in the order of its lines.
    def entered(v):
        return F.struct(
            F.array(F.struct(v["variable"].alias("variable"))).alias("own"),
            F.transform(v["names"], lambda x: F.struct((x["at"] - F.col("first_line")).alias("at"), x["name"].alias("name"))).alias("names"),
        )

    rows = events.join(started, [*keys, "piece"]).withColumn("_started", F.transform("_entering", entered))
    for columns in taint.piece_stages():
        rows = rows.withColumns(columns)
    found = F.transform("_flows", lambda f: F.struct(
        F.get(f["own"], F.lit(0))["variable"].alias("variable"), f["steps"].alias("steps"), f["sinks"].alias("sinks")
    ))
    flows = rows.select(*keys, "piece", F.inline(found))
    return flows.filter((F.size("steps") > 0) | (F.size("sinks") > 0))


def _with_offsets(flows: DataFrame, secrets: DataFrame, keys: list[str]) -> DataFrame:
    """Flows and sources of each variable by piece, with what lies in its other pieces."""
    each = [*keys, "variable", "piece"]
    sources = secrets.groupBy(*each).agg(F.sort_array(F.collect_list(F.struct("line_number", "ord"))).alias("sources"))
    rows = flows.join(sources, each, "full").withColumns({
        c: F.coalesce(c, F.array().cast(kind)) for c, kind in (
            ("steps", flows.schema["steps"].dataType), ("sinks", flows.schema["sinks"].dataType),
            ("sources", sources.schema["sources"].dataType),
        )
    })
    with_call = F.filter("sources", lambda s: taint.call_on(F.col("sinks"), s["line_number"]) >= 0)
    rows = written(rows.withColumn("calling", F.transform(with_call, lambda s: s["line_number"])), "variables")
    counts = rows.select(*each, *[F.size(c).alias(c) for c in ("steps", "sinks", "sources", "calling")])
    whole = Window.partitionBy(*keys, "variable")
    before = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *each, F.coalesce(F.sum("steps").over(before), F.lit(0)).alias("steps_before"),
        F.coalesce(F.sum("sinks").over(before), F.lit(0)).alias("sinks_before"),
        F.sum("sinks").over(whole).alias("n_sinks"), F.sum("sources").over(whole).alias("n_sources"),
        (F.sum("calling").over(whole) - F.coalesce(F.sum("calling").over(before), F.lit(0)) - F.col("calling")).alias("calling_after"),
    )
    return rows.join(offsets, each)


def _touches(variables: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, variable, line_number, n)``: the traces of a variable that start at a line or pass there."""
    sources, sinks, calling = F.col("sources"), F.col("sinks"), F.col("calling")

    def here(line):
        return count_first(sources, lambda s: s["line_number"] <= line) - count_first(sources, lambda s: s["line_number"] < line)

    def entry(line, n):
        return F.struct(line.alias("line_number"), n.cast("long").alias("n"))

    def start(line):
        call = F.when(taint.call_on(sinks, line) >= 0, 1).otherwise(0)
        return entry(line, here(line) * (F.col("n_sinks") - call))

    def passed(step):
        line = step["line_number"]
        later = F.col("n_sinks") - F.col("sinks_before") - count_first(sinks, lambda k: k["sink_line"] < line)
        own = F.col("calling_after") + F.size(calling) - count_first(calling, lambda x: x <= line)
        return entry(line, (F.col("n_sources") - here(line)) * later - own)

    lines = F.array_distinct(F.transform(sources, lambda s: s["line_number"]))
    found = F.concat(F.transform(lines, start), F.transform("steps", passed))
    return variables.select(*keys, "variable", F.inline(found)).filter("n > 0")


def _whole_flows(variables: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, variable, flow)``: a variable's flow over all its pieces."""
    sinks = F.transform("sinks", lambda k: k.withField("depth", (k["depth"] + F.col("steps_before")).cast("int")))
    parts = variables.select(*keys, "variable", "piece", "sources", "steps", sinks.alias("sinks"))
    together = parts.groupBy(*keys, "variable").agg(F.sort_array(F.collect_list(F.struct("piece", "sources", "steps", "sinks"))).alias("_parts"))
    joined = {c: F.flatten(F.col(f"_parts.{c}")) for c in ("sources", "steps", "sinks")}
    sources = F.transform(joined["sources"], lambda s: F.struct(s["ord"].alias("ord"), s["line_number"].alias("line"), F.lit(-1).alias("own")))
    flow = F.struct(F.col("variable"), sources.alias("sources"), joined["steps"].alias("steps"), joined["sinks"].alias("sinks"))
    return together.select(*keys, "variable", flow.cast(FLOW).alias("flow"))


def _secrets(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The hits on assignments in code, numbered through their file."""
    found = hits.filter(F.col("variable").isNotNull() & taint.is_flow_file(text.file_ext("path")))
    within = Window.partitionBy(*keys, "piece").orderBy("line_number", "rule_ord", "match_ord")
    counts = found.groupBy(*keys, "piece").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("piece")) - F.col("_n")
    numbered = found.select(*keys, "piece", "variable", "line_number", F.row_number().over(within).alias("_i"))
    placed = numbered.join(counts.select(*keys, "piece", before.alias("_before")), [*keys, "piece"])
    return placed.select(*keys, "piece", "variable", "line_number", (F.col("_i") + F.col("_before") - 1).cast("int").alias("ord"))


def scan_pieces(pieces: DataFrame, rule_set: RuleSet | None = None, opts: ScanOptions = DEFAULT_OPTIONS,
                keys: list[str] | None = None) -> DataFrame:
    """Findings of files in pieces, as ``scan_content`` finds them; other columns are kept in front.  An action.

    ``pieces`` come from ``cut_files`` or ``read_pieces``.  ``keys`` name the
    columns that tell files apart (``path``).  A file of one piece is scanned in
    its row, with the flow of its variables; the others as above.  Events and
    names of the latter are kept in the shared folder while variables are
    followed; ``taint_traces`` is put together only where it is selected.
    """
    keys = keys or ["path"]
    if "source" not in pieces.columns:
        pieces = pieces.withColumn("source", F.lit("current"))
    kept = [c for c in pieces.columns if c not in PIECE]
    others = [c for c in kept if c not in ("path", "source")]
    whole = detect_lines(pieces.filter("n_pieces = 1").select(*kept, F.col("lines").alias("_lines")), rule_set, opts)
    parts = pieces.filter("n_pieces > 1")
    hits = written(_piece_hits(parts, rule_set, opts), "hits")
    secrets = written(_secrets(hits, keys), "secrets")
    events = written(_events(parts, secrets, keys), "events")
    uses = written(_uses(events, keys), "uses")
    known = _tainted(events, uses, secrets, keys)
    flows = written(_flows(events, uses, known, keys), "flows")
    variables = written(_with_offsets(flows, secrets, keys), "variables")
    touches = written(_touches(variables, keys), "touches")
    at = [*keys, "line_number"]
    counts = touches.groupBy(*at).agg(F.sum("n").cast("int").alias("_n"))
    # A line may be a source and a step of one variable.
    touching = touches.select(*at, "variable").distinct().join(_whole_flows(variables, keys), [*keys, "variable"])
    touching = touching.groupBy(*at).agg(F.collect_list("flow").alias("_flows"))
    # Keys are unique on both right sides: a column that nobody selects costs no join.
    joined = hits.join(counts, at, "left").join(touching, at, "left")
    detected = joined.select(
        *[c for c in hits.columns if c != "piece"], F.coalesce("_n", F.lit(0)).alias("taint_count"),
        taint.traces_at(F.coalesce("_flows", F.array().cast(FLOWS)), F.col("path"), F.col("line_number")).alias("taint_traces"),
    )
    return reduce(DataFrame.unionByName, [as_findings(d, others, opts) for d in (whole, detected)])
