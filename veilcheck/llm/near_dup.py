"""SimHash near-duplicates: shards of a vantage-point tree, exact links, components.

A fingerprint goes down a tree of vantage points: inside where its Hamming
distance to the point is within the node's radius, outside otherwise.  By the
triangle inequality, two fingerprints at most ``max_bits`` apart differ by at
most that in their distances to the point, so an outside fingerprint no more
than ``max_bits`` beyond the radius visits the inside as well, and nothing else
crosses.  Every close pair therefore meets in at least one shard, in which all
fingerprints are compared exactly.  Shards hand on stars of their components,
never pairs, and the stars are contracted over the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilcheck.llm.words import bit_rows, majority_bits, pieces, seeded_shingles
from veilcheck.session import written

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints that a shard should hold, and beyond which it is split again.
SHARD_ROWS, FULL_SHARD = 2048, 8192
#: Per round, at most so many shards are split, into so many shards each, by samples of so many rows altogether: what the driver holds is bounded by these.
SPLIT_SHARDS, SPLIT_INTO, SAMPLE_ROWS = 256, 256, 1 << 16
#: A split that leaves a child with more than this share of the rows has failed.
SPLIT_SHARE = 0.9
#: Buckets of ids, of which those are marked that hold one to go.
MARKS = 1 << 23
_BLOCK = 1 << 16


# Fingerprints


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text's shingles, repeats included; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    total = max(1, len(words) - shingle_words + 1)
    hashes = seeded_shingles(words, shingle_words, SEED)
    counts = np.zeros(64, np.int64)
    for _ in range(0, total, _BLOCK):
        block = np.fromiter((h for _, h in zip(range(_BLOCK), hashes, strict=False)), np.uint64) if total > _BLOCK else np.fromiter(hashes, np.uint64, total)
        counts += bit_rows(block).sum(0, dtype=np.int64)
    return int(majority_bits(counts, total))


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The 64 bits of :func:`fingerprint` as a long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        found = [fingerprint(text, shingle_words) for part in pieces(texts) for text in part]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return run(text)


# The tree


@dataclass
class VantageTree:
    """Nodes as arrays; a negative child ``-1 - k`` is shard ``k``."""

    points: list[int] = field(default_factory=list)
    radii: list[int] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    outside: list[int] = field(default_factory=list)
    shards: int = 0
    largest: float = 0.0

    def route(self, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and shards: each fingerprint's own shard, and those that it visits."""
        rows, homes, todo = [], [], [(0 if self.points else -1, np.arange(len(prints)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                rows.append(at)
                homes.append(np.full(len(at), -1 - node, np.int64))
                continue
            away = np.bitwise_count(prints[at] ^ np.uint64(self.points[node])).astype(np.int64)
            todo.append((self.inside[node], at[away <= self.radii[node] + max_bits]))
            todo.append((self.outside[node], at[away > self.radii[node]]))
        return np.concatenate(rows), np.concatenate(homes)


def _best_split(sample: np.ndarray, max_bits: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """The vantage point and radius, of a few tried, by which the fewest cross for the balance that is gained."""
    best = None
    for point in rng.choice(sample, min(8, len(sample)), replace=False):
        held = np.cumsum(np.bincount(np.bitwise_count(sample ^ point), minlength=65 + max_bits)) / len(sample)
        for radius in range(64):
            share = held[radius]
            if 0.25 <= share <= 0.75:
                crossing = held[min(64, radius + max_bits)] - share
                gain = -(share * math.log2(share) + (1 - share) * math.log2(1 - share))
                cost = math.log2(1 + crossing) / gain
                if best is None or cost < best[0]:
                    best = (cost, int(point), radius)
    return best and best[1:]


def build_tree(sample: np.ndarray, into: int, max_bits: int, seed: int = SEED) -> VantageTree:
    """A tree of about ``into`` shards over a sample of fingerprints."""
    tree, rng, total = VantageTree(), np.random.default_rng(seed), len(sample)

    def grow(part: np.ndarray, into: float) -> int:
        split = _best_split(part, max_bits, rng) if into >= 1.5 and len(part) > 16 else None
        if split is None:
            tree.shards += 1
            tree.largest = max(tree.largest, len(part) / max(1, total))
            return -tree.shards
        node = len(tree.points)
        for column, value in ((tree.points, split[0]), (tree.radii, split[1]), (tree.inside, 0), (tree.outside, 0)):
            column.append(value)
        away = np.bitwise_count(part ^ np.uint64(split[0]))
        near, far = part[away <= split[1] + max_bits], part[away > split[1]]
        tree.inside[node] = grow(near, into * len(near) / (len(near) + len(far)))
        tree.outside[node] = grow(far, into * len(far) / (len(near) + len(far)))
        return node

    grow(sample, into)
    return tree


def _split(table: DataFrame, trees: dict[int, tuple[int, VantageTree]], max_bits: int) -> DataFrame:
    """Moves the rows of the shards in ``trees`` into their new shards; other rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            rest = np.ones(len(shards), bool)
            for shard, (first, tree) in trees.items():
                mine = np.flatnonzero(shards == shard)
                if len(mine):
                    rest[mine] = False
                    at, home = tree.route(prints[mine].view(np.uint64), max_bits)
                    yield pa.record_batch([pa.array(home + first), pa.array(prints[mine][at])], ["shard", "fp"])
            if rest.any():
                yield pa.record_batch([pa.array(shards[rest]), pa.array(prints[rest])], ["shard", "fp"])

    return table.mapInArrow(run, "shard long, fp long")


def shards(prints: DataFrame, max_bits: int = MAX_BITS) -> tuple[DataFrame, list[int]]:
    """``prints(fp)`` as ``(shard, fp)``, each row in its own shard and those it visits, and the shards that no radius divides."""
    table, nxt, dense = prints.select(F.lit(0).cast("long").alias("shard"), "fp"), 1, []
    while True:
        sizes = table.groupBy("shard").count().filter((F.col("count") > FULL_SHARD) & ~F.col("shard").isin(dense))
        full = {r.shard: r["count"] for r in sizes.orderBy(F.desc("count")).limit(SPLIT_SHARDS).collect()}
        if not full:
            return table, dense
        # At least enough of each to place its splits; the hash draws the same rows again if a task is lost.
        each = SAMPLE_ROWS // len(full)
        share = F.create_map(*(F.lit(x) for k, n in full.items() for x in (k, min(1.0, each / n))))
        draw = F.pmod(F.xxhash64("fp", "shard"), F.lit(1 << 20)) / (1 << 20)
        sample = table.filter(F.col("shard").isin(list(full))).filter(draw < share[F.col("shard")]).toArrow().to_pandas()
        trees = {}
        for shard, n in full.items():
            # Sorted: the tree is the same in whatever order the sample came.
            own = np.sort(sample.fp[sample.shard == shard].to_numpy(np.int64)).view(np.uint64)
            tree = build_tree(own, min(SPLIT_INTO, math.ceil(n / SHARD_ROWS)), max_bits)
            if tree.shards < 2 or tree.largest > SPLIT_SHARE:
                dense.append(shard)
            else:
                trees[shard] = (nxt, tree)
                nxt += tree.shards
        if trees:
            table = written(_split(table, trees, max_bits), "shards")


# Links


def local_components(prints: np.ndarray, max_bits: int) -> np.ndarray:
    """The row of the first member of each row's component, by comparing blocks of rows with all that are left."""
    root = np.full(len(prints), -1, np.int64)
    left = np.arange(len(prints))
    while len(left):
        first, front = left[0], left[:1]
        root[first], left = first, left[1:]
        while len(front) and len(left):
            block, front = front[:64], front[64:]
            close = (np.bitwise_count(prints[block][:, None] ^ prints[left][None, :]) <= max_bits).any(0)
            if close.any():
                found, left = left[close], left[~close]
                root[found] = first
                front = np.concatenate([front, found])
    return root


def _stars(max_bits: int):
    def run(table: pa.Table) -> pa.Table:
        prints = np.sort(table.column("fp").to_numpy())
        root = prints[local_components(prints.view(np.uint64), max_bits)]
        linked = root != prints
        return pa.table({"a": prints[linked], "b": root[linked]})

    return run


def _dense_links(table: DataFrame, max_bits: int) -> DataFrame:
    """Links of shards that no radius divides, without holding one in a task.

    Two fingerprints are within ``max_bits`` exactly if the one reaches some
    value by half as many flips, rounded down, and the other by the rest.  Each
    goes to all values that it reaches; at a value, all are linked to one that
    reaches it by the fewer flips.
    """
    near = max_bits // 2
    signed = lambda bits: (m := sum(1 << b for b in bits)) - (1 << 64 if m >> 63 else 0)
    masks = [F.struct(F.lit(signed(bits)).alias("mask"), F.lit(k <= near).alias("near")) for k in range(max_bits - near + 1) for bits in combinations(range(64), k)]
    reached = table.select("fp").distinct().select("fp", F.explode(F.array(*masks)).alias("m"))
    reached = reached.select("fp", F.col("m.near").alias("near"), F.col("fp").bitwiseXOR(F.col("m.mask")).alias("key"))
    center = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("key"))
    met = reached.select("fp", center.alias("center")).filter("fp <> center")
    return met.select(F.greatest("fp", "center").alias("a"), F.least("fp", "center").alias("b")).distinct()


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)``, ``b < a``: links whose components are those of all pairs of ``prints(fp)`` within ``max_bits``."""
    table, dense = shards(prints, max_bits)
    found = table.filter(~F.col("shard").isin(dense)).groupBy("shard").applyInArrow(_stars(max_bits), "a long, b long")
    if dense:
        found = found.union(_dense_links(table.filter(F.col("shard").isin(dense)), max_bits))
    return found.distinct()


def contract(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` with ``b < a`` as stars: each node but the least of its component, with that least.

    Alternates large stars (every neighbour above a node joins the least one
    around it) and small stars (those below join the least).  The least of a
    node is aggregated before anything is joined to it, so a hub costs no task
    more than its share.  Written tables get tasks by the number of edges.
    """
    edges = written(edges, "edges")
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.countDistinct("a").alias("nodes")).first()
        if seen.n == seen.nodes and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return edges
        most = 2 * seen.n  # nodes, and edges of the next round
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least", most)
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = written(large.distinct(), "large", most)
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "least", most)
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges", most)


# Documents


def _hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _components(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, max_bits: int) -> tuple[DataFrame, int]:
    """``(id, fp, component_id)`` of each document, and the number of documents."""
    own = written(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle_words).alias("fp")), "prints")
    most = own.count()
    prints = written(own.groupBy("fp").agg(F.min("id").alias("first")), "distinct", most)
    stars = contract(links(prints.select("fp"), max_bits))
    inside = stars.union(stars.select(F.col("b").alias("a"), "b").distinct())
    linked = written(inside.join(prints, inside.a == prints.fp).select("fp", "b", "first"), "linked", most)
    least = written(linked.groupBy("b").agg(F.min("first").alias("least")), "components", most)
    of = written(
        prints.join(linked.join(least, "b").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")),
        "members",
        most,
    )
    return own.join(of, "fp"), most


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id that is reachable over links of at most
    ``max_bits`` differing bits, the document's own included.  A null or empty
    text has fingerprint zero, which links like any other.  Repeated rows yield
    a row each.  A null id never names a component unless all ids of it are
    null.  Other columns are left out; an empty table gives an empty result.
    """
    found, _ = _components(docs, id_col, text_col, shingle_words, max_bits)
    return found.select(F.col("id").alias(id_col), _hexed(F.col("fp")).alias("fingerprint"), "component_id")


def _marked(ids: DataFrame, id_col: str) -> Column:
    """True for each id of ``ids``, and for a few others that share a bucket with one.

    The marks have a fixed size, however many ids there are.
    """
    buckets = lambda c: F.xxhash64(c).bitwiseAND(F.lit(MARKS - 1)).cast("int")
    marks = np.zeros(MARKS, bool)
    marks[ids.select(buckets(F.col(id_col)).alias("b")).distinct().toArrow().column("b").to_numpy()] = True
    sent = ids.sparkSession.sparkContext.broadcast(np.packbits(marks))

    @F.arrow_udf("boolean")
    def run(at: pa.Array) -> pa.Array:
        where = at.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[where >> 3] >> (7 - (where & 7)) & 1).astype(bool))

    return run(buckets(F.col(id_col)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without copies: of each component, the one with the smallest id stays.

    All columns are kept.  A row stays if its component is named after its id;
    of several such rows with one id, one stays.  So an id that repeats with
    different texts leaves one row of each of their components.  Rows without
    an id cannot be told apart and all stay.  Null and empty texts are copies of
    each other; texts of any length are read whole; an empty table gives an
    empty one.  Texts stay where they lie unless their id's bucket has an id
    that may go; only those are joined exactly.
    """
    found, most = _components(docs, id_col, text_col, SHINGLE_WORDS, MAX_BITS)
    found = found.select(F.col("id").alias(id_col), F.col("fp").alias("_fp"), "component_id").filter(F.col(id_col).isNotNull())
    own = found.groupBy(id_col).agg(F.max(F.col("component_id") == F.col(id_col)).alias("names"), F.count("*").alias("rows"))
    own = written(own.filter(~F.col("names") | (F.col("rows") > 1)), "verdicts", most)
    repeated = own.filter("names").select(id_col)
    doubtful = _marked(own, id_col)
    kept = docs.filter(~doubtful).unionByName(docs.filter(doubtful).join(own.select(id_col), id_col, "left_anti").select(docs.columns))
    if not repeated.isEmpty():
        # Which of an id's rows: those whose fingerprint belongs to the component of that name.
        right = written(found.filter(F.col("component_id") == F.col(id_col)).join(repeated, id_col, "left_semi").select(id_col, "_fp").distinct(), "right", most)
        again = docs.filter(doubtful).join(repeated, id_col, "left_semi").withColumn("_fp", fingerprint_column(F.col(text_col), SHINGLE_WORDS))
        again = again.join(right, [id_col, "_fp"], "left_semi").dropDuplicates([id_col])
        kept = kept.unionByName(again.select(docs.columns))
    return kept
