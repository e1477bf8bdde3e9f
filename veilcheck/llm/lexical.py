"""Ranked lexical search: the best documents of every item, exactly, by a dual tree.

Items and documents are sparse vectors over the items' terms: an item has the
weight of each term times its count, a document the term's saturated and
length-normalised frequency.  A score is their inner product in integers.

Both sides are hierarchies whose nodes hold, term by term, the greatest
coordinate below them.  The inner product of two nodes therefore bounds every
score of an item below the one and a document below the other; where it stays
under the weakest of the items' k-th best scores so far, the pair of nodes goes
as a whole.  Other pairs are opened on both sides, down to single items and
leaves of eight documents, whose scores are computed.

The items, of bounded size, go to all tasks (a larger table goes in parts, one
after the other).  Texts are read once per part; what is kept of them are their
vectors over the items' terms.  A first search over a few batches of these
gives every item a k-th score to start with; it prunes, and decides nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilcheck.llm.words import pieces
from veilcheck.session import written

BEST = 20
#: Bytes of items that go to all tasks at once.
PART_BYTES = 1 << 24
#: Documents and terms after which a batch of vectors is full; a text beyond is a batch of its own.
BATCH_DOCS, BATCH_TERMS = 2048, 1 << 17
#: Documents of a leaf, and children of other nodes, on both sides.
LEAF_DOCS, FANOUT = 8, 8
#: Batches that the first search looks at.
FIRST_BATCHES = 4
#: Parts into which an item's candidates are dealt before they are merged.
MERGE_PARTS = 64
_PIECE = 1 << 20
#: Every ASCII character but letters and digits parts terms; A-Z are lowered.
_TERM_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_NO_ID = np.iinfo(np.int64).min


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, some hundred thousand at a time."""
    plain, start = (text or b"").translate(_TERM_BYTES), 0
    while start < len(plain):
        end = plain.find(b" ", start + _PIECE) if start + _PIECE < len(plain) else -1
        yield plain[start : end if end >= 0 else None].split()
        start = end if end >= 0 else len(plain)


def weight(n_docs: int, n_with: int) -> int:
    """A term's weight: the scaled logarithm of its rarity."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n_with + 1)))


# Items


@dataclass
class Items:
    """The items of a part: their ids, how often each row occurs, and their terms as numbers from 1 on."""

    ids: list
    copies: list[int]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    counts: list[np.ndarray]


def read_items(rows: list) -> Items:
    """Items of rows ``(id, text, copies)``."""
    items = Items([], [], {}, [], [])
    for row in rows:
        words = [w for some in terms_of(row.text and row.text.encode()) for w in some]
        if words:
            numbers = [items.vocabulary.setdefault(w, len(items.vocabulary) + 1) for w in words]
            terms, counts = np.unique(np.array(numbers, np.int64), return_counts=True)
            for held, value in ((items.ids, row.id), (items.copies, row.copies), (items.terms, terms), (items.counts, counts)):
                held.append(value)
    return items


@dataclass
class ItemNode:
    """A run of items, and the greatest coordinate of each term among them."""

    first: int
    last: int
    terms: np.ndarray
    values: np.ndarray
    children: list[ItemNode] = field(default_factory=list)


def _merged(nodes: list[ItemNode]) -> ItemNode:
    terms, at = np.unique(np.concatenate([n.terms for n in nodes]), return_inverse=True)
    values = np.zeros(len(terms), np.int64)
    np.maximum.at(values, at, np.concatenate([n.values for n in nodes]))
    return ItemNode(nodes[0].first, nodes[-1].last, terms, values, nodes)


def item_tree(items: Items, weights: np.ndarray) -> tuple[np.ndarray, ItemNode]:
    """The order of items in which neighbours share their heaviest terms, and the hierarchy over it."""
    heaviest = [tuple(sorted(zip((-weights[t]).tolist(), t.tolist(), strict=True))[:8]) for t in items.terms]
    order = np.array(sorted(range(len(heaviest)), key=heaviest.__getitem__), np.int64)
    level = [ItemNode(i, i + 1, items.terms[at], items.counts[at] * weights[items.terms[at]]) for i, at in enumerate(order)]
    while len(level) > 1:
        level = [_merged(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
    return order, level[0]


# Documents


_VECTORS = "n_docs long, n_terms long, ids array<long>, lengths array<long>, sizes array<long>, terms array<int>, counts array<int>"


def _vectors(docs: DataFrame, items: Broadcast) -> DataFrame:
    """Batches of the vectors of ``docs(id, text)`` over the items' terms, and how many documents and terms a batch has in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = items.value.vocabulary.get
        ids: list[int] = []
        lengths: list[int] = []
        found: list[np.ndarray] = []
        owner: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            sizes = [len(x) for x in found]
            doc = np.repeat(np.array(owner, np.int64), sizes)
            keys, counts = np.unique((doc << 32) + np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            own = np.bincount(keys >> 32, minlength=len(ids))
            some = np.flatnonzero(own)
            known = np.array(lengths, np.int64)
            lists = [np.array(ids, np.int64)[some], known[some], own[some], (keys & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int32)]
            plain = [pa.array([int((known > 0).sum())]), pa.array([int(known.sum())])]
            whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists]
            return pa.record_batch([*plain, *whole], ["n_docs", "n_terms", "ids", "lengths", "sizes", "terms", "counts"])

        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for texts in pieces(batch.column(1)):
                for text in texts:
                    length = 0
                    for words in terms_of(text):
                        length += len(words)
                        some = list(filter(None, map(number, words)))
                        if some:
                            found.append(np.array(some, np.int64))
                            owner.append(len(ids))
                            held += len(some)
                    ids.append(_NO_ID if keys[at] is None else keys[at])
                    lengths.append(length)
                    at += 1
                    if len(ids) >= BATCH_DOCS or held >= BATCH_TERMS:
                        yield flush()
                        for x in (ids, lengths, found, owner):
                            x.clear()
                        held = 0
        if ids:
            yield flush()

    return docs.select("id", "text").mapInArrow(run, _VECTORS)


class Batch:
    """The hierarchy over a batch of documents: the heaviest common terms lie side by side."""

    def __init__(self, row: dict[str, np.ndarray], n_docs: int, n_terms: int, weights: np.ndarray):
        sizes, terms, counts = row["sizes"], row["terms"].astype(np.int64), row["counts"].astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        if 25 * int(row["lengths"].max()) * n_docs < 1 << 63:
            norm = 75 + (25 * row["lengths"] * n_docs) // n_terms
        else:
            norm = 75 + np.array([(25 * int(n) * n_docs) // n_terms for n in row["lengths"]], np.int64)
        values = (1_000_000_000 * counts) // (1000 * counts + 12 * norm[doc])
        # Documents in the order of their heaviest term, then of the next.
        heavy = np.lexsort((terms, -weights[terms], doc))
        starts = np.cumsum(sizes) - sizes
        first = terms[heavy[starts]]
        second = np.where(sizes > 1, terms[heavy[np.minimum(starts + 1, len(terms) - 1)]], 0)
        order = np.lexsort((row["ids"], -weights[second], second, first, -weights[first]))
        take = np.repeat(starts[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(len(terms))
        self.ids, self.values = row["ids"][order], values[take]
        self.bounds = np.concatenate([[0], np.cumsum(sizes[order])])
        self.known, self.columns = np.unique(terms[take], return_inverse=True)
        leaf = np.repeat(np.arange(len(order)) // LEAF_DOCS, sizes[order])
        lowest = np.zeros((-(-len(order) // LEAF_DOCS), len(self.known)), np.int64)
        np.maximum.at(lowest, (leaf, self.columns), self.values)
        self.levels = [lowest]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FANOUT), axis=0))

    def coordinates(self, node: ItemNode) -> tuple[np.ndarray, np.ndarray]:
        """Of an item node's terms, those that the batch has: their columns, and the node's values."""
        at = np.minimum(np.searchsorted(self.known, node.terms), len(self.known) - 1)
        here = self.known[at] == node.terms
        return at[here], node.values[here]

    def scores(self, leaves: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the documents of some leaves for an item."""
        weights = np.zeros(len(self.known), np.int64)
        weights[columns] = values
        docs = (leaves[:, None] * LEAF_DOCS + np.arange(LEAF_DOCS)).ravel()
        docs = docs[docs < len(self.ids)]
        sizes = self.bounds[docs + 1] - self.bounds[docs]
        at = np.repeat(self.bounds[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.ids[docs], np.add.reduceat(self.values[at] * weights[self.columns[at]], np.cumsum(sizes) - sizes)


class Best:
    """The best documents of every item so far, and the scores below which nothing is wanted."""

    def __init__(self, least: np.ndarray, best: int):
        self.least, self.best = least.copy(), best
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * len(least)
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * len(least)
        self.pairs = 0

    def offer(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        self.pairs += len(ids)
        wanted = scores >= max(1, self.least[item])
        if wanted.any():
            ids, scores = np.concatenate([self.ids[item], ids[wanted]]), np.concatenate([self.scores[item], scores[wanted]])
            order = np.lexsort((ids, -scores))[: self.best]
            self.ids[item], self.scores[item] = ids[order], scores[order]
            if len(order) == self.best:
                self.least[item] = max(self.least[item], self.scores[item][-1])

    def hopeless(self, item: int, bounds: np.ndarray, least_ids: np.ndarray) -> np.ndarray:
        """Which documents cannot enter: a lower score, or an equal one with a later id than the last."""
        full = len(self.ids[item]) == self.best and self.scores[item][-1] == self.least[item]
        tie = (bounds == self.least[item]) & (least_ids > self.ids[item][-1]) if full else False
        return (bounds < max(1, self.least[item])) | tie


def search(batch: Batch, root: ItemNode, best: Best) -> None:
    """Opens pairs of an item node and a document node whose bound reaches the items' weakest k-th score."""
    leaf_ids = np.minimum.reduceat(batch.ids, np.arange(0, len(batch.ids), LEAF_DOCS))
    ids = [leaf_ids]
    for _ in batch.levels[1:]:
        ids.append(np.minimum.reduceat(ids[-1], np.arange(0, len(ids[-1]), FANOUT)))

    def open_pairs(node: ItemNode, level: int, nodes: np.ndarray) -> None:
        columns, values = batch.coordinates(node)
        bounds = batch.levels[level][nodes[:, None], columns] @ values
        if node.children:
            nodes = nodes[bounds >= max(1, int(best.least[node.first : node.last].min()))]
        else:
            nodes = nodes[~best.hopeless(node.first, bounds, ids[level][nodes])]
        if not len(nodes):
            return
        if not node.children and not level:
            best.offer(node.first, *batch.scores(nodes, columns, values))
            return
        if level:
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            nodes, level = nodes[nodes < len(batch.levels[level - 1])], level - 1
        for child in node.children or [node]:
            open_pairs(child, level, nodes)

    top = len(batch.levels) - 1
    open_pairs(root, top, np.arange(len(batch.levels[top])))


_CANDIDATES = "item int, doc_id long, score long, part int"


def _searched(vectors: DataFrame, shared: Broadcast, best: int) -> DataFrame:
    """Each task's best documents of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, order, weights, n_docs, n_terms, least = shared.value
        held = Best(least, best)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in ("ids", "lengths", "sizes", "terms", "counts")}
                if len(row["ids"]):
                    search(Batch(row, n_docs, n_terms, weights), root, held)
        sizes = [len(x) for x in held.ids]
        columns = [np.repeat(order, sizes).astype(np.int32), np.concatenate(held.ids), np.concatenate(held.scores)]
        part = np.full(sum(sizes), TaskContext.get().partitionId() % MERGE_PARTS, np.int32)
        yield pa.record_batch([pa.array(x) for x in (*columns, part)], ["item", "doc_id", "score", "part"])

    return vectors.select("ids", "lengths", "sizes", "terms", "counts").mapInArrow(run, _CANDIDATES)


def _ranked(candidates: DataFrame, best: int) -> DataFrame:
    """The best of all tasks; an item's candidates are merged in parts first."""
    order = [F.desc("score"), F.asc("doc_id")]
    for keys in (["item", "part"], ["item"]):
        candidates = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= best)
    return candidates


def _search_part(docs: DataFrame, items: Items, best: int) -> DataFrame:
    """``(item, doc_id, score, rank)`` for the items of one part."""
    spark = docs.sparkSession
    vectors = written(_vectors(docs, spark.sparkContext.broadcast(items)), "vectors")
    totals = vectors.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    # As many rows as the items have terms.
    seen = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    n_with = np.zeros(len(items.vocabulary) + 1, np.int64)
    n_with[seen.column("term").to_numpy()] = seen.column("count").to_numpy()
    weights = np.array([0, *(weight(totals.n, int(n)) for n in n_with[1:])], np.int64)
    order, root = item_tree(items, weights)
    least = np.zeros(len(order), np.int64)

    def shared() -> Broadcast:
        return spark.sparkContext.broadcast((root, order, weights, totals.n, max(1, totals.l), least))

    first = _ranked(_searched(vectors.filter(F.size("ids") > 0).limit(FIRST_BATCHES), shared(), best), best).filter(F.col("rank") == best)
    place = np.argsort(order)
    for row in first.select("item", "score").collect():
        least[place[row.item]] = row.score
    return _ranked(_searched(vectors, shared(), best), best)


def search_items(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The ``best`` highest-scoring documents of each item: item id, ``rank``, document id, ``score``.

    Terms are runs of letters, digits and characters beyond ASCII; only A-Z are
    lowered.  Null and empty texts have no term: such a document takes no part,
    such an item has no rows.  Documents without a term of the item score zero
    and are not listed.  Equal scores go by ascending id, a null id first; ids
    of documents are whole numbers.  A repeated document is listed again, a
    repeated item (same id and text) gets its rows again; items that share only
    their id are ranked apart.  A text of any length is read in pieces; its
    vector, like that of every document, has as many entries as it has
    different terms of the items.  Empty tables give no rows, and other columns
    take no part.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL")
    asked = written(asked.groupBy("id", "text").agg(F.count("*").alias("copies")), "items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-size // part_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kind, found = asked.schema["id"].dataType.simpleString(), []
    for part in range(parts):
        own = read_items(asked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect())
        if own.ids:
            names = spark.createDataFrame([(i, id_, n) for i, (id_, n) in enumerate(zip(own.ids, own.copies, strict=True))], f"item int, item_id {kind}, copies long")
            found.append(_search_part(rows, own, best).join(F.broadcast(names), "item"))
    if not found:
        return _named(spark, asked, docs, item_col, id_col)
    ranked = reduce(DataFrame.unionAll, [f.select("item_id", "rank", "doc_id", "score", "copies") for f in found])
    doc_id = F.when(F.col("doc_id") != int(_NO_ID), F.col("doc_id"))
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        F.col("item_id").alias(item_col), "rank", doc_id.alias(id_col), "score"
    )


def _named(spark: SparkSession, asked: DataFrame, docs: DataFrame, item_col: str, id_col: str) -> DataFrame:
    """No rows, with the columns of a result."""
    kind = asked.schema["id"].dataType.simpleString()
    return spark.createDataFrame([], f"`{item_col}` {kind}, rank int, `{id_col}` long, score long")


_CUT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_CUT} AS terms FROM documents WHERE text IS NOT NULL),
     c AS (SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM d WHERE len(terms) > 0),
     o AS (SELECT doc_id, any_value(len(terms)) AS n, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d) GROUP BY doc_id, term),
     i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_CUT}) AS term FROM benchmark) GROUP BY ALL),
     w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM o, c GROUP BY term),
     s AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
           FROM i JOIN o USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {BEST}
"""
