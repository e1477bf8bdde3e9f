"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a SimHash of its word shingles.  A document is read in
windows as long as an item; a window's SimHash is looked up in a multi-index of
Hamming blocks, which finds every item fingerprint of that size within the
radius (of ``BLOCKS`` blocks, one differs in at most ``radius // BLOCKS`` bits,
and each item is listed under all values that near).  Candidates are then
compared exactly, by the weighted Jaccard similarity of their shingles, where a
shingle weighs as often as it occurs.

Two bags of n shingles are that similar only if they share 2ns / (1 + s) of
them, eight in nine at 0.8.  A window with fewer shingles of items of its size
matches none of them, so no fingerprint is made for it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcheck.llm.words import bit_rows, majority_bits, pieces, shingle_hashes, text_hashes, word_hashes
from veilcheck.session import written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Similar windows differ in 10 of 64 bits on the average at the least similarity, with a deviation of 3.
RADIUS = 24
BLOCKS = 8
#: A benchmark of more words is searched in several parts, each of which is sent to all tasks.
PART_WORDS = 1_000_000
#: Windows whose fingerprints are made at once, and pairs of a window and an item that are looked at at once.
_AT_ONCE, _PAIRS_AT_ONCE = 2048, 1 << 20
_HIT_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("distance", pa.int32()), ("first_word", pa.int64()), ("words", pa.int64())]))
HITS = "array<struct<item_id:long,similarity:double,distance:int,first_word:long,words:long>>"


def _fingerprints(shingles: np.ndarray) -> np.ndarray:
    """SimHashes of the rows of a matrix of shingle hashes."""
    return majority_bits(bit_rows(shingles).sum(-2, dtype=np.int64), shingles.shape[-1])


def _near(bits: int) -> list[int]:
    """Changes of at most ``bits`` bits to a block."""
    width = 64 // BLOCKS
    return [sum(1 << b for b in flips) for k in range(bits + 1) for flips in combinations(range(width), k)]


@dataclass
class SizeIndex:
    """The items of one size: shingle length and count, ids, fingerprints, weights, and items by block value."""

    shingle: int
    count: int
    ids: list[int | None]
    prints: np.ndarray
    weights: list[Counter]
    blocks: list[list[np.ndarray]]

    def within(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, items and distances of all pairs within the radius, nearest first."""
        found = []
        for block, table in enumerate(self.blocks):
            values = (prints >> np.uint64(block * (64 // BLOCKS))).astype(np.int64) & ((1 << (64 // BLOCKS)) - 1)
            sizes = np.array([len(table[v]) for v in values])
            items = np.concatenate([table[v] for v in values]) if len(values) else np.empty(0, np.int64)
            found.append(np.repeat(np.arange(len(prints)), sizes) * len(self.ids) + items)
        pairs = np.unique(np.concatenate(found))
        windows, items = pairs // len(self.ids), pairs % len(self.ids)
        away = np.bitwise_count(prints[windows] ^ self.prints[items])
        order = np.flatnonzero(away <= radius)
        order = order[np.argsort(away[order], kind="stable")]
        return windows[order], items[order], away[order]


class Benchmark:
    """A part of the benchmark, ready to be looked up; items without words are left out."""

    def __init__(self, items: list[tuple[int | None, str | None]], shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS):
        by_size: dict[int, list] = defaultdict(list)
        for item_id, text in items:
            words = (text or "").encode().lower().split()
            if words:
                shingle = min(shingle_words, len(words))
                by_size[len(words)].append((item_id, shingle, shingle_hashes(word_hashes(words), shingle)))
        self.radius, self.sizes = radius, {}
        #: Of each shingle length: all hashes, and the sizes of the items that hold each.
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, list[list[int]]]] = {}
        holders: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for size, found in by_size.items():
            shingle, prints = found[0][1], np.array([_fingerprints(h) for _, _, h in found])
            blocks = []
            for block in range(BLOCKS):
                values = (prints >> np.uint64(block * (64 // BLOCKS))).astype(np.int64) & ((1 << (64 // BLOCKS)) - 1)
                table: list[list[int]] = [[] for _ in range(1 << (64 // BLOCKS))]
                for item, value in enumerate(values):
                    for flip in _near(radius // BLOCKS):
                        table[int(value) ^ flip].append(item)
                blocks.append([np.array(row, np.int64) for row in table])
            self.sizes[size] = SizeIndex(shingle, size - shingle + 1, [i for i, _, _ in found], prints, [Counter(h.tolist()) for _, _, h in found], blocks)
            for _, _, hashes in found:
                for value in hashes.tolist():
                    holders[shingle][value].add(size)
        for shingle, sizes in holders.items():
            hashes = np.sort(np.array(list(sizes), np.uint64))
            gate = np.zeros(1 << 20, bool)
            gate[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.shingles[shingle] = (hashes, gate, [sorted(sizes[int(h)]) for h in hashes])

    def windows(self, words: np.ndarray, starts: np.ndarray, similarity: float) -> dict[tuple[int, int], np.ndarray]:
        """By text and item size, the starts of all windows that hold enough shingles of items of that size.

        A text shorter than the item is one window.
        """
        found: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        for shingle, (hashes, gate, sizes) in self.shingles.items():
            own = shingle_hashes(words, shingle)
            at = np.flatnonzero(gate[(own & np.uint64(len(gate) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(hashes, own[at]), len(hashes) - 1)
            true = hashes[place] == own[at]
            at, place = at[true], place[true]
            text = np.searchsorted(starts, at, side="right") - 1
            inside = at + shingle <= starts[text + 1]
            for position, where, doc in zip(at[inside].tolist(), place[inside].tolist(), text[inside].tolist(), strict=True):
                for size in sizes[where]:
                    found[doc, size].append(position)
        enough = {}
        for (doc, size), positions in found.items():
            first, count = int(starts[doc]), self.sizes[size].count
            last = int(starts[doc + 1]) - size
            own = min(count, max(0, int(starts[doc + 1]) - first - self.sizes[size].shingle + 1))
            need = max(1, math.ceil(similarity * (own + count) / (1 + similarity) - 1e-9))
            held = np.array(positions)
            if last < first:
                if len(held) >= need:
                    enough[doc, size] = np.array([first])
            elif len(held) >= need:
                # Windows that begin at or before a shingle and end at or after the one that makes it enough.
                low, high = held[need - 1 :] - count + 1, held[: len(held) - need + 1]
                close = low <= high
                runs = [np.arange(max(first, a), min(last, b) + 1) for a, b in zip(low[close].tolist(), high[close].tolist(), strict=True)]
                if runs and len(merged := np.unique(np.concatenate(runs))):
                    enough[doc, size] = merged
        return enough

    def search(self, texts: list[bytes | None], similarity: float) -> list[list[dict]]:
        """Of each text, the items that a window of it matches: the nearest such window of each."""
        words, starts = text_hashes(texts)
        hits: list[list[dict]] = [[] for _ in texts]
        for (doc, size), firsts in sorted(self.windows(words, starts, similarity).items()):
            index = self.sizes[size]
            own = shingle_hashes(words[starts[doc] : starts[doc + 1]], index.shingle)
            firsts, count = firsts - starts[doc], min(index.count, len(own))
            best: dict[int, tuple] = {}
            at_once = max(1, min(_AT_ONCE, _PAIRS_AT_ONCE // len(index.ids)))
            for some in range(0, len(firsts), at_once):
                part = firsts[some : some + at_once]
                prints = _fingerprints(own[part[:, None] + np.arange(count)])
                for window, item, away in zip(*(x.tolist() for x in index.within(prints, self.radius)), strict=True):
                    if item in best and best[item][0] <= away:
                        continue
                    shingles = Counter(own[part[window] : part[window] + count].tolist())
                    both = sum((shingles & index.weights[item]).values())
                    alike = both / (count + index.count - both)
                    if alike >= similarity:
                        best[item] = (away, alike, int(part[window]))
            hits[doc] += [
                {"item_id": index.ids[item], "similarity": alike, "distance": away, "first_word": first, "words": min(size, int(starts[doc + 1] - starts[doc]))}
                for item, (away, alike, first) in sorted(best.items())
            ]
        return hits


def _parts(benchmark: DataFrame, id_col: str, text_col: str, part_words: int) -> list[DataFrame]:
    """The benchmark in parts of about ``part_words`` words."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    words = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    parts = max(1, -(-words // part_words))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) for part in range(parts)] if parts > 1 else [items]


def _matcher(sent, shingle_words: int, radius: int, similarity: float):
    """The search of one part of the benchmark, which is made ready once per task."""
    ready: list[Benchmark] = []

    @F.arrow_udf(HITS)
    def run(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Benchmark(sent.value, shingle_words, radius))
        found = [hit for some in pieces(texts) for hit in ready[0].search(some, similarity)]
        return pa.array(found, _HIT_TYPE)

    return run


def hits_columns(
    text: Column, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", similarity: float = SIMILARITY,
    shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, part_words: int = PART_WORDS,
) -> Iterator[Column]:
    """For each part of the benchmark, one after the other, an array of its items that a text holds."""
    for part in _parts(benchmark, id_col, text_col, part_words):
        rows = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        sent = benchmark.sparkSession.sparkContext.broadcast(rows)
        yield _matcher(sent, shingle_words, radius, similarity)(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``(doc_id, item_id, similarity, distance, first_word, words)``: each document with each benchmark item that it holds.

    Of several matching windows the nearest, first one is given.  A null or
    empty text and an item without words match nothing; a repeated row yields
    its rows again; items that repeat an id yield a row each.  Either table may
    be empty.  ``benchmark`` has ``item_id`` and ``text``.
    """
    found = [docs.select(F.col(doc_col).alias("doc"), F.explode(hits).alias("hit")) for hits in hits_columns(F.col(text_col), benchmark, **how)]
    return reduce(DataFrame.unionAll, found).select(F.col("doc").alias(doc_col), "hit.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    Null and empty texts hold none, texts of any length are read whole, repeated
    rows are judged each, and an empty benchmark or table leaves things as they
    are.  No row is moved.  A benchmark of several parts is searched part by
    part, with what is left written in between.
    """
    columns = docs.columns
    for i, hits in enumerate(hits_columns(F.col(text_col), benchmark, **how)):
        docs = (written(docs, "clean") if i else docs).filter(F.size(hits) == 0).select(columns)
    return docs
