"""Scores of a smoothed bigram model, by a weighted automaton with failure arcs.

Every word is a state, and so is the end of a text, where texts begin; the root
is one more.  An arc leads from a state along a word to that word's state; its
weight is the discounted bigram's log10 probability.  Where a state has no arc
for a word, its failure arc leads to the root, which costs the state's backoff
weight, and the root has an arc for every word.  A text is read from left to
right, carrying the state and summing weights.

Texts are cut into words once and kept as blocks of some million tokens.  A
block sends its distinct words and bigrams, sorted by hash, to the parts of the
model, each of which holds a range of hashes; a part adds the counts of all
blocks and answers in the order in which it was asked, so that answers need no
keys.  Each bigram of the training texts is answered with a mark to one block
alone, which adds it to its state.  With the backoff weights of its states, a
block has the part of the automaton that its texts can reach, and runs them
through it.  Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcheck.llm.words import mixed, pieces, text_hashes
from veilcheck.session import written

#: Every bigram of the training texts has an arc; discounting smooths those that occur once.
MIN_ARC_COUNT = 1
DISCOUNT = 0.75
#: One of so many parts, by crc32 of the id, is held out.
FOLDS, HELD_OUT = 7, 2
#: Tokens of the texts for each part of the automaton, which bounds the part's entries.
PART_ENTRIES = 1 << 24
#: There are as many parts at least.
LEAST_PARTS = 1024
#: Tokens that a task gathers before it hands them on as a block.
COUNT_AT_ONCE = 1 << 22
#: The end of a text, which is also the state before its first word.
END = b""

#: Tokens of a text that are read together with others; a part of a text begins in the state before it.
SEGMENT = 512

_WORDS, _PAIRS, _BACKOFF = 0, 1, 2
_ASKED = "p int, block long, kind int, n int, keys binary, counts binary"
_ANSWERED = "block long, p int, kind int, n int, width int, found binary, n_new long"


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in training; a null id does."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def arc_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One hash of a state and a word."""
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + words)


def packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, kind: type | str, n: int) -> np.ndarray:
    """The numbers that ``packed`` took."""
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind)[:, 0]


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, packed as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes, n: int) -> np.ndarray:
    """The keys that ``packed_keys`` took."""
    return np.cumsum(unpacked(raw, np.uint64, n), dtype=np.uint64)


def _narrow(values: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _cuts(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The parts that hold some of the sorted keys, and where."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    at = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
    for start, end in zip(at, np.append(at[1:], len(keys)), strict=False):
        yield int(part[start]), slice(int(start), int(end))


def _blocks(docs: DataFrame) -> DataFrame:
    """One row per block of ``docs(id, held, text)``: ids, folds, tokens of each text, sorted words, and each token's place among them."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []
        task, made = TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            ids, folds = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
            sizes, hashes = (np.concatenate([x[i] for x in held]) for i in (2, 3))
            held.clear()
            words, tokens = np.unique(hashes, return_inverse=True)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, folds, pa.array(sizes))]
            block, made = (task << 32) + made, made + 1
            plain = [pa.array([x], t) for x, t in ((block, pa.int64()), (len(words), pa.int32()), (len(tokens), pa.int64()), (packed_keys(words), pa.binary()), (packed(tokens.astype(np.int32)), pa.binary()))]
            return pa.record_batch([*plain, *lists], ["block", "n_words", "n_tokens", "words", "tokens", "ids", "folds", "sizes"])

        for batch in batches:
            at = 0
            for some in pieces(batch.column(2)):
                hashes, starts = text_hashes(some, end=True)
                held.append((batch.column(0).slice(at, len(some)), batch.column(1).slice(at, len(some)), np.diff(starts), hashes))
                at += len(some)
                if sum(len(x[3]) for x in held) >= COUNT_AT_ONCE:
                    yield flush()
        if held:
            yield flush()

    names = f"block long, n_words int, n_tokens long, words binary, tokens binary, ids array<{kind}>, folds array<boolean>, sizes array<long>"
    return docs.select("id", "held", "text").mapInArrow(run, names)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block, and of each token the places of the one before it and of itself."""
    words, tokens = unpacked_keys(row["words"], row["n_words"]), unpacked(row["tokens"], np.int32, row["n_tokens"])
    return words, np.roll(tokens, 1), tokens  # before a text's first token is the end of the text before, or of the last


def _asked(blocks: DataFrame, parts: int) -> DataFrame:
    """What each block asks of each part: sorted keys, and how often the block's training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("block", "n_words", "n_tokens", "words", "tokens")}
                words, before, tokens = _opened(row)
                folds, sizes = (batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in ("folds", "sizes"))
                learnt = np.repeat(~folds.astype(bool), sizes)
                keys, at = np.unique(arc_keys(words[before], words[tokens]), return_inverse=True)
                rows = []
                for kind, mine, places in ((_WORDS, words, tokens), (_PAIRS, keys, at)):
                    counts = np.bincount(places[learnt], minlength=len(mine)).astype(np.uint32)
                    rows += [(p, row["block"], kind, cut.stop - cut.start, packed_keys(mine[cut]), packed(counts[cut])) for p, cut in _cuts(mine, parts)]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["p", "block", "kind", "n", "keys", "counts"])

    return blocks.mapInArrow(run, _ASKED)


def _answered(asked: DataFrame) -> DataFrame:
    """The counts over all blocks, in the order asked, doubled, plus one for the block that is to add a bigram to its state."""

    def run(part: pa.Table) -> pa.Table:
        rows, asking = [], part.to_pylist()
        for kind in (_WORDS, _PAIRS):
            mine = [r for r in asking if r["kind"] == kind]
            if not mine:
                continue
            keys, at = np.unique(np.concatenate([unpacked_keys(r["keys"], r["n"]) for r in mine]), return_inverse=True)
            counts = np.concatenate([unpacked(r["counts"], np.uint32, r["n"]) for r in mine])
            total = np.zeros(len(keys), np.uint64)
            np.add.at(total, at, counts.astype(np.uint64))
            learnt = np.flatnonzero(counts > 0)
            _, first = np.unique(at[learnt], return_index=True)
            marked = np.zeros(len(at), np.uint64)
            marked[learnt[first]] = 1
            least = np.uint64(MIN_ARC_COUNT if kind == _PAIRS else 1)
            found = np.where(total >= least, total, 0).astype(np.uint64)[at] * np.uint64(2)
            found += marked * (found > 0)
            ends = np.cumsum([r["n"] for r in mine])
            for j, (r, end) in enumerate(zip(mine, ends, strict=True)):
                values = _narrow(found[end - r["n"] : end])
                rows.append((r["block"], r["p"], kind, r["n"], values.itemsize, packed(values), int((total > 0).sum()) if not j and kind == _WORDS else 0))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "p", "kind", "n", "width", "found", "n_new"])

    return asked.groupBy("p").applyInArrow(run, _ANSWERED)


def _counts(answers: list[dict], kind: int) -> np.ndarray:
    """The answers of all parts to one block, in the order of its keys."""
    mine = sorted((r for r in answers if r["kind"] == kind), key=lambda r: r["p"])
    return np.concatenate([unpacked(r["found"], f"u{r['width']}", r["n"]).astype(np.uint64) for r in mine])


@dataclass
class Automaton:
    """States are numbers of words; the root is the number after them.  Arcs are sorted by the hash of state and word."""

    words: np.ndarray
    arcs: np.ndarray
    arc_weights: np.ndarray
    failure_weights: np.ndarray
    root_weights: np.ndarray

    @property
    def root(self) -> int:
        return len(self.words)

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights of reading a word in each state, and the states after it."""
        weights, states, left = np.zeros(len(words)), states.copy(), np.arange(len(words))
        while len(left):
            at_root = states[left] == self.root
            weights[left[at_root]] += self.root_weights[words[left[at_root]]]
            left = left[~at_root]
            if not len(left):
                break
            keys = arc_keys(self.words[states[left]], self.words[words[left]])
            at = np.searchsorted(self.arcs, keys)
            known = np.zeros(len(left), bool)
            inside = at < len(self.arcs)
            known[inside] = self.arcs[at[inside]] == keys[inside]
            weights[left[known]] += self.arc_weights[at[known]]
            left = left[~known]
            # No arc: on to the root by the failure arc.
            weights[left] += self.failure_weights[states[left]]
            states[left] = self.root
        return weights, words

    def read(self, tokens: np.ndarray, starts: np.ndarray, begin: int) -> np.ndarray:
        """The weight of each text, read from left to right from the state ``begin``.

        Texts are read side by side, long ones in parts: after a token the state
        is that of the token, whatever came before.
        """
        sizes = np.diff(np.append(starts, len(tokens)))
        parts = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(starts)), parts)
        offset = (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        first = starts[text] + offset
        length = np.minimum(sizes[text] - offset, SEGMENT)
        states = np.where(offset > 0, tokens[first - 1], begin)
        order = np.argsort(-length, kind="stable")
        first, length, states, total = first[order], length[order], states[order], np.zeros(len(order))
        for i in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -i, side="left"))  # those longer than i
            weights, states[:active] = self.step(states[:active], tokens[first[:active] + i])
            total[:active] += weights
        return np.bincount(text[order], total, len(starts))


def _model(row: dict, replies: list[dict], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: words, tokens, counts of words, root probabilities, hashes of its bigrams, the first place of each, and their answers."""
    words, before, tokens = _opened(row)
    counts, pairs = _counts(replies, _WORDS) >> np.uint64(1), _counts(replies, _PAIRS)
    keys, first = np.unique(arc_keys(words[before], words[tokens]), return_index=True)
    return words, tokens, counts, (counts + 1.0) / (size + 1), keys, first, pairs


_COLUMNS = ("block", "n_words", "n_tokens", "words", "tokens")


def _states(blocks: DataFrame, answers: DataFrame, size: int, parts: int) -> DataFrame:
    """What each block adds to states (``total`` of a state's count, ``kept`` by its arcs, ``low`` at the root), and whose backoff weights it needs."""

    def run(block: pa.Table, answered: pa.Table) -> pa.Table:
        row = {name: block.column(name)[0].as_py() for name in _COLUMNS}
        words, tokens, counts, root, _, first, pairs = _model(row, answered.to_pylist(), size)
        before, total = np.roll(tokens, 1), counts.astype(np.float64)
        mine = (pairs & np.uint64(1)) > 0
        n, of, to = (pairs >> np.uint64(1)).astype(np.float64)[mine], before[first[mine]], tokens[first[mine]]
        low, kept = np.bincount(of, root[to], len(words)), np.bincount(of, n - DISCOUNT, len(words))
        out = []
        for places, asked in ((np.flatnonzero(kept > 0), False), (np.arange(len(words)), True)):
            for p, cut in _cuts(words[places], parts):
                values = {} if asked else {name: packed(x[places[cut]]) for name, x in (("total", total), ("kept", kept), ("low", low))}
                out.append({"p": p, "block": row["block"], "n": cut.stop - cut.start, "keys": packed_keys(words[places][cut]), "missing": asked} | values)
        return pa.Table.from_pylist(out, pa.schema([("p", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("total", pa.binary()), ("kept", pa.binary()), ("low", pa.binary()), ("missing", pa.bool_())]))

    return blocks.select(*_COLUMNS).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "p int, block long, n int, keys binary, total binary, kept binary, low binary, missing boolean")


def _failures(asked: DataFrame) -> DataFrame:
    """The failure weights that blocks need, in the order asked; zero for a state without arcs."""

    def run(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        given, needed = ([r for r in rows if r["missing"] is x] for x in (False, True))
        known, failure = np.zeros(0, np.uint64), np.zeros(0)
        if given and needed:
            known, at = np.unique(np.concatenate([unpacked_keys(r["keys"], r["n"]) for r in given]), return_inverse=True)
            total, kept, low = (np.concatenate([unpacked(r[x], np.float64, r["n"]) for r in given]) for x in ("total", "kept", "low"))
            whole = np.zeros(len(known))
            whole[at] = total
            failure = np.log10((1 - np.bincount(at, kept) / whole) / np.maximum(1 - np.bincount(at, low), 1e-12))
        out = []
        for r in needed:
            keys = unpacked_keys(r["keys"], r["n"])
            values = np.zeros(len(keys))
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                values = np.where(known[at] == keys, failure[at], 0.0)
            out.append({"block": r["block"], "p": r["p"], "n": r["n"], "weights": packed(values)})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("p", pa.int32()), ("n", pa.int32()), ("weights", pa.binary())]))

    return asked.groupBy("p").applyInArrow(run, "block long, p int, n int, weights binary")


def _read(blocks: DataFrame, answers: DataFrame, size: int) -> DataFrame:
    """A row per text: each block builds its part of the automaton and reads its texts."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(block: pa.Table, answered: pa.Table) -> pa.Table:
        row, replies = {name: block.column(name)[0].as_py() for name in _COLUMNS}, answered.to_pylist()
        words, tokens, counts, root, keys, first, pairs = _model(row, replies, size)
        n = (pairs >> np.uint64(1)).astype(np.float64)
        some = n > 0
        arcs = np.log10((n[some] - DISCOUNT) / counts[np.roll(tokens, 1)[first[some]]])
        model = Automaton(words, keys[some], arcs, _backoff(replies), np.log10(root))
        column = lambda name: block.column(name).combine_chunks()[0].values
        sizes = column("sizes").to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        # Every text ends with the end token, and begins in its state.
        score = model.read(tokens.astype(np.int64), starts, int(tokens[-1]))
        known, base = (np.add.reduceat(x[tokens], starts) for x in ((counts > 0).astype(np.int64), model.root_weights))
        values = [column("ids"), column("folds"), column("sizes"), pa.array(known), pa.array(base), pa.array(score)]
        return pa.table(values, ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    names = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, names)


def _backoff(answers: list[dict]) -> np.ndarray:
    """The backoff weights of a block's states, in the order of its words."""
    mine = sorted((r for r in answers if r["kind"] == _BACKOFF), key=lambda r: r["p"])
    return np.concatenate([unpacked(r["found"], np.float64, r["n"]) for r in mine])


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_entries: int = PART_ENTRIES) -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model is trained on the documents that are not held out and scores
    all.  A null or empty text is the end token alone.  ``base_score`` is the
    add-one unigram log10 probability, ``score`` the automaton's.  A null id is
    in training.  Repeated rows count and are scored each.  Without training
    rows every token is unknown and has probability one.  Words are told apart
    by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("text"))
    blocks = written(_blocks(rows), "blocks")
    tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first().n
    parts = max(LEAST_PARTS, -(-tokens // part_entries))
    answers = written(_answered(_asked(blocks, parts)), "answers")
    v = answers.agg(F.coalesce(F.sum("n_new"), F.lit(0)).alias("v")).first().v
    learnt = F.aggregate(F.zip_with("folds", "sizes", lambda out, size: F.when(out, F.lit(0)).otherwise(size)), F.lit(0).cast("long"), lambda x, y: x + y)
    n = blocks.agg(F.coalesce(F.sum(learnt), F.lit(0)).alias("n")).first().n
    failures = _failures(written(_states(blocks, answers, n + v, parts), "states"))
    known = answers.select("block", "p", "kind", "n", "width", "found").unionByName(
        failures.select("block", "p", F.lit(_BACKOFF).alias("kind"), "n", F.lit(8).alias("width"), F.col("weights").alias("found"))
    )
    total = _read(blocks, known, n + v)
    return total.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
    )
