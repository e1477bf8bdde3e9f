"""Greedy word-piece counts by a linear longest-match automaton.

A word, with a blank before it, is cut greedily into the longest entries of a
vocabulary.  The vocabulary is a trie over bytes; each node has a failure link
to the node where matching goes on once its longest entries are cut off, and
the number of entries cut off on that way.  One pass over the bytes of a word
adds those numbers up, so no piece is ever built and no byte is read twice.
"""

from __future__ import annotations

import base64
from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcheck.llm.words import pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary is sent to all tasks; a larger one is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Words whose counts a task remembers at once, and bytes of a word that is remembered; a longer one is read each time.
KNOWN_WORDS, KNOWN_BYTES = 1 << 19, 64
_NOWHERE = -1


class Automaton:
    """Trie with failure links; ``cut[v]`` entries are cut off on the way from ``v`` to ``fail[v]``."""

    def __init__(self, vocabulary: list[bytes]):
        self.children: dict[int, int] = {}
        entry, first = [False], [[]]
        for token in vocabulary:
            node = 0
            for byte in token:
                child = self.children.get(node << 8 | byte)
                if child is None:
                    child = self.children[node << 8 | byte] = len(entry)
                    entry.append(False)
                    first.append([])
                    first[node].append((byte, child))
                node = child
            entry[node] = node > 0
        self.fail, self.cut = [_NOWHERE] * len(entry), [0] * len(entry)
        todo = deque([0])
        while todo:
            parent = todo.popleft()
            for byte, node in first[parent]:
                todo.append(node)
                if entry[node]:
                    self.fail[node], self.cut[node] = 0, 1
                else:
                    self.fail[node], self.cut[node] = self._after(parent, byte)

    def _after(self, node: int, byte: int) -> tuple[int, int]:
        """Where ``byte`` leads once entries are cut off before it, and how many are."""
        cut = 0
        while node != _NOWHERE:
            cut, node = cut + self.cut[node], self.fail[node]
            if node != _NOWHERE and (child := self.children.get(node << 8 | byte)) is not None:
                return child, cut
        return _NOWHERE, 0

    def count(self, word: bytes) -> int:
        """Pieces of a word; one (unknown) if it cannot be cut up."""
        children, node, total = self.children, 0, 0
        for byte in word:
            child = children.get(node << 8 | byte)
            while child is None:
                total, node = total + self.cut[node], self.fail[node]
                if node == _NOWHERE:
                    return 1
                child = children.get(node << 8 | byte)
            node = child
        while node:
            total, node = total + self.cut[node], self.fail[node]
            if node == _NOWHERE:
                return 1
        return total


class Counts(dict):
    """Counts of the words seen last, made by the automaton when asked for."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(word) > KNOWN_BYTES:
            return self.automaton.count(b" " + word)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = self.automaton.count(b" " + word)
        return found


#: The last vocabulary of a Python worker, made ready; workers serve many tasks.
_READY: dict[int, Counts] = {}


def _counts(vocabulary: list[bytes], key: int) -> Counts:
    if key not in _READY:
        _READY.clear()
        _READY[key] = Counts(Automaton(vocabulary))
    return _READY[key]


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> list[bytes]:
    """The entries of a file of ranks (one base64 entry and its number per line), by way of Spark's reader."""
    lines = spark.read.text(path)
    held = lines.agg(F.coalesce(F.sum(F.length("value")), F.lit(0))).first()[0]
    if held > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {held} bytes; at most {MAX_VOCABULARY_BYTES} are sent to all tasks")
    found = [base64.b64decode(row.value.split()[0]) for row in lines.collect() if row.value.strip()]
    return sorted(token for token in found if token)


def token_counts(text: Column, vocabulary: list[bytes], spark: SparkSession) -> Column:
    """A struct of the words and greedy pieces of a text; none for a null text."""
    sent = spark.sparkContext.broadcast(vocabulary)
    key = xxhash.xxh64_intdigest(b"\n".join(vocabulary))

    @F.arrow_udf("struct<n_words:long,n_tokens:long>")
    def run(texts: pa.Array) -> pa.Array:
        known = _counts(sent.value, key)
        rows = []
        for some in pieces(texts):
            for text in some:
                words = (text or b"").split()
                rows.append((len(words), sum(map(known.__getitem__, words))))
        table = np.array(rows, np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(table[:, 0].copy()), pa.array(table[:, 1].copy())], ["n_words", "n_tokens"])

    return run(text)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """One row per document: id, ``n_bytes`` (UTF-8), ``n_words`` and ``n_tokens``.

    Every word is cut up with a blank before it; words lie between ASCII
    blanks.  Null and empty texts have no tokens.  A text or word of any length
    is read whole, in time in proportion.  Repeated rows yield a row each, a
    null id stays null, an empty table has no rows, other columns are left out.
    """
    vocabulary = read_vocabulary(docs.sparkSession, vocabulary_path)
    found = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        token_counts(F.col(text_col), vocabulary, docs.sparkSession).alias("found"),
    )
    return found.select(F.col("id").alias(id_col), "n_bytes", "found.*")
