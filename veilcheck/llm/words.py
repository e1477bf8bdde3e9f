"""Whole texts as words, and word hashes, in pieces of bounded size.

A word is a run of bytes other than the six ASCII blanks (space, tab, line
feed, vertical tab, form feed, carriage return), which is how ``bytes.split``
cuts; ``bytes.lower`` lowers A-Z alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pieces(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[list[bytes | None]]:
    """The texts of a batch as UTF-8, a megabyte (or one longer text) at a time."""
    raw = texts.cast(pa.large_binary())
    sizes = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(raw):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield raw.slice(at, to - at).to_pylist()
        at = to


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def text_hashes(texts: list[bytes | None], end: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in a row, and where each text starts (one more entry at the end).

    With ``end``, every text has one more token after its last word, hashed as
    the empty string, which no word equals.
    """
    split = [(text or b"").lower().split() for text in texts]
    if end:
        for words in split:
            words.append(b"")
    starts = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(words) for words in split], out=starts[1:])
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64, int(starts[-1])), starts


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every input bit over the whole hash."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` word hashes, by start."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n].copy()
    for i in range(1, length):
        total *= _ODD
        total += words[i : i + n]
    return mixed(total)


def seeded_shingles(words: list[bytes], length: int, seed: int) -> Iterator[int]:
    """XXH64 of each space-joined shingle; the whole sequence where there are fewer words."""
    if len(words) < length:
        return iter([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [])
    runs = zip(*(words[i:] for i in range(length)), strict=False)
    return map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(seed))


def majority_bits(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """Fingerprints whose bits are set in over half of the hashes; ``counts`` holds 64 columns as ``bit_rows`` gives them."""
    return np.packbits(counts * 2 > total, axis=-1).view(np.uint64)[..., 0]


def bit_rows(hashes: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones for each hash, last axis last."""
    flat = np.ascontiguousarray(hashes)
    return np.unpackbits(flat.view(np.uint8).reshape(*flat.shape, 8), axis=-1)
