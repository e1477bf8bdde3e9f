"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the longest sequence are cut into pieces.  Pieces are
dealt into groups of a few thousand by a hash, and each group is packed in
decreasing length: a piece goes to the open bin with the least room that takes
it; otherwise a bin is opened, of the length that costs least per token which
it can still receive.  In the end every bin shrinks to the shortest permitted
length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Permitted sequence lengths, in tokens; with a byte vocabulary a token is a byte.
LENGTHS = (2048, 4096, 8192, 16384, 32768)
#: What a sequence costs besides its length, in tokens.
FIXED_COST = 64
#: Pieces that a group should have, and beyond which the rest of it is packed for itself.
GROUP_PIECES, MOST_PIECES = 2048, 1 << 17


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, fixed_cost: float = FIXED_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset within it and length of the bin of each size; ``sizes`` falls and fits the longest."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    opened: list[int] = []  # length of each bin
    room: list[tuple[int, int]] = []  # room left and bin, rising
    used: list[int] = []
    ahead, free = sum(sizes), 0
    for i, size in enumerate(sizes):
        ahead -= size
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, bin_ = room.pop(at)
            free -= left
        else:
            # What is ahead goes to the room of open bins first.
            spare = max(0, ahead - free)
            left = min((c for c in lengths if c >= size), key=lambda c: ((c + fixed_cost) / min(c, size + spare), c))
            bin_ = len(opened)
            opened.append(left)
            used.append(0)
        bins[i], offsets[i] = bin_, used[bin_]
        used[bin_] += size
        if left > size:
            insort(room, (left - size, bin_))
            free += left - size
    fitted = np.array(lengths)[np.searchsorted(lengths, used)] if used else np.zeros(0, np.int64)
    return bins, offsets, fitted[bins]


def _packer(lengths: tuple[int, ...], fixed_cost: float):
    names = ["doc_id", "piece", "start", "length", "bin", "bin_length", "bin_offset"]

    def flush(rows: pa.Table, group: int, bins: int) -> tuple[pa.RecordBatch, int]:
        at, offset, fitted = pack(rows.column("length").to_pylist(), lengths, fixed_cost)
        done = [rows.column(n).combine_chunks() for n in names[:4]]
        new = [pa.array((group << 32) + bins + at), pa.array(fitted.astype(np.int64)), pa.array(offset)]
        return pa.record_batch(done + new, names), bins + int(at.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and falling length."""
        held: list[pa.RecordBatch] = []
        group, bins = None, 0
        for batch in batches:
            groups = batch.column("grp").to_numpy()
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and (groups[a] != group or sum(map(len, held)) >= MOST_PIECES):
                    done, bins = flush(pa.Table.from_batches(held), group, bins)
                    held = []
                    yield done
                if groups[a] != group:
                    group, bins = int(groups[a]), 0
                held.append(batch.slice(a, b - a))
        if held:
            yield flush(pa.Table.from_batches(held), group, bins)[0]

    return run


def pack_sequences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
    lengths: tuple[int, ...] = LENGTHS, fixed_cost: float = FIXED_COST, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece of a document: where it starts, how long it is, and its place in which bin of what length.

    ``length_col`` gives tokens; without it, a document has its UTF-8 bytes and
    one end mark (a null text has the end mark alone).  Nothing is dropped or
    cut short: the pieces of a document cover it.  A null or non-positive
    length counts as one.  Repeated rows are packed each; a null id is kept as
    null.  Bins hold pieces of one group only, and bin numbers are unique.
    """
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    tokens = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(1)), F.lit(1)) if length_col else F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(1).cast("long")
    groups = max(1, round(docs.count() / group_pieces))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), tokens.cast("long").alias("tokens"))
    last = F.floor((F.col("tokens") - 1) / longest).cast("long")
    rows = sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * longest
    rows = rows.select("doc_id", "piece", start.alias("start"), F.least(F.lit(longest), F.col("tokens") - start).cast("long").alias("length"))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(groups)))
    ordered = rows.repartition("grp").sortWithinPartitions("grp", F.desc("length"), "doc_id", "piece")
    schema = "doc_id long, piece long, start long, length long, bin long, bin_length long, bin_offset long"
    return ordered.mapInArrow(_packer(lengths, fixed_cost), schema).withColumnRenamed("doc_id", id_col)
