"""Best-fit packing with swap-based local search.

Texts become token ids plus an end id; only longer documents are cut, into
pieces of the capacity.  Pieces carry no ids through the shuffle: packing
needs their lengths only.

Plan: (1) pieces, stored with a row number.  (2) Rounds: pieces are dealt by
the hash of it, so repeated rows never meet in one task, to blocks of about
BLOCK; each block is packed on its own (best fit decreasing, then
local search); bins that are nearly full are closed and the rest of the
pieces enter the next, smaller round.  The last round is one block, or as
many as are left when another round would not shrink them; it closes all.

Local search: while a block has more bins than its tokens need, the least
full bin gives its pieces away: a piece moves to the tightest bin that takes
it, or is exchanged for a smaller piece of a bin, or two pieces are
exchanged for one.  Every step raises the sum of squared fills, so it ends.
It also ends after PATIENCE bins in a row that could not be emptied: a block
may then keep bins that a longer search would empty (the README has figures
against the lower bound); what is packed is right either way.

Defined results: a null or empty text is its end id alone; ids may be null
or repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder

BLOCK = 1 << 15
#: A bin is closed before the last round if at most this part of it is free.
CLOSED = 1 / 256
PATIENCE = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            texts = (x.as_py() for x in batch["text"])
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), enc.encode_all(texts), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start:start + capacity]
                    rows.append((doc_id, k, start, len(own), zlib.crc32(own.tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Positions of each bin; ``lengths`` in descending order.  ``open_at``
    has a bit for each free size that some bin has."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    open_at = 0
    for i, size in enumerate(lengths):
        fits = open_at >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            stack = by_free[free]
            b = stack.pop()
            if not stack:
                open_at ^= 1 << free
            bins[b].append(i)
        else:
            b, free = len(bins), capacity
            bins.append([i])
        left = free - size
        if left:
            stack = by_free.setdefault(left, [])
            if not stack:
                open_at |= 1 << left
            stack.append(b)
    return bins


def _improve(victim: list[int], others: list[list[int]], free: list[int], size: list[int]) -> bool:
    """One step that empties ``victim`` a little; False if there is none."""
    fill = sum(size[i] for i in victim)
    for i in sorted(victim, key=lambda i: -size[i]):
        fits = [b for b in range(len(others)) if free[b] >= size[i]]
        if fits:
            b = min(fits, key=lambda b: free[b])
            victim.remove(i)
            others[b].append(i)
            free[b] -= size[i]
            return True
    # what leaves the victim is larger than what comes back, by at most the room there
    give = [(size[i], (i,)) for i in victim] + [(size[i] + size[j], (i, j)) for n, i in enumerate(victim) for j in victim[n + 1:]]
    best = None
    for b, own in enumerate(others):
        if not free[b] or capacity_of(own, size) + free[b] <= fill:
            continue
        for j in own:
            for total, items in give:
                gain = total - size[j]
                if 0 < gain <= free[b] and capacity_of(own, size) + gain > fill - gain and (best is None or gain > best[0]):
                    best = (gain, b, j, items)
        if best and best[0] == free[best[1]]:
            break
    if best is None:
        return False
    gain, b, j, items = best
    for i in items:
        victim.remove(i)
    others[b].remove(j)
    others[b].extend(items)
    victim.append(j)
    free[b] -= gain
    return True


def capacity_of(own: list[int], size: list[int]) -> int:
    return sum(size[i] for i in own)


def local_search(bins: list[list[int]], size: list[int], capacity: int) -> list[list[int]]:
    """Empties bins while there are more than the total needs; gives up
    after PATIENCE bins in a row, least full first, that cannot be emptied."""
    need = -(-sum(size) // capacity)
    full = [b for b in bins if capacity_of(b, size) == capacity]
    under = sorted((b for b in bins if capacity_of(b, size) < capacity), key=lambda b: -capacity_of(b, size))
    failed = 0
    while len(full) + len(under) > need and failed < min(PATIENCE, len(under) - 1):
        victim = under.pop(len(under) - 1 - failed)
        free = [capacity - capacity_of(b, size) for b in under]
        while victim and _improve(victim, under, free, size):
            pass
        failed = failed + 1 if victim else 0
        under = sorted(under + [victim] * bool(victim), key=lambda b: -capacity_of(b, size))
    return full + under


def _round(capacity: int, number: int, closing: int):
    """Packs the rows of each partition in blocks; ``closing``: bins with at
    most that much room are final."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, made, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def packed() -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(held).combine_chunks()
            size = t["length"].to_numpy()
            order = np.argsort(-size, kind="stable")
            lengths = size[order].tolist()
            bins = local_search(best_fit(lengths, capacity), lengths, capacity)
            items = [i for b in bins for i in b]
            counts = [len(b) for b in bins]
            each = np.array([lengths[i] for i in items], np.int64)
            ends = np.cumsum(each)
            last = np.cumsum(counts) - 1
            first = np.repeat(ends[last] - np.add.reduceat(each, np.r_[0, last[:-1] + 1]), counts)
            room = np.repeat(capacity - np.add.reduceat(each, np.r_[0, last[:-1] + 1]), counts)
            # round, partition, then the partition's bins counted on
            ids = np.repeat((number << 57) + (part << 33) + made + np.arange(len(bins)), counts)
            made += len(bins)
            t = t.take(pa.array(order[items])).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(ends - each - first))
            return t.append_column("final", pa.array(room <= closing)).combine_chunks().to_batches()[0]

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                rows += held[-1].num_rows
                if rows >= 2 * BLOCK:
                    yield packed()
                    held, rows = [], 0
        if rows:
            yield packed()

    return run


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """Rows of PIECES plus (sequence_id, offset)."""
    spark = parts.sparkSession
    parts = stored(parts.withColumn("row", F.monotonically_increasing_id()), "pieces")
    left, n, number, done = parts, parts.count(), 0, []
    while True:
        blocks = max(1, -(-n // BLOCK))
        dealt = left.repartition(blocks, F.xxhash64("row")).sortWithinPartitions("row")
        closing = capacity if blocks == 1 else int(capacity * CLOSED)
        made = stored(dealt.mapInArrow(_round(capacity, number, closing), PIECES + ", row long, sequence_id long, offset long, final boolean"), f"packed-{number}")
        rest = made.where("NOT final").count() if closing < capacity else 0
        if rest > n // 2:  # these do not get fewer
            done.append(made)
            break
        done.append(made.where("final"))
        if not rest:
            break
        left, n, number = made.where("NOT final").select(parts.columns), rest, number + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("final", "row") if done else spark.createDataFrame([], PIECES + ", sequence_id long, offset long")


def query(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(pieces(docs, path, capacity, end_id), capacity)
