"""Elements of large JSON arrays, read in parallel (A2, A4, A5).

A landed feed or bulk upload is one JSON document, often one array of many
objects on a single line; parsed whole it takes one task and its memory.  Here
the bytes are cut into chunks.  Whether a chunk starts inside a string, after
a backslash, or how deep, depends on everything before it -- but only through
three things, so each chunk says, for every way it may start, how it ends
(string?, backslash?, depth gained).  These summaries are applied in order,
one row a chunk; then every chunk knows its start and gives the objects that
begin in it at the wanted depth, reading on past its end to finish the last.
A task holds a chunk and the object it finishes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 32 << 20
OPEN, CLOSE, QUOTE, SLASH = (123, 91), (125, 93), 34, 92
STARTS = [(False, False), (True, False), (True, True)]  # (in a string, after a backslash)


def open_input(path: str):
    """A seekable file of any store pyarrow knows."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def marks(data: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """(places of structural brackets, +1 or -1 of each, in a string at the
    end, after a backslash at the end)."""
    n = len(data)
    at = np.arange(n)
    other = data != SLASH
    last = np.maximum.accumulate(np.where(other, at, -1))
    before = np.r_[-1, last[:-1]]  # the last byte before each that is no backslash
    run = at - 1 - before + (before < 0) * int(escaped)
    quote = (data == QUOTE) & (run % 2 == 0)
    within = (np.cumsum(quote) + int(inside)) % 2 == 1
    level = np.isin(data, OPEN).astype(np.int64) - np.isin(data, CLOSE)
    place = np.flatnonzero((level != 0) & ~within & ~quote)
    if not n:
        return place, level[place], inside, escaped
    tail = n - 1 - last[-1] + (int(escaped) if last[-1] < 0 else 0)
    return place, level[place], bool(within[-1]), bool(within[-1]) and tail % 2 == 1


def _summaries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for path, k, start, size in part[["path", "k", "start", "size"]].itertuples(index=False):
            with open_input(path) as f:
                f.seek(start)
                data = np.frombuffer(f.read(size), np.uint8)
            ends = []
            for inside, escaped in STARTS:
                _, level, s, e = marks(data, inside, escaped)
                ends += [STARTS.index((s, e)), int(level.sum())]
            rows.append((path, k, *ends))
        yield pd.DataFrame(rows, columns=["path", "k", "to0", "up0", "to1", "up1", "to2", "up2"])


def _begin(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How each chunk starts, from rows in (path, k) order."""
    path, s, depth = None, 0, 0
    for part in parts:
        rows = []
        for r in part.itertuples(index=False):
            if r.path != path:
                path, s, depth = r.path, 0, 0
            rows.append((r.path, r.k, s, depth))
            s, depth = (r.to0, r.to1, r.to2)[s], depth + (r.up0, r.up1, r.up2)[s]
        yield pd.DataFrame(rows, columns=["path", "k", "state", "depth"])


def _objects(depth: int):
    """(path, json) of the objects that begin in each chunk inside ``depth``
    brackets."""

    def ends(data: np.ndarray, place: np.ndarray, step: np.ndarray, after: np.ndarray) -> np.ndarray:
        return place[(step < 0) & (after == depth) & (data[place] == CLOSE[0])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, start, size, state, level in part[["path", "start", "size", "state", "depth"]].itertuples(index=False):
                with open_input(path) as f:
                    f.seek(start)
                    raw = f.read(size)
                    data = np.frombuffer(raw, np.uint8)
                    place, step, inside, escaped = marks(data, *STARTS[state])
                    after = level + np.cumsum(step)
                    begin = place[(step > 0) & (after == depth + 1) & (data[place] == OPEN[0])]
                    end = ends(data, place, step, after)
                    end = end[np.searchsorted(end, begin[0]):] if len(begin) else end[:0]  # an earlier one ends an earlier chunk's object
                    out = [raw[b:e + 1] for b, e in zip(begin, end, strict=False)]
                    if len(begin) > len(end):  # the last goes on behind this chunk
                        held, level = [raw[begin[-1]:]], int(after[-1])
                        while more := f.read(1 << 20):
                            data = np.frombuffer(more, np.uint8)
                            place, step, inside, escaped = marks(data, inside, escaped)
                            after = level + np.cumsum(step)
                            end = ends(data, place, step, after)
                            if len(end):
                                out.append(b"".join([*held, more[:end[0] + 1]]))
                                break
                            held.append(more)
                            level = int(after[-1]) if len(after) else level
                if out:
                    yield pd.DataFrame({"path": path, "json": [o.decode("utf-8", "replace") for o in out]})

    return run


def objects(spark: SparkSession, path: str, depth: int, chunk: int = CHUNK) -> DataFrame:
    """(path, json): the objects that lie inside ``depth`` brackets of the
    JSON documents at ``path`` (a folder, file or pattern): 1 for an array of
    objects, 2 for an array in an object.  An object that a document's end
    cuts off is left out."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # sizes only; contents are not read
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest((F.col("length") - 1) / chunk, F.lit(0)).cast("long")))
    chunks = files.where("length > 0").select("path", "length", at.alias("k"))
    chunks = chunks.select("path", "k", (F.col("k") * chunk).alias("start"), F.least(F.lit(chunk), F.col("length") - F.col("k") * chunk).cast("long").alias("size"))
    spread = chunks.repartition(F.xxhash64("path", "k"))
    ends = spread.mapInPandas(_summaries, "path string, k long, to0 int, up0 long, to1 int, up1 long, to2 int, up2 long")
    starts = ends.repartition("path").sortWithinPartitions("path", "k").mapInPandas(_begin, "path string, k long, state int, depth long")
    return chunks.join(starts, ["path", "k"]).repartition(F.xxhash64("path", "k")).mapInPandas(_objects(depth), "path string, json string")
