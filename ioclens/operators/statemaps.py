"""Accepted lifecycle transitions (W3, L2) as composed state maps.

A request is judged against its threat's last *accepted* state: the same
state is ``noop``, a permitted one is ``valid`` and becomes the state, any
other is ``invalid`` and changes nothing.  So each request is a map of the
states (none, and the five) into themselves, and a run of requests is the
composition of their maps -- associative, so it is computed in pieces:

1. rows are cut into buckets of about ROWS in (time, id) order and written
   once, so a busy threat or instant is spread over many buckets;
2. the requests of a (threat, bucket) are composed into one map, streaming
   over sorted rows;
3. the maps of a threat, one row a bucket, are applied in order to "none":
   the state at the start of each of its buckets;
4. that state goes before the bucket's requests, which are judged streaming.

Each step holds one Arrow batch and one state, however long a threat's log.
The maps that five states generate are few (MAPS), so composing is a table
look-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LIFECYCLE_STATES, TRANSITIONS
from ..session import scratch_path

ROWS = 1 << 18
NONE = 0  # no accepted state yet; the states follow from 1
UNKNOWN = 0  # a requested state outside the enumeration: changes nothing


def _steps() -> list[list[int]]:
    """[state][requested] -> state afterwards."""
    n = len(LIFECYCLE_STATES) + 1
    out = [[s] * n for s in range(n)]
    out[NONE][1 + LIFECYCLE_STATES.index("new")] = 1 + LIFECYCLE_STATES.index("new")
    for a, others in TRANSITIONS.items():
        for b in others:
            out[1 + LIFECYCLE_STATES.index(a)][1 + LIFECYCLE_STATES.index(b)] = 1 + LIFECYCLE_STATES.index(b)
    return out


STEP = _steps()


def _closure() -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """All maps that requests compose to, the identity first, and [map][requested] -> map."""
    n = len(STEP)
    maps, then = [tuple(range(n))], []
    at = {maps[0]: 0}
    for m in maps:  # grows while new maps are found
        row = []
        for x in range(n):
            new = tuple(STEP[s][x] for s in m)
            if new not in at:
                at[new] = len(maps)
                maps.append(new)
            row.append(at[new])
        then.append(row)
    return maps, then


MAPS, THEN = _closure()


def _starts(batch: pa.RecordBatch, names: list[str], before: tuple | None) -> tuple[np.ndarray, tuple]:
    """Rows whose key differs from the row before (null-safe), and the last key."""
    cols = []
    for n in names:
        cols += [batch[n].is_null().to_numpy(zero_copy_only=False).astype(np.int64), batch[n].fill_null(0).to_numpy(zero_copy_only=False)]
    rows = np.column_stack(cols)
    new = np.r_[before is None or before != tuple(rows[0].tolist()), (rows[1:] != rows[:-1]).any(1)]
    return np.flatnonzero(new), tuple(rows[-1].tolist())


def _compose(names: list[str]):
    """(key..., map) of each run of rows of one key, from rows (key..., x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held, m = None, None, 0
        for batch in filter(len, batches):
            starts, before = _starts(batch, names, before)
            xs, at, done, maps = batch["x"].to_pylist(), 0, [], []
            for start in [*starts.tolist(), len(xs)]:
                for x in xs[at:start]:
                    m = THEN[m][x]
                at = start
                if start < len(xs):  # a key ends before this row
                    if held is not None:
                        done.append(held)
                        maps.append(m)
                    held, m = batch.slice(start, 1).select(names), 0
            if done:
                keys = pa.Table.from_batches(done).combine_chunks()
                yield keys.append_column("map", pa.array(maps, pa.int32())).to_batches()[0]
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([m], pa.int32())], names=[*names, "map"])

    return run


def _apply(names: list[str]):
    """The state at the start of each bucket, from (key..., bucket, map,
    known) rows in bucket order; a row with ``known`` says the state that the
    key comes with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, s = None, NONE
        for batch in filter(len, batches):
            starts, before = _starts(batch, names, before)
            first, out = set(starts.tolist()), []
            for k, (m, known) in enumerate(zip(batch["map"].to_pylist(), batch["known"].to_pylist(), strict=True)):
                s = NONE if k in first else s
                out.append(s)
                s = MAPS[m][s] if known is None else known
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.int32())], names=[*batch.schema.names[:-2], "start"])

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, before) of the rows without ``start``, in order; a row with it
    sets the state."""
    s = NONE
    for batch in batches:
        out = []
        for start, x in zip(batch["start"].to_pylist(), batch["x"].to_pylist(), strict=True):
            if start is None:
                out.append(s)
                s = STEP[s][x]
            else:
                s = start
        row = batch["row"].filter(batch["start"].is_null())
        yield pa.RecordBatch.from_arrays([row, pa.array(out, pa.int32())], names=["row", "before"])


def judged(log: DataFrame, keys: list[str], ts: str, tie: str, state: str, rows: int = ROWS, known: DataFrame | None = None) -> DataFrame:
    """The log with ``prev_state`` (the last accepted one, null if none) and
    ``verdict``.  Keys are long columns; null keys are a threat of their own.
    ``known``: (keys..., state) that threats come with, one row each."""
    spark = log.sparkSession
    buckets = max(1, -(-log.count() // rows))
    path = scratch_path(spark, "state-log")
    cut = log.select(F.struct(*[F.col(f"`{c}`") for c in log.columns]).alias("row")).repartitionByRange(buckets, f"row.{ts}", f"row.{tie}")
    cut.withColumn("bucket", F.spark_partition_id()).write.parquet(path)
    own = spark.read.parquet(path)
    ids = [F.col(f"row.{k}").cast("long").alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    at = own.select(*ids, "bucket", F.col(f"row.{ts}").alias("ts"), F.col(f"row.{tie}").alias("tie"), _code(F.col(f"row.{state}")).alias("x"), "row")
    kind = ", ".join(f"{n} long" for n in names) + ", bucket int"
    parts = at.select(*names, "bucket", "ts", "tie", "x").repartition(*names, "bucket").sortWithinPartitions(*names, "bucket", "ts", "tie")
    maps = parts.select(*names, "bucket", "x").mapInArrow(_compose([*names, "bucket"]), f"{kind}, map int")
    maps = maps.withColumn("known", F.lit(None).cast("int"))
    if known is not None:
        come = known.select(*[F.col(k).cast("long").alias(f"k{i}") for i, k in enumerate(keys)], F.lit(-1).alias("bucket"), F.lit(0).alias("map"), _code(F.col("state")).alias("known"))
        maps = maps.unionByName(come)
    starts = maps.repartition(*names).sortWithinPartitions(*names, "bucket").mapInArrow(_apply(names), f"{kind}, start int").where("bucket >= 0")
    heads = starts.select(*names, "bucket", F.lit(None).cast(at.schema["ts"].dataType).alias("ts"), F.lit(None).cast(at.schema["tie"].dataType).alias("tie"),
                          F.lit(0).alias("x"), F.lit(None).cast(at.schema["row"].dataType).alias("row"), "start")
    both = at.withColumn("start", F.lit(None).cast("int")).unionByName(heads)
    both = both.repartition(*names, "bucket").sortWithinPartitions(*names, "bucket", F.col("start").isNull(), "ts", "tie")
    done = both.select("row", "x", "start").mapInArrow(_judge, f"row {at.schema['row'].dataType.simpleString()}, before int")
    prev = F.element_at(F.array(F.lit(None).cast("string"), *[F.lit(s) for s in LIFECYCLE_STATES]), F.col("before") + 1)
    out = done.select("row.*", prev.alias("prev_state"))
    ok = F.when(F.col("prev_state").isNull(), F.col(state) == "new").otherwise(F.array_contains(allowed()[F.col("prev_state")], F.col(state)))
    return out.withColumn("verdict", F.when(F.col("prev_state") == F.col(state), "noop").when(ok, "valid").otherwise("invalid"))


def _code(state):
    """The number of a requested state."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in LIFECYCLE_STATES]), state).cast("int"), F.lit(UNKNOWN))


def allowed():
    pairs = []
    for s in LIFECYCLE_STATES:
        pairs += [F.lit(s), F.array(*[F.lit(t) for t in TRANSITIONS[s]]).cast("array<string>")]
    return F.create_map(*pairs)
