"""Set-wise inserts, upserts, assignments and cascading deletes (J1, J2,
J22-J27, J31-J34, A12, A13, U5).

There is no table format with MERGE in the image, so an upsert is written as
a full outer join on the key followed by ``coalesce``; the caller writes the
result to a new directory and swaps it in (write-then-swap).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_keys(batch: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key is absent from ``existing`` (left anti).
    The existing side is reduced to distinct keys first: its partial
    aggregation collapses a key repeated in a third of the rows on the map
    side, where a skewed build side of an anti join could not be split."""
    return batch.join(existing.select(*keys).distinct(), on=keys, how="left_anti")


def present_keys(batch: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key exists in ``existing`` (left semi, over
    distinct keys of ``existing``)."""
    return batch.join(existing.select(*keys).distinct(), on=keys, how="left_semi")


def dedupe_min(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep one row per key deterministically: the one with the least
    ``order`` (an aggregate, so it pre-aggregates map-side)."""
    others = [c for c in df.columns if c not in keys]
    packed = F.min(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in others if c != order]))
    out = df.groupBy(*keys).agg(packed.alias("_m"))
    return out.select(*keys, F.col("_m._o").alias(order), *[F.col(f"_m.{c}") for c in others if c != order])


def merge_upsert(current: DataFrame, updates: DataFrame, keys: list[str],
                 rules: dict[str, Column] | None = None, stamp: Column | None = None) -> DataFrame:
    """Full outer merge of ``updates`` into ``current`` on ``keys``.

    Columns default to the update's value when present, else the current one.
    ``rules`` overrides a column with an expression over ``c.<col>`` (current)
    and ``u.<col>`` (update), e.g. ``least(c.first_seen, u.first_seen)``.
    ``stamp`` sets ``updated_at`` on touched rows.
    """
    rules = rules or {}
    c, u = current.alias("c"), updates.alias("u")
    cond = reduce(lambda a, b: a & b, [F.col(f"c.{k}") == F.col(f"u.{k}") for k in keys])
    joined = c.join(u, cond, "full_outer")
    touched = reduce(lambda a, b: a | b, [F.col(f"u.{k}").isNotNull() for k in keys])
    cols = []
    for name in current.columns:
        if name in keys:
            cols.append(F.coalesce(F.col(f"u.{name}"), F.col(f"c.{name}")).alias(name))
        elif name in rules:
            cols.append(F.when(touched, rules[name]).otherwise(F.col(f"c.{name}")).alias(name))
        elif name == "updated_at" and stamp is not None:
            cols.append(F.when(touched, stamp).otherwise(F.col(f"c.{name}")).alias(name))
        elif name in updates.columns:
            cols.append(F.when(touched, F.coalesce(F.col(f"u.{name}"), F.col(f"c.{name}"))).otherwise(F.col(f"c.{name}")).alias(name))
        else:
            cols.append(F.col(f"c.{name}").alias(name))
    return joined.select(*cols)


def delete_keys(table: DataFrame, ids: DataFrame, key: str, ids_key: str | None = None) -> DataFrame:
    """Remove rows whose ``key`` is in ``ids`` (anti join, never a list)."""
    ids_key = ids_key or key
    return table.join(ids.select(F.col(ids_key).alias(key)).distinct(), on=key, how="left_anti")
