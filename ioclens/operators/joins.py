"""Joins whose key is NULL in many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_known(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key`` that does not shuffle the rows without a key:
    they match nothing, and would all meet in one partition."""
    known = left.where(F.col(key).isNotNull()).join(right, key, "left")
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != key]
    unknown = left.where(F.col(key).isNull()).select("*", *added)
    return known.unionByName(unknown)
