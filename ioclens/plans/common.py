"""Helpers shared by plan modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.normalize import normalize_inputs
from ..sources import views


def r6(c) -> Column:
    """Doubles leave plans rounded to 6 places (stable across engines)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def normalized_inputs(spark, sf_dir):
    """raw_inputs -> detected type, normal form, reject reason (all rows)."""
    return normalize_inputs(views.raw_inputs(spark, sf_dir), "value")


def accepted(spark, sf_dir, type_: str | None = None):
    df = normalized_inputs(spark, sf_dir).where(F.col("reject_reason").isNull())
    return df.where(F.col("type") == type_) if type_ else df
