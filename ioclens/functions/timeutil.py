"""Time helpers: exact instant arithmetic on timestamp / timestamp_ntz."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def micros(c) -> Column:
    """Microseconds since the epoch (exact; session zone is UTC)."""
    return F.unix_micros(col(c).cast("timestamp"))


def hours_between(a, b) -> Column:
    return (micros(b) - micros(a)) / 3.6e9


def iso(c) -> Column:
    """ISO-8601 text as Python's ``isoformat()`` writes it (fraction only
    when non-zero)."""
    c = col(c)
    frac = micros(c) % 1000000
    return F.when(frac == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
