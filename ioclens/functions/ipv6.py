"""IPv6 validation and canonical text (the one scalar pandas UDF).

IPv4 is handled by expressions; IPv6 needs real address parsing (zero
compression, embedded IPv4, scope ids), so an Arrow-batched pandas UDF wraps
the standard ``ipaddress`` module.  Rows without ':' are skipped cheaply.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _canon(v):
    if v is None or ":" not in v:
        return None
    try:
        return str(ipaddress.ip_address(v))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def ipv6_canonical(values: pd.Series) -> pd.Series:
    """Canonical text of a valid IPv6 address, NULL if invalid."""
    return values.map(_canon)
