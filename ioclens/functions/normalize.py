"""Indicator type detection, validation and normal forms.

``normalize_inputs`` is the set-wise version of the per-row normaliser: it
adds ``type``, normalised ``value``, ``original`` and a ``reject_reason``
(NULL for accepted rows) without dropping anything, so accepted and rejected
rows stay one partitioned DataFrame until the caller splits them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FEED_TYPE_MAP, IOC_TYPES
from . import urls
from .ipv6 import ipv6_canonical
from .text import col, strip_ws

OCTET_ANY = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
DETECT_IP_RE = rf"^(?:{OCTET_ANY}\.){{3}}{OCTET_ANY}$"
OCTET_STRICT = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
VALID_IPV4_RE = rf"^{OCTET_STRICT}(?:\.{OCTET_STRICT}){{3}}$"
URL_PREFIX_RE = r"^https?://"
HASH_RE = r"^(?:[a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})$"
DOMAIN_RE = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"


def refang(c) -> Column:
    """``example[.]com`` -> ``example.com``."""
    return F.replace(col(c), F.lit("[.]"), F.lit("."))


def detect_type(v) -> Column:
    """IPv4 shape -> url (http/https prefix) -> hash -> domain (default)."""
    v = col(v)
    return (F.when(v.rlike(DETECT_IP_RE), "ip")
            .when(F.lower(v).rlike(URL_PREFIX_RE), "url")
            .when(v.rlike(HASH_RE), "hash")
            .otherwise("domain"))


def map_feed_type(t) -> Column:
    """Feed vocabulary (IPv4, hostname, FileHash-SHA256, ...) -> type."""
    t = col(t)
    m = F.create_map(*[F.lit(x) for kv in FEED_TYPE_MAP.items() for x in kv])
    return F.coalesce(m[t], F.lower(t))


def is_valid_ipv4(v) -> Column:
    return col(v).rlike(VALID_IPV4_RE)


def is_valid_domain(v) -> Column:
    v = col(v)
    return (F.length(v) <= 253) & v.rlike(DOMAIN_RE)


def is_valid_hash(v) -> Column:
    return col(v).rlike(HASH_RE)


def network_reject_reason(c) -> Column:
    """Why a network description is refused, NULL if it is not: by
    its trimmed length, or for want of any ASCII letter or digit."""
    v = strip_ws(F.col(c) if isinstance(c, str) else c)
    v = F.coalesce(v, F.lit(""))
    return F.when(F.length(v) < 3, "network_too_short").when(~F.rlike(v, F.lit("[a-zA-Z0-9]")), "network_no_alphanumeric")


def normalize_inputs(df: DataFrame, value: str = "value", type_col: str | None = None) -> DataFrame:
    """Add ``type``, ``value`` (normal form), ``original`` and ``reject_reason``.

    * value is refanged and whitespace-trimmed first;
    * a provided type (feed or file column) wins, else the type is detected;
    * invalid values are kept with a reason instead of raising.
    """
    original = F.col(value)
    v = strip_ws(refang(original))
    given = F.lower(strip_ws(F.col(type_col))) if type_col else F.lit(None).cast("string")
    df = df.withColumn("original", original).withColumn("_v", v)
    df = df.withColumn("_t", F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(detect_type(F.col("_v"))))
    vv, t = F.col("_v"), F.col("_t")
    # Detected types never give an 'ip' containing ':', so the Python UDF is
    # planned only when the type comes from the data.
    v6 = ipv6_canonical(F.when(F.contains(vv, F.lit(":")), vv)) if type_col else F.lit(None).cast("string")
    ip_norm = F.when(is_valid_ipv4(vv), vv).when(F.contains(vv, F.lit(":")), v6)
    norm = (F.when(t == "ip", ip_norm)
            .when(t == "domain", F.when(is_valid_domain(vv), F.lower(vv)))
            .when(t == "url", F.when(urls.is_valid(vv), urls.normalize(vv)))
            .when(t == "hash", F.when(is_valid_hash(vv), F.lower(vv)))
            .when(t == "network", F.when(F.length(vv) >= 3, vv)))
    reason = (F.when(original.isNull() | (vv == ""), "empty_value")
              .when(~t.isin(*IOC_TYPES), F.concat(F.lit("unsupported_type:"), t))
              .when(F.col("_n").isNull(),
                    F.when(t == "network", "network_too_short").otherwise(F.concat(F.lit("invalid_"), t))))
    return (df.withColumn("_n", norm)
              .withColumn("reject_reason", reason)
              .withColumn("type", t)
              .withColumn(value, F.col("_n"))
              .drop("_v", "_t", "_n"))
