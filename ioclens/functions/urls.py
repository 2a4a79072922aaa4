"""URL parsing into components with RFC-3986 shaped regular expressions.

Semantics follow a standard ``urlparse``: the scheme must start with a
letter; the authority runs to the first ``/?#``; ``;params`` of the last path
segment are not part of the path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.-]*):"
VALID_URL_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"
AUTH_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
# Everything after the authority, split into path, query, fragment.
REST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)(\?([^#]*))?(#(.*))?$"


def scheme(u) -> Column:
    return F.regexp_extract(col(u), SCHEME_RE, 1)


def netloc(u) -> Column:
    return F.regexp_extract(col(u), AUTH_RE, 1)


def raw_path(u) -> Column:
    """Path including ``;params`` of the last segment."""
    return F.regexp_extract(col(u), REST_RE, 1)


def path(u) -> Column:
    """Path without ``;params`` of the last segment."""
    return F.regexp_replace(raw_path(u), r";[^/]*$", "")


def params(u) -> Column:
    return F.regexp_extract(raw_path(u), r";([^/]*)$", 1)


def query(u) -> Column:
    return F.regexp_extract(col(u), REST_RE, 3)


def fragment(u) -> Column:
    return F.regexp_extract(col(u), REST_RE, 5)


def is_valid(u) -> Column:
    return col(u).rlike(VALID_URL_RE)


def normalize(u) -> Column:
    """Lower scheme and authority, drop :80 (http) / :443 (https), strip all
    trailing '/' of the path, keep params, non-empty query and fragment."""
    u = col(u)
    sch = F.lower(scheme(u))
    loc = F.lower(netloc(u))
    port = F.regexp_extract(loc, r":([^:]*)$", 1)
    host = F.regexp_replace(loc, r":[^:]*$", "")
    drop = F.contains(loc, F.lit(":")) & (((sch == "http") & (port == "80")) | ((sch == "https") & (port == "443")))
    loc = F.when(drop, host).otherwise(loc)
    p = F.regexp_replace(path(u), r"/+$", "")
    prm, q, fr = params(u), query(u), fragment(u)
    return F.concat(sch, F.lit("://"), loc, p,
                    F.when(prm != "", F.concat(F.lit(";"), prm)).otherwise(F.lit("")),
                    F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")),
                    F.when(fr != "", F.concat(F.lit("#"), fr)).otherwise(F.lit("")))
