"""Small string helpers composed from built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Trim leading/trailing white space of any script, the four information
    separators U+001C to U+001F included (not only blanks)."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def count_sub(c, sub: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    c = col(c)
    if len(sub) == 1:
        return (F.length(c) - F.length(F.replace(c, F.lit(sub), F.lit("")))).cast("int")
    return ((F.length(c) - F.length(F.replace(c, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def count_re(c, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern)).cast("int")


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def contains_any(c, words) -> Column:
    c = col(c)
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def count_contained(c, words) -> Column:
    """How many of ``words`` occur at least once."""
    c = col(c)
    return reduce(lambda a, b: a + b, [flag(F.contains(c, F.lit(w))) for w in words])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")


def chars(c) -> Column:
    """Characters of a string as an array ('' -> [])."""
    c = col(c)
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def entropy(c) -> Column:
    """Shannon entropy (bits) of the lower-cased characters; 0 if len <= 1."""
    c = F.lower(col(c))
    arr = chars(c)
    n = F.length(c).cast("double")
    probs = F.transform(F.array_distinct(arr),
                        lambda ch: F.size(F.filter(arr, lambda x: x == ch)) / n)
    ent = F.aggregate(probs, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(F.length(c) > 1, ent).otherwise(F.lit(0.0))


def unique_ratio(c) -> Column:
    c = col(c)
    return ratio(F.size(F.array_distinct(chars(F.lower(c)))).cast("double"), F.length(c).cast("double"))
