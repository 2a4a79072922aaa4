"""File-hash feature extractor (XH1-XH8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import col, count_re, entropy, flag, unique_ratio

HASH_FEATURES = ["length", "is_hex", "entropy", "unique_ratio", "digit_ratio", "letter_ratio",
                 "max_run", "transition_ratio"]


def hash_features(df: DataFrame, c: str = "value") -> DataFrame:
    h = F.lower(F.regexp_replace(col(c), r"^\s+|\s+$", ""))
    tmp = df.withColumn("_h", h)
    h = F.col("_h")
    n = F.length(h)
    runs = F.regexp_extract_all(h, F.lit(r"((.)\2*)"), 1)
    trans = count_re(h, r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")
    feats = {
        "length": n,
        "is_hex": flag(h.rlike("^[0-9a-f]+$")),
        "entropy": entropy(h),
        "unique_ratio": unique_ratio(h),
        "digit_ratio": F.when(n > 0, count_re(h, r"\d") / n).otherwise(0.0),
        "letter_ratio": F.when(n > 0, count_re(h, r"\p{L}") / n).otherwise(0.0),
        "max_run": F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(1)),
        "transition_ratio": F.when(n > 1, trans / (n - 1)).otherwise(0.0),
    }
    return tmp.select(*df.columns, *[v.alias(k) for k, v in feats.items()])
