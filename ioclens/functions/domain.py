"""Domain feature extractor (XD1-XD30): table in, same rows + features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CONSONANTS, DOMAIN_COMMON_TLDS, DOMAIN_WORDS, NEW_TLDS, SUSPICIOUS_TLDS
from .text import col, contains_any, count_re, count_sub, entropy, flag, ratio, strip_ws, unique_ratio

# Serving and training copies differ only by has_suspicious_tld (serving).
DOMAIN_FEATURES = [
    "domain_length", "num_dots", "num_hyphens", "num_underscores", "has_digits", "digit_count",
    "letter_count", "vowel_count", "consonant_count", "has_common_tld", "has_new_tld",
    "has_suspicious_tld", "tld_length", "tld_is_numeric", "name_length", "starts_with_digit",
    "has_4plus_consonants", "has_suspicious_pattern", "entropy", "vowel_ratio", "digit_ratio",
    "letter_ratio", "subdomain_count", "has_subdomain", "unique_char_ratio", "has_repetitive_chars",
    "has_mixed_case", "has_consecutive_special", "is_short_with_new_tld",
]


def domain_features(df: DataFrame, c: str = "value", lower: bool = True) -> DataFrame:
    """Add the domain features.  ``lower`` lower-cases first (serving path);
    the training path keeps the case so ``has_mixed_case`` can fire."""
    d0 = strip_ws(col(c))
    d = F.lower(d0) if lower else d0
    tmp = df.withColumn("_d", d)
    d = F.col("_d")
    tmp = tmp.withColumn("_tld", F.when(F.contains(d, F.lit(".")), F.element_at(F.split(d, r"\."), -1)).otherwise(F.lit("")))
    tmp = tmp.withColumn("_nm", F.when(F.contains(d, F.lit(".")), F.regexp_replace(d, r"\.[^.]*$", "")).otherwise(d))
    tld, nm = F.col("_tld"), F.col("_nm")
    length = F.length(d)
    digits = count_re(d, r"\p{Nd}")
    letters = count_re(d, r"\p{L}")
    vowels = count_re(F.lower(d), "[aeiou]")
    dots = count_sub(d, ".")
    sub = F.greatest(F.lit(0), dots - 1)
    feats = {
        "domain_length": length,
        "num_dots": dots,
        "num_hyphens": count_sub(d, "-"),
        "num_underscores": count_sub(d, "_"),
        "has_digits": flag(digits > 0),
        "digit_count": digits,
        "letter_count": letters,
        "vowel_count": vowels,
        "consonant_count": count_re(F.lower(d), f"[{CONSONANTS}]"),
        "has_common_tld": flag(tld.isin(*DOMAIN_COMMON_TLDS)),
        "has_new_tld": flag(tld.isin(*NEW_TLDS)),
        "has_suspicious_tld": flag(tld.isin(*SUSPICIOUS_TLDS)),
        "tld_length": F.length(tld),
        "tld_is_numeric": flag(tld.rlike(r"^\p{Nd}+$")),
        "name_length": F.length(nm),
        "starts_with_digit": flag(nm.rlike(r"^\p{Nd}")),
        "has_4plus_consonants": flag(F.lower(nm).rlike(f"[{CONSONANTS}]{{4}}")),
        "has_suspicious_pattern": flag(contains_any(F.lower(nm), DOMAIN_WORDS)),
        "entropy": entropy(nm),
        "vowel_ratio": ratio(vowels, letters),
        "digit_ratio": ratio(digits, length),
        "letter_ratio": ratio(letters, length),
        "subdomain_count": sub,
        "has_subdomain": flag(sub > 0),
        "unique_char_ratio": unique_ratio(nm),
        # a triple whose start is before len-3 (the last triple is not tested)
        "has_repetitive_chars": flag(F.lower(nm).rlike(r"(?s)(.)\1\1.")),
        "has_mixed_case": flag(d.rlike(r"\p{Lu}") & d.rlike(r"\p{Ll}")),
        "has_consecutive_special": flag(d.rlike(r"[-_]{2}")),
        "is_short_with_new_tld": flag((F.length(nm) <= 5) & tld.isin(*NEW_TLDS)),
    }
    return tmp.select(*df.columns, *[v.alias(k) for k, v in feats.items()])
