"""URL feature extractor (XU1-XU56): table in, same rows + features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (CONSONANTS, EXECUTABLE_EXTENSIONS, MALICIOUS_PATHS, NEW_TLDS, QUERY_WORDS,
                         SHORTENERS, SUSPICIOUS_TLDS, SYMBOL_COMBOS, TRAVERSAL_PATTERNS, URL_COMMON_TLDS,
                         URL_KEYWORDS)
from . import urls
from .text import col, contains_any, count_contained, count_re, count_sub, entropy, flag, ratio, strip_ws, unique_ratio

URL_FEATURES = [
    "url_length", "num_dots", "num_hyphens", "num_underscores", "num_slashes", "num_questionmarks",
    "num_ampersands", "num_equals", "num_at", "num_percent", "has_https", "has_http", "has_ftp",
    "domain_length", "path_length", "path_depth", "query_length", "num_params", "tld_length",
    "has_common_tld", "has_new_tld", "has_suspicious_tld", "tld_is_numeric", "subdomain_count",
    "has_subdomain", "digit_count", "letter_count", "special_char_count", "url_entropy",
    "domain_entropy", "suspicious_keyword_count", "has_ip_address", "hex_char_count",
    "has_repetitive_chars", "is_shortened", "has_port", "has_executable_extension",
    "encoded_char_ratio", "digit_ratio", "letter_ratio", "special_char_ratio", "path_to_url_ratio",
    "domain_name_length", "domain_has_digits", "has_consecutive_consonants", "unique_char_ratio",
    "suspicious_param_count", "length_variability", "word_boundary_count", "suspicious_combo_count",
    "has_ssl_indicator", "has_mixed_case", "has_suspicious_hash", "has_traversal_pattern",
    "has_malicious_path", "fragment_length", "has_fragment",
]

# The first ten (XU1-XU10): cheap character counts.
URL_COUNT_FEATURES = URL_FEATURES[:10]


def _pop_std(parts_len):
    """Population standard deviation of an array<int>."""
    n = F.size(parts_len).cast("double")
    mean = F.aggregate(parts_len, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(parts_len, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.sqrt(var)


def url_features(df: DataFrame, c: str = "value", only: list[str] | None = None) -> DataFrame:
    u0 = strip_ws(col(c))
    tmp = (df.withColumn("_u", u0)
             .withColumn("_dom", F.lower(urls.netloc(F.col("_u"))))
             .withColumn("_path", urls.path(F.col("_u")))
             .withColumn("_q", urls.query(F.col("_u")))
             .withColumn("_frag", urls.fragment(F.col("_u"))))
    u, dom, path, q, frag = (F.col(x) for x in ("_u", "_dom", "_path", "_q", "_frag"))
    tmp = tmp.withColumn("_tld", F.when(F.contains(dom, F.lit(".")), F.element_at(F.split(dom, r"\."), -1)).otherwise(F.lit("")))
    tmp = tmp.withColumn("_dn", F.when(F.contains(dom, F.lit(".")), F.regexp_replace(dom, r"\.[^.]*$", "")).otherwise(dom))
    tld, dn = F.col("_tld"), F.col("_dn")
    length = F.length(u)
    digits = count_re(u, r"\p{Nd}")
    letters = count_re(u, r"\p{L}")
    special = count_re(u, r"[^\p{L}\p{N}]")
    hexc = count_re(u, r"%[0-9a-fA-F]{2}")
    sub = F.greatest(F.lit(0), F.size(F.split(dom, r"\.", -1)) - 2)
    plen = F.length(path)
    parts_len = F.transform(F.split(u, "/", -1), lambda p: F.length(p))
    combos = sum((count_sub(u, s) for s in SYMBOL_COMBOS), F.lit(0))
    feats = {
        "url_length": length,
        "num_dots": count_sub(u, "."),
        "num_hyphens": count_sub(u, "-"),
        "num_underscores": count_sub(u, "_"),
        "num_slashes": count_sub(u, "/"),
        "num_questionmarks": count_sub(u, "?"),
        "num_ampersands": count_sub(u, "&"),
        "num_equals": count_sub(u, "="),
        "num_at": count_sub(u, "@"),
        "num_percent": count_sub(u, "%"),
        "has_https": flag(u.startswith("https")),
        "has_http": flag(u.startswith("http")),
        "has_ftp": flag(F.contains(u, F.lit("ftp://"))),
        "domain_length": F.length(dom),
        "path_length": plen,
        "path_depth": count_sub(path, "/"),
        "query_length": F.length(q),
        "num_params": F.when(F.contains(q, F.lit("&")), count_sub(q, "&") + 1).when(q != "", 1).otherwise(0),
        "tld_length": F.length(tld),
        "has_common_tld": flag(tld.isin(*URL_COMMON_TLDS)),
        "has_new_tld": flag(tld.isin(*NEW_TLDS)),
        "has_suspicious_tld": flag(tld.isin(*SUSPICIOUS_TLDS)),
        "tld_is_numeric": flag(tld.rlike(r"^\p{Nd}+$")),
        "subdomain_count": sub,
        "has_subdomain": flag(sub > 0),
        "digit_count": digits,
        "letter_count": letters,
        "special_char_count": special,
        "url_entropy": entropy(u),
        "domain_entropy": entropy(dom),
        "suspicious_keyword_count": count_contained(F.lower(u), URL_KEYWORDS),
        "has_ip_address": flag(u.rlike(r"\b(?:\d{1,3}\.){3}\d{1,3}\b")),
        "hex_char_count": hexc,
        "has_repetitive_chars": flag(u.rlike(r"(?s)(.)\1\1")),
        "is_shortened": flag(contains_any(dom, SHORTENERS)),
        "has_port": flag(u.rlike(r":\d{2,5}/")),
        "has_executable_extension": flag(contains_any(F.lower(u), EXECUTABLE_EXTENSIONS)),
        "encoded_char_ratio": ratio(hexc, length),
        "digit_ratio": ratio(digits, length),
        "letter_ratio": ratio(letters, length),
        "special_char_ratio": ratio(special, length),
        "path_to_url_ratio": ratio(plen, length),
        "domain_name_length": F.length(dn),
        "domain_has_digits": flag(dn.rlike(r"\p{Nd}")),
        "has_consecutive_consonants": flag(F.lower(dn).rlike(f"[{CONSONANTS}]{{4}}")),
        "unique_char_ratio": unique_ratio(u),
        "suspicious_param_count": count_contained(F.lower(q), QUERY_WORDS),
        "length_variability": F.when(F.contains(u, F.lit("/")), _pop_std(parts_len)).otherwise(F.lit(0.0)),
        "word_boundary_count": count_re(u, "[a-z][A-Z]|[A-Z][a-z]|[a-zA-Z][0-9]|[0-9][a-zA-Z]"),
        "suspicious_combo_count": combos,
        "has_ssl_indicator": flag(F.contains(F.lower(u), F.lit("https://")) | F.contains(u, F.lit(":443"))),
        "has_mixed_case": flag(u.rlike(r"\p{Lu}") & u.rlike(r"\p{Ll}")),
        "has_suspicious_hash": flag(u.rlike("[0-9a-fA-F]{16,}")),
        "has_traversal_pattern": flag(contains_any(u, TRAVERSAL_PATTERNS)),
        "has_malicious_path": flag(contains_any(F.lower(path), MALICIOUS_PATHS)),
        "fragment_length": F.length(frag),
        "has_fragment": flag(F.length(frag) > 0),
    }
    keep = only or list(feats)
    return tmp.select(*df.columns, *[feats[k].alias(k) for k in keep])
