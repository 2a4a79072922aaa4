"""Feature-extraction queries (X-URL, X-DOM, X-IP, X-HASH, X-NET, X-NETTXT)
over whole tables; every double leaves rounded to 6 places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import (CONSONANTS, DOMAIN_COMMON_TLDS, DOMAIN_WORDS, EXECUTABLE_EXTENSIONS,
                         IP_BOUNDARY_ENDS, IP_SUSPICIOUS_ENDS, MALICIOUS_PATHS, NEW_TLDS, QUERY_WORDS,
                         SHORTENERS, SUSPICIOUS_TLDS, SYMBOL_COMBOS, TRAVERSAL_PATTERNS, URL_COMMON_TLDS,
                         URL_KEYWORDS)
from ..functions import urls as U
from ..functions.domain import DOMAIN_FEATURES, domain_features
from ..functions.hashes import HASH_FEATURES, hash_features
from ..functions.ipv4 import IP_FEATURES, ip_features
from ..functions.network import NETWORK_FEATURES, network_features, network_text_flows
from ..functions.urlfeat import URL_FEATURES, url_features
from ..sources import views
from ..sources.tables import table
from . import sqlfrag as S
from .common import accepted, r6
from .ingest import NORM
from .registry import query


def _round_doubles(df, names):
    types = dict(df.dtypes)
    return df.select(*[r6(c).alias(c) if (c in names and types[c] in ("double", "float")) else F.col(c) for c in df.columns])


def _isin(x, vals):
    return "(" + x + " IN (" + ", ".join(S.q(v) for v in vals) + "))"


def _triple(x, tail: int) -> str:
    """Any i with x[i] = x[i+1] = x[i+2], i over 1..len-2-tail."""
    return (f"coalesce(list_bool_or(list_transform(range(1, length({x}) - 1 - {tail}), "
            f"lambda i: substring({x}, i, 1) = substring({x}, i + 1, 1) AND substring({x}, i + 1, 1) = substring({x}, i + 2, 1))), false)")


def _r6(e):
    return f"round(cast({e} AS double), 6)"


# ------------------------------------------------------------------ URL
def _url_sql():
    u, dom, path, qq, frag, tld, dn = "u", "dom", "path", "qq", "frag", "tld", "dn"
    length = f"length({u})"
    digits, letters = S.rc(u, r"\p{Nd}"), S.rc(u, r"\p{L}")
    special, hexc = S.rc(u, r"[^\p{L}\p{N}]"), S.rc(u, r"%[0-9a-fA-F]{2}")
    sub = f"greatest(0, len(string_split({dom}, '.')) - 2)"
    combos = " + ".join(S.cnt(u, s) for s in SYMBOL_COMBOS)
    f = {
        "url_length": length,
        "num_dots": S.cnt(u, "."), "num_hyphens": S.cnt(u, "-"), "num_underscores": S.cnt(u, "_"),
        "num_slashes": S.cnt(u, "/"), "num_questionmarks": S.cnt(u, "?"), "num_ampersands": S.cnt(u, "&"),
        "num_equals": S.cnt(u, "="), "num_at": S.cnt(u, "@"), "num_percent": S.cnt(u, "%"),
        "has_https": S.b(f"starts_with({u}, 'https')"), "has_http": S.b(f"starts_with({u}, 'http')"),
        "has_ftp": S.b(f"contains({u}, 'ftp://')"),
        "domain_length": f"length({dom})", "path_length": f"length({path})", "path_depth": S.cnt(path, "/"),
        "query_length": f"length({qq})",
        "num_params": f"(CASE WHEN contains({qq}, '&') THEN {S.cnt(qq, '&')} + 1 WHEN {qq} <> '' THEN 1 ELSE 0 END)",
        "tld_length": f"length({tld})",
        "has_common_tld": S.b(_isin(tld, URL_COMMON_TLDS)), "has_new_tld": S.b(_isin(tld, NEW_TLDS)),
        "has_suspicious_tld": S.b(_isin(tld, SUSPICIOUS_TLDS)),
        "tld_is_numeric": S.b(f"regexp_matches({tld}, '^\\p{{Nd}}+$')"),
        "subdomain_count": sub, "has_subdomain": S.b(f"{sub} > 0"),
        "digit_count": digits, "letter_count": letters, "special_char_count": special,
        "url_entropy": _r6(S.entropy(u)), "domain_entropy": _r6(S.entropy(dom)),
        "suspicious_keyword_count": S.n_contained(f"lower({u})", URL_KEYWORDS),
        "has_ip_address": S.b(f"regexp_matches({u}, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b')"),
        "hex_char_count": hexc,
        "has_repetitive_chars": S.b(_triple(u, 0)),
        "is_shortened": S.b(S.has_any(dom, SHORTENERS)),
        "has_port": S.b(f"regexp_matches({u}, ':\\d{{2,5}}/')"),
        "has_executable_extension": S.b(S.has_any(f"lower({u})", EXECUTABLE_EXTENSIONS)),
        "encoded_char_ratio": _r6(S.ratio(hexc, length)), "digit_ratio": _r6(S.ratio(digits, length)),
        "letter_ratio": _r6(S.ratio(letters, length)), "special_char_ratio": _r6(S.ratio(special, length)),
        "path_to_url_ratio": _r6(S.ratio(f"length({path})", length)),
        "domain_name_length": f"length({dn})", "domain_has_digits": S.b(f"regexp_matches({dn}, '\\p{{Nd}}')"),
        "has_consecutive_consonants": S.b(f"regexp_matches(lower({dn}), '[{CONSONANTS}]{{4}}')"),
        "unique_char_ratio": _r6(S.unique_ratio(u)),
        "suspicious_param_count": S.n_contained(f"lower({qq})", QUERY_WORDS),
        "length_variability": _r6(f"(CASE WHEN contains({u}, '/') THEN (SELECT stddev_pop(length(p)) FROM unnest(string_split({u}, '/')) AS sp(p)) ELSE 0.0 END)"),
        "word_boundary_count": S.rc(u, "[a-z][A-Z]|[A-Z][a-z]|[a-zA-Z][0-9]|[0-9][a-zA-Z]"),
        "suspicious_combo_count": f"({combos})",
        "has_ssl_indicator": S.b(f"contains(lower({u}), 'https://') OR contains({u}, ':443')"),
        "has_mixed_case": S.b(f"regexp_matches({u}, '\\p{{Lu}}') AND regexp_matches({u}, '\\p{{Ll}}')"),
        "has_suspicious_hash": S.b(f"regexp_matches({u}, '[0-9a-fA-F]{{16,}}')"),
        "has_traversal_pattern": S.b(S.has_any(u, TRAVERSAL_PATTERNS)),
        "has_malicious_path": S.b(S.has_any(f"lower({path})", MALICIOUS_PATHS)),
        "fragment_length": f"length({frag})", "has_fragment": S.b(f"length({frag}) > 0"),
    }
    assert list(f) == URL_FEATURES
    parts = f"""p AS (SELECT origin, ref_id, value, value AS u, lower(regexp_extract(value, {S.q(U.AUTH_RE)}, 1)) AS dom,
       regexp_replace(regexp_extract(value, {S.q(U.REST_RE)}, 1), ';[^/]*$', '') AS path,
       regexp_extract(value, {S.q(U.REST_RE)}, 3) AS qq, regexp_extract(value, {S.q(U.REST_RE)}, 5) AS frag
       FROM norm WHERE type = 'url' AND reject_reason IS NULL),
p2 AS (SELECT *, CASE WHEN contains(dom, '.') THEN string_split(dom, '.')[-1] ELSE '' END AS tld,
       CASE WHEN contains(dom, '.') THEN regexp_replace(dom, '\\.[^.]*$', '') ELSE dom END AS dn FROM p)"""
    sel = ",\n       ".join(f"{e} AS {k}" for k, e in f.items())
    return f"WITH {NORM},\n{parts}\nSELECT origin, ref_id, value,\n       {sel}\nFROM p2"


@query("url_features", _url_sql())
def q_url_features(spark, sf_dir):
    """X-URL: the 56 URL features for every accepted URL input."""
    u = accepted(spark, sf_dir, "url").select("origin", "ref_id", "value")
    return _round_doubles(url_features(u, "value"), URL_FEATURES)


# ---------------------------------------------------------------- domain
def _domain_sql():
    d, tld, nm = "d", "tld", "nm"
    length = f"length({d})"
    digits, letters = S.rc(d, r"\p{Nd}"), S.rc(d, r"\p{L}")
    vowels = S.rc(f"lower({d})", "[aeiou]")
    dots = S.cnt(d, ".")
    sub = f"greatest(0, {dots} - 1)"
    f = {
        "domain_length": length, "num_dots": dots, "num_hyphens": S.cnt(d, "-"), "num_underscores": S.cnt(d, "_"),
        "has_digits": S.b(f"{digits} > 0"), "digit_count": digits, "letter_count": letters, "vowel_count": vowels,
        "consonant_count": S.rc(f"lower({d})", f"[{CONSONANTS}]"),
        "has_common_tld": S.b(_isin(tld, DOMAIN_COMMON_TLDS)), "has_new_tld": S.b(_isin(tld, NEW_TLDS)),
        "has_suspicious_tld": S.b(_isin(tld, SUSPICIOUS_TLDS)), "tld_length": f"length({tld})",
        "tld_is_numeric": S.b(f"regexp_matches({tld}, '^\\p{{Nd}}+$')"), "name_length": f"length({nm})",
        "starts_with_digit": S.b(f"regexp_matches({nm}, '^\\p{{Nd}}')"),
        "has_4plus_consonants": S.b(f"regexp_matches(lower({nm}), '[{CONSONANTS}]{{4}}')"),
        "has_suspicious_pattern": S.b(S.has_any(f"lower({nm})", DOMAIN_WORDS)),
        "entropy": _r6(S.entropy(nm)), "vowel_ratio": _r6(S.ratio(vowels, letters)),
        "digit_ratio": _r6(S.ratio(digits, length)), "letter_ratio": _r6(S.ratio(letters, length)),
        "subdomain_count": sub, "has_subdomain": S.b(f"{sub} > 0"),
        "unique_char_ratio": _r6(S.unique_ratio(nm)),
        "has_repetitive_chars": S.b(_triple(f"lower({nm})", 1)),
        "has_mixed_case": S.b(f"regexp_matches({d}, '\\p{{Lu}}') AND regexp_matches({d}, '\\p{{Ll}}')"),
        "has_consecutive_special": S.b(f"regexp_matches({d}, '[-_]{{2}}')"),
        "is_short_with_new_tld": S.b(f"length({nm}) <= 5 AND {_isin(tld, NEW_TLDS)}"),
    }
    assert list(f) == DOMAIN_FEATURES
    sel = ",\n       ".join(f"{e} AS {k}" for k, e in f.items())
    return f"""WITH {NORM},
p AS (SELECT origin, ref_id, value, lower({S.strip('value')}) AS d FROM norm WHERE type = 'domain' AND reject_reason IS NULL),
p2 AS (SELECT *, CASE WHEN contains(d, '.') THEN string_split(d, '.')[-1] ELSE '' END AS tld,
       CASE WHEN contains(d, '.') THEN regexp_replace(d, '\\.[^.]*$', '') ELSE d END AS nm FROM p)
SELECT origin, ref_id, value,
       {sel}
FROM p2"""


@query("domain_features", _domain_sql())
def q_domain_features(spark, sf_dir):
    """X-DOM: domain features for every accepted domain input (page hosts)."""
    d = accepted(spark, sf_dir, "domain").select("origin", "ref_id", "value")
    return _round_doubles(domain_features(d, "value"), DOMAIN_FEATURES)


# ------------------------------------------------------------------- IPv4
def _ip_sql():
    o = [f"o{i}" for i in range(1, 5)]
    o1, o2, o3, o4 = o
    s = f"({o1} + {o2} + {o3} + {o4})"
    mean = f"({s} / 4)"
    std = f"sqrt((({o1} - {mean})^2 + ({o2} - {mean})^2 + ({o3} - {mean})^2 + ({o4} - {mean})^2) / 3)"
    ent = (f"(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / 4.0 AS p FROM unnest([{o1}, {o2}, {o3}, {o4}]) AS t(x) GROUP BY x))")
    fl = lambda c: S.b(c)
    f = {
        "octet1": o1, "octet2": o2, "octet3": o3, "octet4": o4,
        "ip_int": f"cast({o1} * 16777216 + {o2} * 65536 + {o3} * 256 + {o4} AS bigint)",
        "is_class_a": fl(f"{o1} <= 127"), "is_class_b": fl(f"{o1} >= 128 AND {o1} <= 191"),
        "is_class_c": fl(f"{o1} >= 192 AND {o1} <= 223"),
        "is_private": fl(f"{o1} = 10 OR ({o1} = 172 AND {o2} >= 16 AND {o2} <= 31) OR ({o1} = 192 AND {o2} = 168)"),
        "is_loopback": fl(f"{o1} = 127"), "is_link_local": fl(f"{o1} = 169 AND {o2} = 254"),
        "is_multicast": fl(f"{o1} >= 224 AND {o1} <= 239"), "is_reserved": fl(f"{o1} >= 240 AND {o1} <= 255"),
        "is_test_net": fl(f"({o1} = 192 AND {o2} = 0 AND {o3} = 2) OR ({o1} = 198 AND {o2} = 51 AND {o3} = 100) OR ({o1} = 203 AND {o2} = 0 AND {o3} = 113)"),
        "octet_sum": s, "octet_mean": _r6(mean), "octet_std": _r6(std),
        "octet1_high_bit": fl(f"{o1} >= 128"), "octet4_low_bit": fl(f"{o4} < 128"),
        "octets_equal": fl(f"{o1} = {o2} AND {o2} = {o3} AND {o3} = {o4}"),
        "has_consecutive_octets": fl(f"{o1} + 1 = {o2} OR {o2} + 1 = {o3} OR {o3} + 1 = {o4}"),
        "has_zero_octet": fl(f"{o1} = 0 OR {o2} = 0 OR {o3} = 0 OR {o4} = 0"),
        "has_255_octet": fl(f"{o1} = 255 OR {o2} = 255 OR {o3} = 255 OR {o4} = 255"),
        "has_suspicious_end": fl(f"{o4} IN ({', '.join(str(x) for x in IP_SUSPICIOUS_ENDS)})"),
        "octet_entropy": _r6(ent),
        "is_european_range": fl(f"{o1} >= 77 AND {o1} <= 95"), "is_asian_range": fl(f"{o1} >= 58 AND {o1} <= 61"),
        "is_american_range": fl(f"{o1} >= 3 AND {o1} <= 56"),
        "octet1_binary_ones": f"cast(bit_count(cast({o1} AS integer)) AS integer)",
        "octet4_binary_ones": f"cast(bit_count(cast({o4} AS integer)) AS integer)",
        "octet_ratio_1_4": _r6(f"(CASE WHEN {o4} > 0 THEN {o1} / {o4} ELSE 0.0 END)"),
        "octet_diff_1_4": f"abs({o1} - {o4})",
        "is_sequential_up": fl(f"{o1} < {o2} AND {o2} < {o3} AND {o3} < {o4}"),
        "is_sequential_down": fl(f"{o1} > {o2} AND {o2} > {o3} AND {o3} > {o4}"),
        "is_network_boundary": fl(f"{o4} IN ({', '.join(str(x) for x in IP_BOUNDARY_ENDS)})"),
    }
    assert list(f) == IP_FEATURES
    sel = ",\n       ".join(f"{e} AS {k}" for k, e in f.items())
    octs = ", ".join(f"cast(split_part(value, '.', {i}) AS double) AS o{i}" for i in range(1, 5))
    return f"""WITH {NORM},
p AS (SELECT ref_id, pos, value, {octs} FROM norm WHERE type = 'ip' AND reject_reason IS NULL)
SELECT ref_id, pos, value,
       {sel}
FROM p"""


@query("ip_features", _ip_sql())
def q_ip_features(spark, sf_dir):
    """X-IP: IPv4 features for every valid dotted quad found in documents."""
    d = accepted(spark, sf_dir, "ip").select("ref_id", "pos", "value")
    return _round_doubles(ip_features(d, "value"), IP_FEATURES)


# ------------------------------------------------------------------- hash
def _hash_sql():
    h = "h"
    n = f"length({h})"
    maxrun = (f"list_max(list_transform(range(1, {n} + 1), lambda i: list_max(list_transform(range(1, {n} - i + 2), "
              f"lambda k: CASE WHEN substring({h}, i, k) = repeat(substring({h}, i, 1), k) THEN k ELSE 0 END))))")
    trans = (f"len(list_filter(range(1, {n}), lambda i: regexp_matches(substring({h}, i, 1), '[0-9]') <> "
             f"regexp_matches(substring({h}, i + 1, 1), '[0-9]')))")
    f = {
        "length": n, "is_hex": S.b(f"regexp_matches({h}, '^[0-9a-f]+$')"), "entropy": _r6(S.entropy(h)),
        "unique_ratio": _r6(S.unique_ratio(h)),
        "digit_ratio": _r6(f"(CASE WHEN {n} > 0 THEN {S.rc(h, '[0-9]')} / {n} ELSE 0.0 END)"),
        "letter_ratio": _r6(f"(CASE WHEN {n} > 0 THEN {S.rc(h, '\\p{L}')} / {n} ELSE 0.0 END)"),
        "max_run": f"cast(coalesce({maxrun}, 1) AS integer)",
        "transition_ratio": _r6(f"(CASE WHEN {n} > 1 THEN {trans} / ({n} - 1) ELSE 0.0 END)"),
    }
    assert list(f) == HASH_FEATURES
    sel = ",\n       ".join(f"{e} AS {k}" for k, e in f.items())
    return f"""WITH {NORM},
p AS (SELECT ref_id, pos, value, lower({S.strip('value')}) AS h FROM norm WHERE type = 'hash' AND reject_reason IS NULL)
SELECT ref_id, pos, value,
       {sel}
FROM p"""


@query("hash_features", _hash_sql())
def q_hash_features(spark, sf_dir):
    """X-HASH: hash features for every MD5/SHA1/SHA256 digest in documents."""
    d = accepted(spark, sf_dir, "hash").select("ref_id", "pos", "value")
    return _round_doubles(hash_features(d, "value"), HASH_FEATURES)


# ---------------------------------------------------------------- network
def _net_sql(src: str, keys: str):
    e = "0.001"
    pk, by, du, co = "cast(packet_count AS double)", "cast(bytes_transferred AS double)", "cast(duration_seconds AS double)", "cast(connection_count AS double)"
    fa = "coalesce(cast(failed_connections AS double), 0.0)"
    pps, bps, aps, cps, fr = f"({pk} / ({du} + {e}))", f"({by} / ({du} + {e}))", f"({by} / ({pk} + {e}))", f"({co} / ({du} + {e}))", f"({fa} / ({co} + {e}))"
    f = {
        "packets_per_second": pps, "bytes_per_second": bps, "avg_packet_size": aps, "connections_per_second": cps,
        "failure_rate": fr, "packets_per_connection": f"({pk} / ({co} + {e}))", "bytes_per_packet": aps,
        "traffic_burstiness": f"({pps} * {bps} / 1000)", "session_duration_norm": f"ln(1 + {du})",
        "packet_size_variability": f"({aps} / ({aps} + {e}))", "success_rate": f"(1 - {fr})",
        "traffic_intensity_score": f"({pps} * {bps} * {cps} / 1000000)",
    }
    assert list(f) == NETWORK_FEATURES
    sel = ",\n       ".join(f"{_r6(x)} AS {k}" for k, x in f.items())
    return f"SELECT {keys}, packet_count, bytes_transferred, {_r6('duration_seconds')} AS duration_seconds, connection_count, failed_connections,\n       {sel}\nFROM {src}"


@query("network_features", _net_sql("flow", "l_orderkey, l_linenumber, is_anomalous"))
def q_network_features(spark, sf_dir):
    """X-NET: flow features for every flow row."""
    f = views.flow(spark, sf_dir)
    out = network_features(f).select("l_orderkey", "l_linenumber", "is_anomalous", "packet_count", "bytes_transferred",
                                     "duration_seconds", "connection_count", "failed_connections", *NETWORK_FEATURES)
    return _round_doubles(out, NETWORK_FEATURES + ["duration_seconds"])


def _nettxt_sql():
    t = "lower(text)"
    high = S.has_any(t, ["high", "large"])
    fail = S.has_any(t, ["failed", "error", "anomaly"])
    scan = f"(contains({t}, 'port') AND contains({t}, 'scan'))"
    tun = S.has_any(t, ["tunnel", "exfil"])
    flows = f"""fl AS (SELECT doc_id,
  cast(CASE WHEN {high} THEN 500 ELSE 100 END AS bigint) AS packet_count,
  cast(CASE WHEN {tun} THEN 1000000 WHEN {high} THEN 250000 ELSE 50000 END AS bigint) AS bytes_transferred,
  cast(CASE WHEN {tun} THEN 60.0 WHEN {scan} THEN 120.0 ELSE 30.0 END AS double) AS duration_seconds,
  cast(CASE WHEN {scan} THEN 50 WHEN {fail} THEN 8 ELSE 5 END AS bigint) AS connection_count,
  cast(CASE WHEN {scan} THEN 45 WHEN {fail} THEN 3 ELSE 0 END AS bigint) AS failed_connections
FROM documents WHERE length({S.strip('text')}) >= 3)"""
    return "WITH " + flows + "\n" + _net_sql("fl", "doc_id")


@query("network_text_features", _nettxt_sql())
def q_network_text_features(spark, sf_dir):
    """X-NETTXT: descriptive texts (whole documents, >= 3 chars) -> flow
    defaults (XN13) -> flow features."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.where(F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) >= 3)
    out = network_features(network_text_flows(d, "text")).drop("text")
    return _round_doubles(out, NETWORK_FEATURES + ["duration_seconds"])


def _explain_sql():
    from .ingest import FALLBACK_SQL
    lines = ["'subject: url indicator'", "'type: ' || type", "'value: ' || value", "'source: -'", "'first_seen: -'", "'last_seen: -'",
             "'model: fallback'", "'verdict: unknown'", "'confidence: 0.5000 (50.0%)'",
             "'feature url_length: ' || cast(url_length AS varchar)",
             "'feature suspicious_keyword_count: ' || cast(suspicious_keyword_count AS varchar)",
             "'outcome: undecided'", "'advice: collect_more_evidence'"]
    kw = S.n_contained("lower(value)", URL_KEYWORDS)
    return f"""WITH {NORM},
u AS (SELECT origin, ref_id, type, value, length(value) AS url_length, {kw} AS suspicious_keyword_count
      FROM norm WHERE type = 'url' AND reject_reason IS NULL)
SELECT origin, ref_id, value, 'fallback' AS model_name, 'unknown' AS prediction, 0.5 AS confidence,
  {FALLBACK_SQL('type', 'value')} AS risk_score,
  concat_ws(chr(10), {', '.join(lines)}) AS explanation,
  '{{"ioc_type":"' || type || '","value":"' || value || '","model_used":"fallback","confidence":0.5,"url_length":'
    || cast(url_length AS varchar) || ',"suspicious_keyword_count":' || cast(suspicious_keyword_count AS varchar) || '}}' AS features_used
FROM u"""


@query("url_prediction_texts", _explain_sql())
def url_prediction_texts(spark, sf_dir):
    """M14/E7/XG11/R6: fallback predictions for URL indicators (no URL model
    is trained on this data) with the text explanation and the
    features-used JSON."""
    from ..functions.risk import fallback_score
    from ..operators.explain import features_json, text_explanation
    u = accepted(spark, sf_dir, "url").select("origin", "ref_id", "type", "value")
    f = url_features(u, "value", only=["url_length", "suspicious_keyword_count"])
    f = f.select("*", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("first_seen"),
                 F.lit(None).cast("string").alias("last_seen"), F.lit("fallback").alias("model_name"),
                 F.lit("unknown").alias("prediction"), F.lit(0.5).alias("confidence"),
                 fallback_score("type", "value").alias("risk_score"))
    t = text_explanation(f, [("url_length", False), ("suspicious_keyword_count", False)], "url")
    fj = features_json(["ioc_type", "value", "model_used", "confidence", "url_length", "suspicious_keyword_count"])
    t = t.withColumn("ioc_type", F.col("type")).withColumn("model_used", F.lit("fallback"))
    return t.select("origin", "ref_id", "value", "model_name", "prediction", "confidence", "risk_score", "explanation",
                    fj.alias("features_used"))


def _mixed(spark, sf_dir):
    """Distinct accepted indicators of all types; whole documents are the
    network descriptions.  ``id``: digest of the value."""
    texts = table(spark, sf_dir, "documents").select(F.lit("network").alias("type"), F.col("text").alias("value"))
    texts = texts.where(F.length(F.regexp_replace("value", r"^\s+|\s+$", "")) >= 3)
    rows = accepted(spark, sf_dir).select("type", "value").unionByName(texts).distinct()
    return rows.select(F.md5(F.col("value").cast("binary")).alias("id"), "type", "value")


def _long_sql(type_, sql, keys, id_="md5(value)"):
    return f"""SELECT DISTINCT {id_} AS id, '{type_}' AS type, feature, round(x, 6) AS x FROM (
  UNPIVOT (SELECT {keys}, COLUMNS(* EXCLUDE ({keys}))::double FROM ({sql}) q) ON COLUMNS(* EXCLUDE ({keys})) INTO NAME feature VALUE x) u"""


@query("route_features", "\nUNION ALL ".join([
    _long_sql("url", _url_sql(), "origin, ref_id, value"), _long_sql("domain", _domain_sql(), "origin, ref_id, value"),
    _long_sql("ip", _ip_sql(), "ref_id, pos, value"), _long_sql("hash", _hash_sql(), "ref_id, pos, value"),
    _long_sql("network", _nettxt_sql(), "doc_id", "(SELECT md5(text) FROM documents d WHERE d.doc_id = u.doc_id)")]))
def route_features(spark, sf_dir):
    """X-ANY: every distinct indicator through the extractor of its type."""
    from ..operators.routing import long_features, route
    return long_features(route(_mixed(spark, sf_dir))).withColumn("x", r6("x"))
