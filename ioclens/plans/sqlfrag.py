"""DuckDB SQL fragments for oracles, built from the same pattern constants
as the Spark expressions (oracle side only)."""

from __future__ import annotations

from ..functions import normalize as N
from ..functions import urls as U


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    # white space of any script: the oracle's \s is ASCII only
    ws = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    return f"regexp_replace({x}, '^{ws}+|{ws}+$', '', 'g')"


def cnt(x: str, sub: str) -> str:
    return f"cast((length({x}) - length(replace({x}, {q(sub)}, ''))) // {len(sub)} AS integer)"


def rc(x: str, pattern: str) -> str:
    return f"cast(len(regexp_extract_all({x}, {q(pattern)})) AS integer)"


def b(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def has_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def n_contained(x: str, words) -> str:
    return "(" + " + ".join(b(f"contains({x}, {q(w)})") for w in words) + ")"


def ratio(a: str, n: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN cast({a} AS double) / {n} ELSE 0.0 END)"


def entropy(x: str) -> str:
    """Entropy of lower-cased characters with list lambdas."""
    s = f"lower({x})"
    return (f"(CASE WHEN length({x}) > 1 THEN (SELECT -sum(p * log2(p)) FROM (SELECT count(*) / length({s}) AS p "
            f"FROM unnest(string_split({s}, '')) AS ch(c) GROUP BY c)) ELSE 0.0 END)")


def unique_ratio(x: str) -> str:
    return f"(CASE WHEN length({x}) > 0 THEN cast(len(list_distinct(string_split(lower({x}), ''))) AS double) / length({x}) ELSE 0.0 END)"


def url_norm(v: str) -> str:
    sch = f"lower(regexp_extract({v}, {q(U.SCHEME_RE)}, 1))"
    loc = f"lower(regexp_extract({v}, {q(U.AUTH_RE)}, 1))"
    port = f"regexp_extract({loc}, ':([^:]*)$', 1)"
    host = f"regexp_replace({loc}, ':[^:]*$', '')"
    loc2 = (f"(CASE WHEN contains({loc}, ':') AND (({sch} = 'http' AND {port} = '80') OR ({sch} = 'https' AND {port} = '443')) "
            f"THEN {host} ELSE {loc} END)")
    rp = f"regexp_extract({v}, {q(U.REST_RE)}, 1)"
    path = f"regexp_replace(regexp_replace({rp}, ';[^/]*$', ''), '/+$', '')"
    prm = f"regexp_extract({rp}, ';([^/]*)$', 1)"
    qu = f"regexp_extract({v}, {q(U.REST_RE)}, 3)"
    fr = f"regexp_extract({v}, {q(U.REST_RE)}, 5)"
    return (f"concat({sch}, '://', {loc2}, {path}, CASE WHEN {prm} <> '' THEN ';' || {prm} ELSE '' END, "
            f"CASE WHEN {qu} <> '' THEN '?' || {qu} ELSE '' END, CASE WHEN {fr} <> '' THEN '#' || {fr} ELSE '' END)")


def normalized_raw_inputs(source: str = "raw_inputs", keep: str = "origin, ref_id, pos", hint: str | None = None) -> str:
    """CTE body: inputs with given or detected type, normal form and reject
    reason.  IPv6 texts are taken as they are, so they must be canonical."""
    v = "v"
    detect = (f"CASE WHEN regexp_matches({v}, {q(N.DETECT_IP_RE)}) THEN 'ip' "
              f"WHEN regexp_matches(lower({v}), {q(N.URL_PREFIX_RE)}) THEN 'url' "
              f"WHEN regexp_matches({v}, {q(N.HASH_RE)}) THEN 'hash' ELSE 'domain' END")
    given = f"coalesce({hint}, {detect})" if hint else detect
    v6 = f" WHEN contains({v}, ':') THEN {v}" if hint else ""
    odd = "WHEN t NOT IN ('ip', 'domain', 'url', 'hash', 'network') THEN 'unsupported_type:' || t " if hint else ""
    hinted = f", {hint}" if hint else ""
    norm = (f"CASE WHEN t = 'ip' THEN (CASE WHEN regexp_matches({v}, {q(N.VALID_IPV4_RE)}) THEN {v}{v6} END) "
            f"WHEN t = 'domain' THEN (CASE WHEN length({v}) <= 253 AND regexp_matches({v}, {q(N.DOMAIN_RE)}) THEN lower({v}) END) "
            f"WHEN t = 'url' THEN (CASE WHEN regexp_matches({v}, {q(U.VALID_URL_RE)}) THEN {url_norm(v)} END) "
            f"WHEN t = 'hash' THEN (CASE WHEN regexp_matches({v}, {q(N.HASH_RE)}) THEN lower({v}) END) END")
    return f"""SELECT {keep}, original, t AS type, n AS value,
       CASE WHEN original IS NULL OR v = '' THEN 'empty_value'
            {odd}WHEN n IS NULL THEN 'invalid_' || t END AS reject_reason
FROM (SELECT *, {norm} AS n FROM (SELECT *, {given} AS t FROM (
      SELECT {keep}{hinted}, value AS original, {strip("replace(value, '[.]', '.')")} AS v FROM {source}) AS s0) AS s1) AS s2"""
