"""Rule bitmask ledger: every quality rule is evaluated once per document;
its failure bit and its measurements are stored, and versioned policies are
masks over the stored bits.

``ledger`` is a single pass of SQL expressions (no Python, no shuffle).
``apply_policy`` and ``ablation`` work on stored ledgers alone, so a policy
can change without reading a text again.

Defined results: a null or empty text has no words and fails ``few_words``;
null ids stay null; repeated rows are judged one by one; an empty table
gives an empty ledger.  The input row is kept whole in the struct ``doc``,
so its columns never clash with the measurements.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS

SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over MEASURES."""
    bit: int
    name: str
    fails: str


#: The first two rules are fixed; the others are this policy's own.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "capitals", "100 * n_upper > 50 * word_chars"),
)
BASE_MASK = 0b11
#: Policy version -> rules whose failure rejects a document.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "capitals"),
}
CURRENT_POLICY = 2


def policy_mask(version: int) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[version])


def _repeat_words() -> Column:
    """Words covered by 3-word windows that occur at least twice, from the
    ascending start positions ``dup_at`` of those windows."""
    step = F.transform("dup_at", lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get("dup_at", k - F.lit(1)), p - F.lit(3))))
    return F.aggregate(step, F.lit(0), lambda acc, x: acc + x)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, MEASURES..., fail_bits): one row per input row.

    Windows are compared by 64-bit hashes of their three words.  Only a
    document with a repeated window pays for sorting its windows, so the
    cost is n log n in the words of one document and no document is held in
    more than its own row."""
    body = F.coalesce(F.col("doc")[text], F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.select("doc", F.filter(F.split(body, WS + "+"), lambda w: w != "").alias("words"),
                       F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("full_lines"),
                       (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS + "+", ""))).alias("n_symbols"),
                       F.length(F.regexp_replace(body, "[^A-Z]+", "")).alias("n_upper"),
                       F.size(F.split(body, "\n")).alias("n_lines"))
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - F.lit(3)),
                          lambda i: F.xxhash64(F.get("words", i), F.get("words", i + F.lit(1)), F.get("words", i + F.lit(2))))
    rows = rows.select("doc", "n_symbols", "n_upper", "n_lines", F.size("words").alias("n_words"),
                       F.length(F.array_join("words", "")).alias("word_chars"),
                       (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).alias("n_dup_lines"),
                       F.when(F.size("words") >= 3, windows).alias("windows"))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("placed", F.when(some, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))) \
        .drop("windows")
    same = lambda x, j: F.get("placed", j)["h"].eqNullSafe(x["h"])
    twice = F.filter("placed", lambda x, k: same(x, k - F.lit(1)) | same(x, k + F.lit(1)))
    rows = rows.withColumn("dup_at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("placed")
    rows = rows.withColumn("n_repeat_words", F.coalesce(_repeat_words(), F.lit(0))).drop("dup_at")
    rows = rows.select("doc", *[F.col(m).cast("long").alias(m) for m in MEASURES])
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    rows = rows.withColumn("fail_bits", total.cast("long"))
    # counting the rows also keeps the optimizer from pushing a later filter,
    # and with it copies of every measurement, below the ledger
    return rows.observe(f"ledger-{uuid.uuid4().hex[:8]}", F.count(F.lit(1)).alias("judged"))


def apply_policy(rows: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """Ledger plus ``base_failed`` and ``kept`` under a policy version."""
    hit = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m)) != 0
    return rows.withColumn("base_failed", hit(BASE_MASK)).withColumn("kept", ~hit(BASE_MASK | policy_mask(version)))


def ablation(rows: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """(rule, n_failed, n_only): documents each rule of the policy fails, and
    those that it alone rejects, which leaving it out would admit.

    The ledger first shrinks to one row per bit pattern (at most two to the
    number of rules, whatever the corpus), so no rule costs another scan."""
    mask = policy_mask(version)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    named = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("bit")) for r in RULES if mask >> r.bit & 1])
    each = patterns.select("bits", "n", F.inline(named))
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"),
                                    F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))


def query(docs: DataFrame) -> DataFrame:
    judged = apply_policy(ledger(docs))
    return judged.select(F.col("doc")["doc_id"].alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "fail_bits")


def stage(docs: DataFrame) -> DataFrame:
    """The documents the current policy keeps, with their own columns."""
    return apply_policy(ledger(docs)).where("kept").select("doc.*")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS fl FROM d),
g AS (SELECT doc_id, i, ws[i:i+2] AS gram FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(fl) - len(list_distinct(fl)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             len(string_split(t, chr(10))) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
             + (CASE WHEN 100 * n_upper > 50 * word_chars THEN 64 ELSE 0 END) AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(n_upper AS BIGINT) AS n_upper, CAST(fail_bits AS BIGINT) AS fail_bits
FROM b
"""
