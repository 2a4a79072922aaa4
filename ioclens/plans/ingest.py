"""Ingestion queries: normalise raw inputs, account for rejects, dedupe new
indicators, and the minimum end-to-end slice (URL risk bands)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.risk import fallback_score, risk_band
from ..functions.urlfeat import URL_COUNT_FEATURES, url_features
from ..operators.upsert import new_keys
from ..sources import views
from . import sqlfrag as S
from .common import accepted, normalized_inputs, r6
from .registry import query

NORM = f"norm AS ({S.normalized_raw_inputs()})"


def _fallback_sql(t: str, v: str) -> str:
    from ..constants import FALLBACK_DOMAIN_TLDS, FALLBACK_URL_WORDS
    lv = f"lower({v})"
    url = " + ".join(S.b(f"contains({lv}, {S.q(w)})") for w in FALLBACK_URL_WORDS)
    url += " + " + f"(CASE WHEN regexp_matches({lv}, {S.q(r'\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')}) THEN 2 ELSE 0 END)"
    dom = "3 * (" + " + ".join(S.b(f"ends_with({lv}, {S.q(s)})") for s in FALLBACK_DOMAIN_TLDS) + ")"
    dom += f" + (CASE WHEN len(string_split({lv}, '.')) > 3 THEN 2 ELSE 0 END)"
    hsh = f"(CASE WHEN length({lv}) = 32 THEN 1 WHEN length({lv}) = 64 THEN 2 ELSE 0 END)"
    base = f"(CASE WHEN length({lv}) > 100 THEN 3 WHEN length({lv}) < 5 THEN 1 ELSE 0 END)"
    tenths = (f"{base} + (CASE WHEN {t} = 'url' THEN {url} WHEN {t} = 'domain' THEN {dom} "
              f"WHEN {t} = 'hash' THEN {hsh} ELSE 0 END)")
    return f"cast(least({tenths}, 8) / 10.0 AS decimal(3,2))"


def _band_sql(x: str) -> str:
    return (f"CASE WHEN {x} >= 0.9 THEN 'critical' WHEN {x} >= 0.7 THEN 'high' "
            f"WHEN {x} >= 0.4 THEN 'medium' WHEN {x} IS NOT NULL THEN 'low' END")


FALLBACK_SQL = _fallback_sql
BAND_SQL = _band_sql


# ----------------------------------------------------------- flagship query
@query("url_risk_bands", f"""WITH {NORM},
u AS (SELECT value, {_fallback_sql('type', 'value')} AS risk_score,
             length(value) AS url_length, {S.cnt('value', '.')} AS num_dots,
             {S.cnt('value', '/')} AS num_slashes, {S.cnt('value', '?')} AS num_questionmarks,
             {S.cnt('value', '&')} AS num_ampersands, {S.cnt('value', '=')} AS num_equals
      FROM norm WHERE type = 'url' AND reject_reason IS NULL)
SELECT {_band_sql('risk_score')} AS risk_band, count(*) AS n_urls, count(DISTINCT value) AS n_distinct,
       round(avg(risk_score), 6) AS avg_risk, round(avg(url_length), 6) AS avg_url_length,
       cast(sum(num_dots) AS bigint) AS total_dots, cast(sum(num_slashes) AS bigint) AS total_slashes,
       cast(sum(num_questionmarks) AS bigint) AS total_questionmarks,
       cast(sum(num_ampersands) AS bigint) AS total_ampersands, cast(sum(num_equals) AS bigint) AS total_equals
FROM u GROUP BY 1""")
def url_risk_bands(spark, sf_dir):
    """How many URL indicators fall in each risk band (N1-N16 -> XU1-XU10 ->
    R5 -> R11 -> aggregate)."""
    u = accepted(spark, sf_dir, "url")
    f = url_features(u, "value", only=URL_COUNT_FEATURES)
    f = f.withColumn("risk_score", fallback_score("type", "value")).withColumn("risk_band", risk_band("risk_score"))
    return f.groupBy("risk_band").agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.count_distinct("value").alias("n_distinct"),
        r6(F.avg(F.col("risk_score").cast("double"))).alias("avg_risk"),
        r6(F.avg("url_length")).alias("avg_url_length"),
        F.sum("num_dots").cast("bigint").alias("total_dots"),
        F.sum("num_slashes").cast("bigint").alias("total_slashes"),
        F.sum("num_questionmarks").cast("bigint").alias("total_questionmarks"),
        F.sum("num_ampersands").cast("bigint").alias("total_ampersands"),
        F.sum("num_equals").cast("bigint").alias("total_equals"),
    )


# ------------------------------------------------------------ normalisation
@query("normalize_inputs", f"""WITH {NORM}
SELECT origin, ref_id, pos, original, type, value, reject_reason FROM norm""")
def normalize_all(spark, sf_dir):
    """Every raw input with type, normal form and reject reason."""
    return normalized_inputs(spark, sf_dir).select("origin", "ref_id", "pos", "original", "type", "value", "reject_reason")


@query("ingest_accounting", f"""WITH {NORM}
SELECT type, coalesce(reject_reason, 'accepted') AS outcome, count(*) AS n,
       count(DISTINCT value) AS n_distinct_values
FROM norm GROUP BY 1, 2""")
def ingest_accounting(spark, sf_dir):
    """Accepted and rejected totals with reasons, per type."""
    n = normalized_inputs(spark, sf_dir)
    return (n.groupBy("type", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))
             .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_distinct_values")))


@query("new_iocs", f"""WITH {NORM},
acc AS (SELECT type, value, origin, ref_id, pos FROM norm WHERE reject_reason IS NULL)
SELECT type, value, count(*) AS n_sightings, min(origin || ':' || lpad(cast(ref_id AS varchar), 12, '0')
       || ':' || lpad(cast(pos AS varchar), 6, '0')) AS first_seen_at
FROM acc WHERE NOT EXISTS (SELECT 1 FROM ioc WHERE ioc.type = acc.type AND ioc.value = acc.value)
GROUP BY 1, 2""")
def new_iocs(spark, sf_dir):
    """Dedupe accepted inputs inside the batch on (type, value),
    then keep only keys not already present in the IOC table (anti join)."""
    acc = accepted(spark, sf_dir)
    batch = acc.groupBy("type", "value").agg(
        F.count(F.lit(1)).alias("n_sightings"),
        F.min(F.concat_ws(":", "origin", F.lpad(F.col("ref_id").cast("string"), 12, "0"),
                          F.lpad(F.col("pos").cast("string"), 6, "0"))).alias("first_seen_at"))
    return new_keys(batch, views.ioc(spark, sf_dir), ["type", "value"])
