"""Rule alerts (R12/J13/S8) and cross-source boosting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BOOST_MAX, BOOST_PER_SOURCE
from ..functions.risk import alert_rules


def rule_alerts(iocs: DataFrame, existing_alerts: DataFrame) -> DataFrame:
    """Every (IOC, rule) hit not already alerted for (ioc_id, message).

    The rule table has a handful of rows, fixed by code, so it is broadcast;
    the theta condition becomes an equi-join on type plus a filter."""
    rules = F.broadcast(alert_rules(iocs.sparkSession))
    hits = iocs.join(rules, "type").where(F.col("risk_score") >= F.col("min_risk"))
    hits = hits.select(F.col("id").alias("ioc_id"), "type", F.col("risk_score").cast("double").alias("risk_score"),
                       "rule_name", "severity", "message")
    return hits.join(existing_alerts.select("ioc_id", "message"), ["ioc_id", "message"], "left_anti")


def cross_source_boost(iocs: DataFrame) -> DataFrame:
    """R9 for every sighting: +0.1 per distinct source among the *other*
    sightings of the same (type, value), at most +0.3, capped at 1;
    unchanged when there is no other sighting.  Computed from per-key and
    per-(key, source) counts (map-side combined), no self join of rows."""
    keys = ["type", "value"]
    per_src = iocs.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("_cs"))
    per_key = per_src.groupBy(*keys).agg(F.sum("_cs").alias("_n"), F.count("source").alias("_d"))
    j = iocs.join(per_key, keys).join(per_src.where(F.col("source").isNotNull()), keys + ["source"], "left")
    others = F.col("_d") - F.when(F.col("source").isNotNull() & (F.col("_cs") == 1), 1).otherwise(0)
    base = F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0))
    boosted = F.least(F.lit(1.0), base + F.least(F.lit(BOOST_MAX), others * BOOST_PER_SOURCE))
    return j.select("id", "type", "value", "source", base.alias("risk_score"),
                    F.when(F.col("_n") > 1, others).otherwise(0).alias("other_sources"),
                    F.when(F.col("_n") > 1, boosted).otherwise(base).alias("boosted_score"))


def acknowledge(alerts: DataFrame, updates: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Apply (id, acknowledged, user_id) updates: set or clear who and
    when; returns (alerts, log rows)."""
    u = updates.select("id", F.col("acknowledged").alias("_ack"), F.col("user_id").alias("_by"))
    j = alerts.join(u, "id", "left")
    hit = F.col("_ack").isNotNull()
    out = j.select(*[c for c in alerts.columns if c not in ("acknowledged", "acknowledged_by", "acknowledged_at")],
                   F.when(hit, F.col("_ack")).otherwise(F.col("acknowledged")).alias("acknowledged"),
                   F.when(hit, F.when(F.col("_ack"), F.col("_by"))).otherwise(
                       F.col("acknowledged_by") if "acknowledged_by" in alerts.columns else F.lit(None).cast("long")).alias("acknowledged_by"),
                   F.when(hit, F.when(F.col("_ack"), F.lit(now))).otherwise(
                       F.col("acknowledged_at") if "acknowledged_at" in alerts.columns else F.lit(None).cast("timestamp")).alias("acknowledged_at"))
    logs = updates.join(alerts.select("id"), "id", "left_semi").select(
        F.col("id").alias("alert_id"), F.when(F.col("acknowledged"), "acknowledged").otherwise("unacknowledged").alias("action"),
        "user_id", F.lit(now).alias("timestamp"))
    return out, logs


def create_alerts(requests: DataFrame, iocs: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """New alerts only for existing IOCs (semi join), severity
    defaulting to 'medium'; returns (alerts, 'created' log rows)."""
    ok = requests.join(iocs.select(F.col("id").alias("ioc_id")), "ioc_id", "left_semi")
    a = ok.withColumn("severity", F.coalesce(F.nullif(F.col("severity"), F.lit("")), F.lit("medium"))) \
          .withColumn("acknowledged", F.lit(False)).withColumn("created_at", F.lit(now))
    logs = a.select(F.col("id").alias("alert_id"), F.lit("created").alias("action"), F.lit(now).alias("timestamp"))
    return a, logs
