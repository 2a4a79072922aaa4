"""Enrichment-based operators: payload parsing (XG7-XG10), risk from
enrichments (R1-R4, R6, R8), geo map (J12), related IOCs (J14, J15, U2, T5)
and shared-enrichment edges (J17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (COUNTRY_BONUS, DETECTION_WEIGHT, EDGE_SHARED_ENRICHMENT, HIGH_RISK_COUNTRIES, REPUTATION_CAP,
                         SHARED_ENRICHMENT_KINDS)
from ..functions.risk import fallback_score, to_stored
from .graph import star_edges
from .topn import top_n

VT_SCHEMA = "reputation int, last_analysis_stats map<string,int>"
GEO_SCHEMA = "country_code string, country string, region string, city string, lat double, lon double, isp string, org string"


def contributions(enr: DataFrame) -> DataFrame:
    """Per enrichment row: detection ratio x 0.8 (R1), negative reputation
    (R2), high-risk country (R3)."""
    vt = F.from_json(F.when(F.col("enrichment_type") == "virustotal", F.col("data")), VT_SCHEMA)
    geo = F.from_json(F.when(F.col("enrichment_type") == "geolocation", F.col("data")), GEO_SCHEMA)
    stats = F.coalesce(vt["last_analysis_stats"], F.create_map().cast("map<string,int>"))
    total = F.aggregate(F.map_values(stats), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    mal = F.coalesce(stats["malicious"], F.lit(0))
    rep = F.coalesce(vt["reputation"], F.lit(0))
    keep = [c for c in ("enrichment_id",) if c in enr.columns]
    return enr.select(
        "ioc_id", *keep, "enrichment_type",
        F.when(total > 0, mal / total * DETECTION_WEIGHT).otherwise(0.0).alias("detection"),
        F.when(rep < 0, F.least(F.abs(rep) / 100.0, F.lit(REPUTATION_CAP))).otherwise(0.0).alias("reputation"),
        F.when(geo["country_code"].isin(*HIGH_RISK_COUNTRIES), COUNTRY_BONUS).otherwise(0.0).alias("geo"))


def enrichment_scores(enr: DataFrame) -> DataFrame:
    """R3 (calculate_risk_score): per IOC, sum of contributions capped at 1."""
    c = contributions(enr).groupBy("ioc_id").agg(
        F.count(F.lit(1)).alias("n_enrichments"), F.sum("detection").alias("detection"),
        F.sum("reputation").alias("reputation"), F.sum("geo").alias("geo"))
    return c.withColumn("score", F.least(F.col("detection") + F.col("reputation") + F.col("geo"), F.lit(1.0)))


def dynamic_scores(iocs: DataFrame, enr: DataFrame) -> DataFrame:
    """R4 + R6: stored score + detection + reputation (no geo), capped at 1;
    below 0.1 the text fallback (R5) is used; stored as decimal(3,2)."""
    c = contributions(enr).groupBy("ioc_id").agg(F.sum("detection").alias("det"), F.sum("reputation").alias("rep"))
    j = iocs.join(c.withColumnRenamed("ioc_id", "id"), "id", "left")
    r4 = F.least(F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0)) + F.coalesce("det", F.lit(0.0))
                 + F.coalesce("rep", F.lit(0.0)), F.lit(1.0))
    final = F.when(r4 < 0.1, fallback_score("type", "value").cast("double")).otherwise(r4)
    return j.select("id", "type", "value", F.col("risk_score").cast("double").alias("old_score"), r4.alias("dynamic_score"),
                    to_stored(final).alias("final_score"))


def rescore(iocs: DataFrame, enr: DataFrame) -> DataFrame:
    """Re-score enriched IOCs; keep rows whose score moves by more
    than 0.01 (old compared before overwrite); re-alert on increases."""
    s = enrichment_scores(enr).select(F.col("ioc_id").alias("id"), F.col("score").alias("new_score"))
    j = iocs.join(s, "id").select("id", "type", F.col("risk_score").cast("double").alias("old_score"), "new_score")
    j = j.where(F.abs(F.col("new_score") - F.col("old_score")) > 0.01)
    return j.withColumn("stored_score", to_stored("new_score")).withColumn("realert", F.col("new_score") > F.col("old_score"))


def geo_points(iocs: DataFrame, enr: DataFrame) -> DataFrame:
    """J12/XG7: geolocated IOCs (lat and lon present)."""
    geo = enr.where(F.col("enrichment_type") == "geolocation").select("ioc_id", F.from_json("data", GEO_SCHEMA).alias("g"))
    geo = geo.where(F.col("g.lat").isNotNull() & F.col("g.lon").isNotNull())
    i = iocs.select(F.col("id").alias("ioc_id"), "type", "value", F.col("risk_score").cast("double").alias("risk_score"))
    return geo.join(i, "ioc_id").select(F.col("ioc_id").alias("id"), "type", "value", "risk_score", F.col("g.lat").alias("lat"),
                                         F.col("g.lon").alias("lon"), F.col("g.country").alias("country"), F.col("g.city").alias("city"))


def related_iocs(iocs: DataFrame, enr: DataFrame, limit: int = 10, per_source: int = 5) -> DataFrame:
    """For every IOC, IOCs sharing a resolved address (by id)
    then up to 5 of the same source (by id), deduplicated, first 10.

    Only the first limit+1 members of each address group and the first
    per_source+1 of each source can appear, so both come from two-level
    top-n tables and each IOC meets at most 17 candidates: no pairs."""
    rip = enr.where(F.col("enrichment_type") == "resolved_ip").select("ioc_id", F.col("data").alias("addr")).distinct()
    top_a = top_n(rip, ["addr"], [F.col("ioc_id")], limit + 1, ["ioc_id"], rank_col="ord")
    c1 = rip.join(top_a.select("addr", F.col("ioc_id").alias("related_id"), "ord"), "addr") \
        .where(F.col("ioc_id") != F.col("related_id")) \
        .select("ioc_id", "related_id", F.lit(0).alias("pri"), "ord", F.lit("resolved_ip").alias("relation"))
    src = iocs.where(F.col("source").isNotNull()).select(F.col("id").alias("ioc_id"), "source")
    top_s = top_n(src, ["source"], [F.col("ioc_id")], per_source + 1, ["ioc_id"], rank_col="ord")
    c2 = src.join(top_s.select("source", F.col("ioc_id").alias("related_id"), "ord"), "source") \
        .where(F.col("ioc_id") != F.col("related_id"))
    from pyspark.sql import Window
    c2 = c2.withColumn("_k", F.row_number().over(Window.partitionBy("ioc_id").orderBy("ord"))).where(F.col("_k") <= per_source) \
        .select("ioc_id", "related_id", F.lit(1).alias("pri"), "ord", F.lit("same_source").alias("relation"))
    both = c1.unionByName(c2)
    best = both.groupBy("ioc_id", "related_id").agg(F.min(F.struct("pri", "ord", "relation")).alias("b"))
    w = Window.partitionBy("ioc_id").orderBy(F.col("b.pri"), F.col("b.ord"))
    out = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return out.select("ioc_id", "related_id", F.col("b.relation").alias("relation"), "rank")


def shared_enrichment_edges(enr: DataFrame, existing: DataFrame) -> DataFrame:
    """IOCs sharing a resolved_ip / asn / country payload, star form,
    skipped where an edge already exists."""
    kind, conf = EDGE_SHARED_ENRICHMENT
    m = enr.where(F.col("enrichment_type").isin(*SHARED_ENRICHMENT_KINDS)) \
        .select(F.col("ioc_id").alias("id"), F.concat_ws(":", "enrichment_type", "data").alias("grp")).distinct()
    st = star_edges(m, "grp", kind, conf).distinct()
    return st.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def domain_geo(enr: DataFrame, geo_by_ip: DataFrame) -> DataFrame:
    """XG10: domain -> resolved address -> geolocation of that address
    (``geo_by_ip``: ip, data JSON as landed from a lookup)."""
    rip = enr.where(F.col("enrichment_type") == "resolved_ip").select("ioc_id", F.col("data").alias("ip"))
    g = geo_by_ip.select("ip", F.from_json("data", GEO_SCHEMA).alias("g"))
    return rip.join(g, "ip").select("ioc_id", "ip", F.col("g.country_code").alias("country_code"),
                                    F.col("g.country").alias("country"), F.col("g.city").alias("city"))
