"""Joins and roll-ups completing the inventory: nested enrichments (J4),
lifecycle details (J29), account-scoped IOCs (J9/J10), weighted metrics
(G24), map point count (G29) and the insight top lists (T7/I4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import behavior as B
from ..operators import enrich as EN
from ..operators import ml as M
from ..operators.topn import top_n
from ..operators.joins import left_join_known
from ..sources import views
from .common import r6
from .registry import query


@query("ioc_enrichment_summary", """SELECT i.id, i.type, i.value, count(e.id) AS n_enrichments,
  coalesce(string_agg(DISTINCT e.enrichment_type, ',' ORDER BY e.enrichment_type), '') AS enrichment_types
FROM ioc i LEFT JOIN enrichment e ON e.ioc_id = i.id GROUP BY 1, 2, 3""")
def ioc_enrichment_summary(spark, sf_dir):
    """Each IOC with its enrichments (count and kinds; the payloads stay
    rows of the enrichment table, joined by id, not nested lists)."""
    e = views.enrichment(spark, sf_dir).groupBy("ioc_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("enrichment_type")), ",").alias("t"))
    i = views.ioc(spark, sf_dir).select("id", "type", "value")
    j = i.join(e.withColumnRenamed("ioc_id", "id"), "id", "left")
    return j.select("id", "type", "value", F.coalesce("n", F.lit(0)).alias("n_enrichments"),
                    F.coalesce("t", F.lit("")).alias("enrichment_types"))


@query("lifecycle_details", """SELECT l.id, l.threat_input_id, l.ioc_id, l.state, l.ts, i.type AS ioc_type, i.value AS ioc_value,
  cast(i.risk_score AS double) AS ioc_risk_score FROM lifecycle l LEFT JOIN ioc i ON l.ioc_id = i.id""")
def lifecycle_details(spark, sf_dir):
    """Lifecycle entries with the details of their IOC (left join)."""
    i = views.ioc(spark, sf_dir).select(F.col("id").alias("ioc_id"), F.col("type").alias("ioc_type"),
                                        F.col("value").alias("ioc_value"), F.col("risk_score").cast("double").alias("ioc_risk_score"))
    return left_join_known(views.lifecycle(spark, sf_dir), i, "ioc_id").select(
        "id", "threat_input_id", "ioc_id", "state", "ts", "ioc_type", "ioc_value", "ioc_risk_score")


@query("account_iocs", """SELECT DISTINCT m.account_id, i.id, i.type, i.value FROM mapping m JOIN ioc i ON m.ioc_id = i.id""")
def account_iocs(spark, sf_dir):
    """IOCs of every account (inner join, distinct IOC per account)."""
    m = views.mapping(spark, sf_dir).where(F.col("ioc_id").isNotNull()).select("account_id", F.col("ioc_id").alias("id")).distinct()
    return m.join(views.ioc(spark, sf_dir).select("id", "type", "value"), "id")


@query("model_weighted_metrics", """WITH s AS (SELECT p.model_name, l.toxic AS y, CASE WHEN p.prediction = 'malicious' THEN 1 ELSE 0 END AS p
  FROM prediction p JOIN labels l ON p.ioc_id = l.doc_id),
c AS (SELECT model_name, cls, count(*) FILTER (WHERE y = cls AND p = cls) AS tp, count(*) FILTER (WHERE p = cls) AS pp,
  count(*) FILTER (WHERE y = cls) AS sup FROM s, (SELECT 0 AS cls UNION ALL SELECT 1) k GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS pr, CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END AS rc FROM c),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m)
SELECT model_name, round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(pr * sup) / sum(sup), 6) AS precision,
  round(sum(rc * sup) / sum(sup), 6) AS recall, round(sum(f1 * sup) / sum(sup), 6) AS f1 FROM f GROUP BY 1""")
def model_weighted_metrics(spark, sf_dir):
    """Accuracy and support-weighted precision / recall / F1 per model."""
    from .ml import _scored_predictions
    rep = M.class_report(_scored_predictions(spark, sf_dir), "y", "p", ["model_name"])
    tp = rep.withColumn("_tp", F.col("recall") * F.col("support"))
    g = tp.groupBy("model_name").agg(
        (F.sum("_tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))
    return g.select("model_name", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("map_point_count", """SELECT count(*) AS points FROM enrichment e JOIN ioc i ON e.ioc_id = i.id
WHERE e.enrichment_type = 'geolocation' AND json_extract(e.data, '$.lat') IS NOT NULL AND json_extract(e.data, '$.lon') IS NOT NULL""")
def map_point_count(spark, sf_dir):
    """Number of map points."""
    return EN.geo_points(views.ioc(spark, sf_dir), views.enrichment(spark, sf_dir)).agg(F.count(F.lit(1)).alias("points"))


@query("insight_top_lists", """WITH r AS (SELECT value, count(*) AS n FROM ioc GROUP BY value HAVING count(*) > 3),
lat AS (SELECT date_trunc('hour', a.created_at) AS w, count(*) AS n FROM alert a LEFT JOIN ioc i ON a.ioc_id = i.id
        GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT i.type) >= 2)
SELECT 'repeated_iocs' AS list_name, rank, item, metric FROM (
  SELECT row_number() OVER (ORDER BY n DESC, value) AS rank, value AS item, n AS metric FROM r) t WHERE rank <= 5
UNION ALL
SELECT 'lateral_windows', rank, item, metric FROM (
  SELECT row_number() OVER (ORDER BY n DESC, w) AS rank, strftime(w, '%Y-%m-%dT%H:%M:%S') AS item, n AS metric FROM lat) t WHERE rank <= 3""")
def insight_top_lists(spark, sf_dir):
    """The behavioural insight bundle as ranked top lists: 5 most
    repeated values and the 3 busiest lateral-movement windows."""
    ioc, alert = views.ioc(spark, sf_dir), views.alert(spark, sf_dir)
    rep = ioc.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    lat = B.lateral_movement(alert, ioc)
    parts = [
        rep.orderBy(F.col("n").desc(), "value").limit(5).select(F.lit("repeated_iocs").alias("list_name"), F.col("value").alias("item"),
                                                                F.col("n").alias("metric"), F.col("n").alias("_o1"), F.col("value").alias("_o2")),
        lat.orderBy(F.col("alert_count").desc(), "time_window").limit(3).select(
            F.lit("lateral_windows").alias("list_name"), F.date_format("time_window", "yyyy-MM-dd'T'HH:mm:ss").alias("item"),
            F.col("alert_count").alias("metric"), F.col("alert_count").alias("_o1"), F.date_format("time_window", "yyyy-MM-dd'T'HH:mm:ss").alias("_o2")),
    ]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    ranked = top_n(u, ["list_name"], [F.col("_o1").desc(), F.col("_o2")], 5, ["item"])
    return ranked.select("list_name", "rank", "item", "metric")

