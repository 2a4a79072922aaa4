"""Prediction, explanation, alerting and account queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as A
from ..operators import alerts as AL
from ..operators import explain as E
from ..sources import views
from .common import r6
from .registry import query


@query("prediction_consensus", """SELECT ioc_id, count(*) AS total, count(*) FILTER (WHERE prediction = 'malicious') AS malicious_votes,
  count(*) FILTER (WHERE prediction = 'benign') AS benign_votes,
  CASE WHEN count(*) FILTER (WHERE prediction = 'malicious') > count(*) FILTER (WHERE prediction = 'benign') THEN 'malicious' ELSE 'benign' END AS consensus_prediction,
  round(greatest(count(*) FILTER (WHERE prediction = 'malicious'), count(*) FILTER (WHERE prediction = 'benign')) / count(*), 6) AS consensus_confidence,
  CASE WHEN greatest(count(*) FILTER (WHERE prediction = 'malicious'), count(*) FILTER (WHERE prediction = 'benign')) / count(*) > 0.7 THEN 'strong' ELSE 'weak' END AS agreement_level
FROM prediction GROUP BY ioc_id""")
def prediction_consensus(spark, sf_dir):
    """Majority vote per IOC across models."""
    return E.consensus(views.prediction(spark, sf_dir)).withColumn("consensus_confidence", r6("consensus_confidence"))


@query("prediction_summary", """SELECT ioc_id, count(*) AS total_predictions, max(id) AS latest_id,
  arg_max(model_name, id) AS latest_model, arg_max(prediction, id) AS latest_prediction,
  round(arg_max(confidence, id), 6) AS latest_confidence FROM prediction GROUP BY ioc_id""")
def prediction_summary(spark, sf_dir):
    """Prediction count and latest verdict per IOC."""
    return E.summary(views.prediction(spark, sf_dir)).withColumn("latest_confidence", r6("latest_confidence"))


@query("similar_predictions", """SELECT p.id, p.model_name, p.prediction, round(p.confidence, 6) AS confidence,
  s.n AS similar_count, round(s.avg_c, 6) AS average_confidence_similar,
  CASE WHEN s.n > 0 THEN CASE WHEN p.confidence > s.avg_c THEN 'higher' ELSE 'lower' END END AS confidence_comparison
FROM prediction p, LATERAL (SELECT count(*) AS n, avg(q.confidence) AS avg_c FROM (
  SELECT confidence FROM prediction q WHERE q.model_name = p.model_name AND q.prediction = p.prediction AND q.id <> p.id
  ORDER BY q.id LIMIT 10) q) s""")
def similar_predictions(spark, sf_dir):
    """Comparison with the first 10 similar predictions."""
    s = E.similar(views.prediction(spark, sf_dir))
    return s.select("id", "model_name", "prediction", r6("confidence").alias("confidence"), "similar_count",
                    r6("average_confidence_similar").alias("average_confidence_similar"), "confidence_comparison")


FEATS_SQL = """feats AS (
  SELECT p.id, p.ioc_id, p.model_name, p.prediction, p.confidence, i.type AS ioc_type,
         coalesce(cast(i.risk_score AS double), 0.0) AS risk_score, cast(coalesce(en.n, 0) AS double) AS enrichment_count,
         cast(coalesce(a.n, 0) AS double) AS alert_count,
         cast(coalesce(floor((epoch_us((SELECT max(created_at) FROM ioc)) - epoch_us(i.created_at)) / 8.64e10), 0) AS double) AS days_since_first_seen,
         cast(coalesce(floor((epoch_us((SELECT max(created_at) FROM ioc)) - epoch_us(coalesce(ls.t, i.created_at))) / 8.64e10), 0) AS double) AS days_since_last_seen,
         0.0 AS source_score,
         cast(coalesce(CASE i.type WHEN 'ip' THEN 0 WHEN 'domain' THEN 1 WHEN 'url' THEN 2 WHEN 'hash' THEN 3 WHEN 'network' THEN 4 END, 0) AS double) AS ioc_type_encoded,
         cast(coalesce(length(i.value), 0) AS double) AS value_length
  FROM prediction p LEFT JOIN ioc i ON p.ioc_id = i.id
  LEFT JOIN (SELECT ioc_id, count(*) AS n FROM alert GROUP BY 1) a ON p.ioc_id = a.ioc_id
  LEFT JOIN (SELECT ioc_id, count(*) AS n FROM enrichment GROUP BY 1) en ON p.ioc_id = en.ioc_id
  LEFT JOIN (SELECT type, value, max(created_at) AS t FROM ioc GROUP BY 1, 2) ls ON i.type = ls.type AND i.value = ls.value)"""


def _feats(spark, sf_dir):
    ioc = views.ioc(spark, sf_dir)
    as_of = ioc.select(F.max("created_at")).scalar()
    return E.explanation_features(views.prediction(spark, sf_dir), ioc, views.alert(spark, sf_dir), views.enrichment(spark, sf_dir), as_of)


@query("feature_importance", f"""WITH {FEATS_SQL},
long AS (SELECT id, feature, value FROM feats UNPIVOT (value FOR feature IN
  (risk_score, enrichment_count, alert_count, days_since_first_seen, days_since_last_seen, source_score, ioc_type_encoded, value_length))),
imp AS (SELECT id, feature, value, CASE feature WHEN 'risk_score' THEN 0.3 WHEN 'enrichment_count' THEN 0.2 WHEN 'alert_count' THEN 0.15
  WHEN 'days_since_first_seen' THEN 0.1 WHEN 'days_since_last_seen' THEN 0.1 WHEN 'source_score' THEN 0.1
  WHEN 'ioc_type_encoded' THEN 0.05 ELSE 0.0 END * abs(value) AS importance FROM long)
SELECT id, feature, round(value, 6) AS value, round(importance, 6) AS importance,
  row_number() OVER (PARTITION BY id ORDER BY importance DESC, feature) AS rank FROM imp""")
def feature_importance(spark, sf_dir):
    """Weighted feature importance per prediction, ranked."""
    fi = E.feature_importance(_feats(spark, sf_dir))
    return fi.select("id", "feature", r6("value").alias("value"), r6("importance").alias("importance"), "rank")


def _codes_sql(rules):
    parts = [f"CASE WHEN coalesce({c}, 0) {op} {v} THEN '{code}' END" for c, op, v, code in rules]
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL), ',')"


@query("prediction_explanations", f"""WITH {FEATS_SQL}
SELECT id, ioc_id, model_name, prediction, round(confidence, 6) AS confidence,
  CASE WHEN prediction = 'malicious' THEN {_codes_sql(E.FACTOR_CODES_MALICIOUS)} ELSE {_codes_sql(E.FACTOR_CODES_OTHER)} END AS contributing_factors,
  CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.6 THEN 'medium' ELSE 'low' END AS confidence_level,
  CASE WHEN confidence > 0.9 THEN 'very_high' WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.7 THEN 'moderate_high'
       WHEN confidence > 0.6 THEN 'moderate' WHEN confidence > 0.5 THEN 'low_moderate' ELSE 'low' END AS interpretation,
  printf('%.2f - %.2f', greatest(0.0, confidence - 0.1), least(1.0, confidence + 0.1)) AS uncertainty_range,
  array_to_string(list_filter(CASE WHEN prediction = 'malicious' THEN ['block_indicator',
      CASE WHEN confidence > 0.8 THEN 'act_now' ELSE 'monitor_closely' END,
      CASE WHEN ioc_type = 'ip' THEN 'check_firewall_logs' WHEN ioc_type = 'domain' THEN 'review_dns_queries' END,
      'review_feature_importance']
    ELSE ['continue_monitoring', CASE WHEN confidence < 0.6 THEN 'gather_more_intelligence' END, 'review_feature_importance'] END,
    lambda x: x IS NOT NULL), ',') AS recommendations,
  round(CASE WHEN prediction = 'malicious' THEN 0.6 + 0.4 * confidence WHEN prediction = 'benign' THEN 0.4 * (1 - confidence) ELSE 0.5 END, 6) AS risk_from_prediction
FROM feats""")
def prediction_explanations(spark, sf_dir):
    """Explanation record of every prediction (stable codes)."""
    ex = E.explain(_feats(spark, sf_dir))
    return ex.withColumn("confidence", r6("confidence")).withColumn("risk_from_prediction", r6("risk_from_prediction"))


@query("rule_alerts", """WITH rules AS (SELECT * FROM (VALUES
  ('High Risk IP Alert', 'ip', 0.7, 'high', 'High-risk IP address detected'),
  ('Malicious Domain Alert', 'domain', 0.8, 'critical', 'Malicious domain detected'),
  ('Suspicious Hash Alert', 'hash', 0.6, 'medium', 'Suspicious file hash detected')) AS t(rule_name, type, min_risk, severity, message))
SELECT i.id AS ioc_id, i.type, cast(i.risk_score AS double) AS risk_score, r.rule_name, r.severity, r.message
FROM ioc i JOIN rules r ON i.type = r.type AND i.risk_score >= r.min_risk""")
def rule_alerts(spark, sf_dir):
    """Rule hits over all IOCs, minus alerts already raised for
    (ioc_id, message).  The existing ``alert`` table carries no rule
    message, so nothing is suppressed on this data."""
    existing = views.alert(spark, sf_dir).select("ioc_id", F.lit(None).cast("string").alias("message"))
    return AL.rule_alerts(views.ioc(spark, sf_dir), existing)


@query("cross_source_boost", """WITH k AS (SELECT type, value, count(*) AS n, count(DISTINCT source) AS d FROM ioc GROUP BY 1, 2),
ks AS (SELECT type, value, source, count(*) AS cs FROM ioc WHERE source IS NOT NULL GROUP BY 1, 2, 3)
SELECT i.id, i.type, i.value, i.source, cast(i.risk_score AS double) AS risk_score,
  CASE WHEN k.n > 1 THEN k.d - CASE WHEN i.source IS NOT NULL AND ks.cs = 1 THEN 1 ELSE 0 END ELSE 0 END AS other_sources,
  round(CASE WHEN k.n > 1 THEN least(1.0, cast(i.risk_score AS double) + least(0.3, (k.d - CASE WHEN i.source IS NOT NULL AND ks.cs = 1 THEN 1 ELSE 0 END) * 0.1))
       ELSE cast(i.risk_score AS double) END, 6) AS boosted_score
FROM ioc i JOIN k ON i.type = k.type AND i.value = k.value
LEFT JOIN ks ON i.type = ks.type AND i.value = ks.value AND i.source = ks.source""")
def cross_source_boost(spark, sf_dir):
    """Cross-source confidence boost for every sighting."""
    return AL.cross_source_boost(views.ioc(spark, sf_dir)).withColumn("boosted_score", r6("boosted_score"))


@query("account_statistics", """WITH c AS (SELECT account_id, count(*) AS total_threats, count(ioc_id) AS ioc_count,
  count(threat_input_id) AS threat_input_count FROM mapping GROUP BY 1),
r AS (SELECT m.account_id, avg(cast(i.risk_score AS double)) AS avg_risk_score, count(*) FILTER (WHERE i.risk_score > 0.7) AS high_risk_count
  FROM (SELECT DISTINCT account_id, ioc_id FROM mapping WHERE ioc_id IS NOT NULL) m JOIN ioc i ON m.ioc_id = i.id
  WHERE i.risk_score IS NOT NULL GROUP BY 1)
SELECT a.id AS account_id, a.name, coalesce(c.total_threats, 0) AS total_threats, coalesce(c.ioc_count, 0) AS ioc_count,
  coalesce(c.threat_input_count, 0) AS threat_input_count, round(coalesce(r.avg_risk_score, 0.0), 6) AS avg_risk_score,
  coalesce(r.high_risk_count, 0) AS high_risk_count
FROM account a LEFT JOIN c ON a.id = c.account_id LEFT JOIN r ON a.id = r.account_id""")
def account_statistics(spark, sf_dir):
    """Statistics of every account."""
    s = A.account_statistics(views.account(spark, sf_dir), views.mapping(spark, sf_dir), views.ioc(spark, sf_dir))
    return s.withColumn("avg_risk_score", r6("avg_risk_score"))


@query("account_threats", """SELECT m.account_id, m.id AS mapping_id, m.ioc_id, i.type AS ioc_type, i.value AS ioc_value,
  cast(i.risk_score AS double) AS ioc_risk_score, m.threat_input_id, m.assigned_at, m.rank
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY id) AS rank FROM mapping) m
LEFT JOIN ioc i ON m.ioc_id = i.id WHERE m.rank <= 100""")
def account_threats(spark, sf_dir):
    """First 100 mappings of every account with IOC details."""
    return A.account_threats(views.mapping(spark, sf_dir), views.ioc(spark, sf_dir))


@query("risk_percentages", """SELECT id, type, printf('%.1f%%', cast(risk_score AS double) * 100) AS risk_text FROM ioc""")
def risk_percentages(spark, sf_dir):
    """Risk score as percentage text with one decimal."""
    i = views.ioc(spark, sf_dir)
    return i.select("id", "type", F.format_string("%.1f%%", F.col("risk_score").cast("double") * 100).alias("risk_text"))
