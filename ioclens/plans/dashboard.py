"""Dashboard, list, filter and report queries over ``ioc`` and ``alert``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeutil import iso
from ..operators import dashboard as D
from ..sources import views
from .registry import query

ISO_SQL = "CASE WHEN microsecond({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END"
SEV_SQL = "CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END"
DATE_FROM, DATE_TO = "2024-01-05 00:00:00", "2024-01-10 23:59:59.999999"


def _iso(c):
    return ISO_SQL.format(c=c)


@query("dashboard_metrics", """SELECT metric, value FROM (
  SELECT 'total_iocs' AS metric, count(*) AS value FROM ioc
  UNION ALL SELECT 'critical_risk_iocs', count(*) FILTER (WHERE risk_score >= 0.9) FROM ioc
  UNION ALL SELECT 'high_risk_iocs', count(*) FILTER (WHERE risk_score >= 0.7 AND risk_score < 0.9) FROM ioc
  UNION ALL SELECT 'medium_risk_iocs', count(*) FILTER (WHERE risk_score >= 0.4 AND risk_score < 0.7) FROM ioc
  UNION ALL SELECT 'low_risk_iocs', count(*) FILTER (WHERE risk_score < 0.4) FROM ioc
  UNION ALL SELECT 'active_alerts', count(*) FILTER (WHERE NOT acknowledged) FROM alert
  UNION ALL SELECT 'acknowledged_alerts', count(*) FILTER (WHERE acknowledged) FROM alert) t""")
def dashboard_metrics(spark, sf_dir):
    """G1: dashboard counts (one aggregate per table)."""
    return D.dashboard_metrics(views.ioc(spark, sf_dir), views.alert(spark, sf_dir))


@query("risk_summary", """SELECT count(*) AS total, count(*) FILTER (WHERE risk_score >= 0.9) AS critical,
  count(*) FILTER (WHERE risk_score >= 0.7 AND risk_score < 0.9) AS high,
  count(*) FILTER (WHERE risk_score >= 0.4 AND risk_score < 0.7) AS medium,
  count(*) FILTER (WHERE risk_score < 0.4) AS low FROM ioc""")
def risk_summary(spark, sf_dir):
    """Risk summary in one conditional aggregate."""
    return D.band_counts(views.ioc(spark, sf_dir))


@query("critical_risks", """SELECT id, type, value, source, cast(risk_score AS double) AS risk_score, created_at
FROM ioc WHERE risk_score >= 0.9""")
def critical_risks(spark, sf_dir):
    """F4 + T4: the critical band, highest score first."""
    df = D.band_filter(views.ioc(spark, sf_dir), "critical")
    return (df.orderBy(F.col("risk_score").desc_nulls_last(), "id")
              .select("id", "type", "value", "source", F.col("risk_score").cast("double").alias("risk_score"), "created_at"))


@query("iocs_of_type", """SELECT id, value, source, cast(risk_score AS double) AS risk_score, created_at FROM ioc WHERE type = 'ip'""")
def iocs_of_type(spark, sf_dir):
    """IOC filter by type."""
    return views.ioc(spark, sf_dir).where(F.col("type") == "ip") \
        .select("id", "value", "source", F.col("risk_score").cast("double").alias("risk_score"), "created_at")


@query("ioc_page", """SELECT id, type, value, created_at, (SELECT cast(ceil(count(*) / 100.0) AS bigint) FROM ioc) AS total_pages
FROM ioc ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 100""")
def ioc_page(spark, sf_dir):
    """Second page of 100, newest first, with the page count."""
    ioc = views.ioc(spark, sf_dir)
    pages = ioc.select(F.ceil(F.count(F.lit(1)) / 100.0).cast("bigint")).scalar()
    return D.page(ioc, [F.col("created_at").desc(), F.col("id").desc()], 100, 100) \
        .select("id", "type", "value", "created_at", pages.alias("total_pages"))


@query("open_high_alerts", """SELECT id, ioc_id, severity, created_at FROM alert WHERE NOT acknowledged AND severity = 'high'""")
def open_high_alerts(spark, sf_dir):
    """unacknowledged alerts of severity 'high'."""
    a = views.alert(spark, sf_dir)
    return a.where(~F.col("acknowledged") & (F.col("severity") == "high")).select("id", "ioc_id", "severity", "created_at")


@query("alerts_by_severity", f"""SELECT id, ioc_id, severity, created_at FROM alert
ORDER BY {SEV_SQL} DESC, created_at DESC, id DESC LIMIT 100""")
def alerts_by_severity(spark, sf_dir):
    """Alert list sorted by severity in enum order (not alphabet)."""
    a = views.alert(spark, sf_dir)
    return D.page(a, [D.severity_rank().desc(), F.col("created_at").desc(), F.col("id").desc()], 0, 100) \
        .select("id", "ioc_id", "severity", "created_at")


@query("recent_alerts", """SELECT id, ioc_id, severity, acknowledged, created_at FROM alert ORDER BY created_at DESC, id DESC LIMIT 10""")
def recent_alerts(spark, sf_dir):
    """The ten most recent alerts (top-k)."""
    a = views.alert(spark, sf_dir)
    return a.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(10) \
        .select("id", "ioc_id", "severity", "acknowledged", "created_at")


@query("alert_counts", """SELECT count(*) AS total_alerts, count(*) FILTER (WHERE NOT acknowledged) AS active_alerts,
  count(*) FILTER (WHERE acknowledged) AS acknowledged_alerts FROM alert""")
def alert_counts(spark, sf_dir):
    """Alert page counters."""
    return D.alert_counts(views.alert(spark, sf_dir))


@query("ioc_report", f"""SELECT id, type, value, source, cast(risk_score AS double) AS risk_score,
  {_iso('created_at')} AS created_at FROM ioc
WHERE created_at >= TIMESTAMP '{DATE_FROM}' AND created_at <= TIMESTAMP '{DATE_TO}'""")
def ioc_report(spark, sf_dir):
    """A17/F5/XG6: IOC export rows for an inclusive date range, ISO text."""
    ioc = views.ioc(spark, sf_dir)
    ts = F.col("created_at")
    rng = (ts >= F.lit(DATE_FROM).cast("timestamp_ntz")) & (ts <= F.lit(DATE_TO).cast("timestamp_ntz"))
    return ioc.where(rng).select("id", "type", "value", "source", F.col("risk_score").cast("double").alias("risk_score"),
                                 iso("created_at").alias("created_at"))


@query("alert_report", f"""SELECT a.id, a.ioc_id, i.value AS ioc_value, i.type AS ioc_type, a.severity, a.acknowledged,
  {_iso('a.created_at')} AS created_at
FROM alert a LEFT JOIN ioc i ON a.ioc_id = i.id
WHERE a.created_at >= TIMESTAMP '{DATE_FROM}' AND a.created_at <= TIMESTAMP '{DATE_TO}'""")
def alert_report(spark, sf_dir):
    """Alert export with its IOC's value and type (left join)."""
    a = views.alert(spark, sf_dir)
    ts = F.col("created_at")
    a = a.where((ts >= F.lit(DATE_FROM).cast("timestamp_ntz")) & (ts <= F.lit(DATE_TO).cast("timestamp_ntz")))
    i = views.ioc(spark, sf_dir).select(F.col("id").alias("ioc_id"), F.col("value").alias("ioc_value"),
                                        F.col("type").alias("ioc_type"))
    return a.join(i, "ioc_id", "left").select("id", "ioc_id", "ioc_value", "ioc_type", "severity", "acknowledged",
                                              iso("created_at").alias("created_at"))
