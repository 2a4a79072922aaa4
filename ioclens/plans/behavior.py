"""Behavioural queries over the ``ioc`` sightings log and ``alert``."""

from __future__ import annotations

from ..operators import behavior as B
from ..operators.sequences import bursts
from ..sources import views
from .common import r6
from .registry import query

BURST_SQL = """WITH s AS (SELECT id, created_at AS ts, risk_score, type,
       lead(created_at) OVER (ORDER BY created_at, id) AS next_ts FROM ioc),
f AS (SELECT *, risk_score > 0.7 AS high,
       coalesce(risk_score > 0.7 AND next_ts IS NOT NULL AND epoch_us(next_ts) - epoch_us(ts) > 1800000000, false) AS close_flag,
       next_ts IS NULL AS is_last FROM s),
g AS (SELECT *, coalesce(sum(CASE WHEN close_flag THEN 1 ELSE 0 END)
       OVER (ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS burst_id FROM f)
SELECT cast(burst_id AS bigint) AS burst_id, min(ts) AS start_time, max(ts) AS end_time,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 6) AS duration_minutes, count(*) AS ioc_count,
       round(avg(cast(risk_score AS double)), 6) AS avg_risk, string_agg(DISTINCT type, ',' ORDER BY type) AS ioc_types,
       CASE WHEN count(*) >= 5 THEN 'high' ELSE 'medium' END AS severity
FROM g WHERE high GROUP BY burst_id
HAVING count(*) >= 3 AND {closed} AND (SELECT count(*) FROM ioc) >= 5"""


def _bursts(spark, sf_dir, flush_open):
    b = bursts(views.ioc(spark, sf_dir), flush_open=flush_open)
    return b.select("burst_id", "start_time", "end_time", r6("duration_minutes").alias("duration_minutes"),
                    "ioc_count", r6("avg_risk").alias("avg_risk"), "ioc_types", "severity")


@query("bursts", BURST_SQL.format(closed="(bool_or(close_flag) OR bool_or(is_last))"))
def q_bursts(spark, sf_dir):
    """High-risk bursts, reference rule (open tail dropped)."""
    return _bursts(spark, sf_dir, False)


@query("bursts_flush_open", BURST_SQL.format(closed="true"))
def q_bursts_flush(spark, sf_dir):
    """W5 with ``flush_open=true``: the open tail burst is kept."""
    return _bursts(spark, sf_dir, True)


@query("repeated_iocs", """WITH r AS (SELECT value FROM ioc GROUP BY value HAVING count(*) > 3),
d AS (SELECT i.value, i.created_at,
        (epoch_us(i.created_at) - epoch_us(lag(i.created_at) OVER (PARTITION BY i.value ORDER BY i.created_at))) / 3.6e9 AS gap
      FROM ioc i JOIN r ON i.value = r.value)
SELECT value AS ioc_value, count(*) AS occurrences, min(created_at) AS first_seen, max(created_at) AS last_seen,
       round(coalesce(avg(gap), 0.0), 6) AS avg_interval_hours, round(coalesce(stddev_pop(gap), 0.0), 6) AS std_interval_hours,
       coalesce(avg(gap), 0.0) < 24 AND coalesce(stddev_pop(gap), 0.0) < 12 AS is_suspicious
FROM d GROUP BY value""")
def repeated_iocs(spark, sf_dir):
    """Repeated values with inter-arrival statistics."""
    r = B.repeated_values(views.ioc(spark, sf_dir))
    return r.select("ioc_value", "occurrences", "first_seen", "last_seen", r6("avg_interval_hours").alias("avg_interval_hours"),
                    r6("std_interval_hours").alias("std_interval_hours"), "is_suspicious")


@query("hourly_counts", """SELECT date_trunc('hour', created_at) AS hour, count(*) AS n FROM ioc GROUP BY 1""")
def hourly_counts(spark, sf_dir):
    """Non-empty hourly buckets of IOC sightings."""
    return B.hourly_counts(views.ioc(spark, sf_dir))


@query("hourly_anomalies", """WITH h AS (SELECT date_trunc('hour', created_at) AS hour, count(*) AS n FROM ioc GROUP BY 1),
s AS (SELECT avg(n) AS m, stddev_pop(n) AS sd, count(*) AS k, sum(n) AS rows FROM h)
SELECT hour AS timestamp, n AS count, round(m, 6) AS expected, round((n - m) / sd, 6) AS deviation,
       CASE WHEN n > m + 3 * sd THEN 'high' ELSE 'medium' END AS severity
FROM h, s WHERE n > m + 2 * sd AND k >= 24 AND rows >= 10""")
def hourly_anomalies(spark, sf_dir):
    """Hourly spikes above mean + 2 std."""
    a = B.hourly_anomalies(views.ioc(spark, sf_dir))
    return a.select("timestamp", "count", r6("expected").alias("expected"), r6("deviation").alias("deviation"), "severity")


@query("lateral_movement", """SELECT date_trunc('hour', a.created_at) AS time_window, count(*) AS alert_count,
  string_agg(DISTINCT i.type, ',' ORDER BY i.type) AS ioc_types,
  coalesce(string_agg(DISTINCT i.source, ',' ORDER BY i.source), '') AS sources,
  count(*) FILTER (WHERE i.type IS NOT NULL AND i.source IS NULL) > 0 AS has_null_source,
  CASE WHEN count(DISTINCT i.type) >= 3 THEN 'high' ELSE 'medium' END AS severity
FROM alert a LEFT JOIN ioc i ON a.ioc_id = i.id
GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT i.type) >= 2""")
def lateral_movement(spark, sf_dir):
    """Hourly alert windows spanning several IOC types."""
    return B.lateral_movement(views.alert(spark, sf_dir), views.ioc(spark, sf_dir))
