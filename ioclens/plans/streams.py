"""Streaming queries: the events file replayed as a stream; each query runs
to completion and returns its sink.  Oracles state the append-mode contract
(only windows closed by the watermark are emitted)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import views
from ..streaming import jobs as J
from ..streaming import sources as S
from .common import r6
from .lifecycle import JUDGED_SQL
from .registry import query

WM = "INTERVAL 10 MINUTES"


def _bulk_sql():
    from .pipelines import BULK_SQL   # same contract as the batch pipeline
    return BULK_SQL
MAX_TS = "(SELECT max(created_at) FROM ioc)"


@query("stream_hourly_counts", f"""SELECT date_trunc('hour', created_at) AS hour, count(*) AS n FROM ioc
GROUP BY 1 HAVING date_trunc('hour', created_at) + INTERVAL 1 HOUR <= {MAX_TS} - {WM}""")
def stream_hourly_counts(spark, sf_dir):
    """S3: tumbling hourly counts (watermark-closed windows)."""
    return J.run(J.hourly_counts(S.ioc_stream(spark, sf_dir)), "hourly")


@query("stream_sliding_counts", f"""WITH b AS (SELECT date_trunc('hour', created_at) AS h, count(*) AS c FROM ioc GROUP BY 1),
w AS (SELECT h - INTERVAL 23 HOUR + INTERVAL (k) HOUR AS window_start FROM b, range(0, 24) t(k))
SELECT DISTINCT w.window_start, w.window_start + INTERVAL 24 HOUR AS window_end,
  (SELECT sum(c) FROM b WHERE b.h >= w.window_start AND b.h < w.window_start + INTERVAL 24 HOUR) AS n
FROM w WHERE w.window_start + INTERVAL 24 HOUR <= {MAX_TS} - {WM}""")
def stream_sliding_counts(spark, sf_dir):
    """24-hour windows sliding by one hour."""
    return J.run(J.sliding_counts(S.ioc_stream(spark, sf_dir)), "sliding")


@query("stream_session_bursts", f"""WITH h AS (SELECT type, created_at, risk_score FROM ioc WHERE risk_score > 0.7),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(created_at) - epoch_us(prev) >= 1800000000 THEN 1 ELSE 0 END)
        OVER (PARTITION BY type ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, lag(created_at) OVER (PARTITION BY type ORDER BY created_at) AS prev FROM h) x),
s AS (SELECT type, sid, min(created_at) AS start_time, max(created_at) AS end_time, count(*) AS ioc_count,
        round(avg(cast(risk_score AS double)), 6) AS avg_risk FROM g GROUP BY type, sid)
SELECT type, start_time, end_time, ioc_count, avg_risk FROM s
WHERE ioc_count >= 3 AND end_time + INTERVAL 30 MINUTE <= (SELECT max(created_at) FROM h) - {WM}""")
def stream_session_bursts(spark, sf_dir):
    """Session windows over high-risk sightings (30-minute gap), per type."""
    out = J.run(J.session_bursts(S.ioc_stream(spark, sf_dir)), "sessions")
    return out.withColumn("avg_risk", r6("avg_risk"))


@query("stream_lateral_movement", f"""SELECT date_trunc('hour', a.created_at) AS time_window, count(*) AS alert_count,
  string_agg(DISTINCT i.type, ',' ORDER BY i.type) AS ioc_types, coalesce(string_agg(DISTINCT i.source, ',' ORDER BY i.source), '') AS sources,
  CASE WHEN count(DISTINCT i.type) >= 3 THEN 'high' ELSE 'medium' END AS severity
FROM alert a LEFT JOIN ioc i ON a.ioc_id = i.id
GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT i.type) >= 2
  AND date_trunc('hour', a.created_at) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM alert) - {WM}""")
def stream_lateral_movement(spark, sf_dir):
    """Lateral-movement windows from a stream-static join."""
    return J.run(J.lateral_windows(S.alert_stream(spark, sf_dir), views.ioc(spark, sf_dir)), "lateral")


@query("stream_distinct_indicators", "SELECT DISTINCT type, value FROM ioc")
def stream_distinct_indicators(spark, sf_dir):
    """Streaming dedupe on (type, value) over three micro-batches."""
    return J.distinct_batches(_ten_days(spark, sf_dir)).read("keys")


@query("stream_rule_alerts", """WITH rules AS (SELECT * FROM (VALUES
  ('High Risk IP Alert', 'ip', 0.7, 'high', 'High-risk IP address detected'),
  ('Malicious Domain Alert', 'domain', 0.8, 'critical', 'Malicious domain detected'),
  ('Suspicious Hash Alert', 'hash', 0.6, 'medium', 'Suspicious file hash detected')) AS t(rule_name, type, min_risk, severity, message))
SELECT i.id AS ioc_id, i.type, cast(i.risk_score AS double) AS risk_score, r.rule_name, r.severity, r.message
FROM ioc i JOIN rules r ON i.type = r.type AND i.risk_score >= r.min_risk""")
def stream_rule_alerts(spark, sf_dir):
    """Rule alerts from the stream, once per (IOC, message), over four
    micro-batches of which the last delivers the first's events again."""
    days = sorted(TEN_DAYS)
    return J.rule_alert_batches(_files(spark, sf_dir, "events-again", [*days, days[0]])).read("alerts")


@query("stream_lifecycle_transitions", f"""WITH RECURSIVE {JUDGED_SQL}
SELECT id, threat_input_id, ioc_id, prev_state, state, verdict FROM judged""")
def stream_lifecycle_transitions(spark, sf_dir):
    """Lifecycle state machine over three micro-batches of ten days."""
    return J.lifecycle_state_machine(_files(spark, sf_dir, "lifecycle-in-order", sorted(TEN_DAYS), views.lifecycle_from_events)).read("verdicts")



@query("stream_hourly_spikes", f"""WITH h AS (SELECT type, date_trunc('hour', created_at) AS hour, count(*) AS n FROM ioc GROUP BY 1, 2),
c AS (SELECT * FROM h WHERE hour + INTERVAL 1 HOUR <= {MAX_TS} - {WM}),
w AS (SELECT *, coalesce(avg(n) OVER p, 0.0) AS m, coalesce(stddev_pop(n) OVER p, 0.0) AS sd, count(*) OVER p AS k
      FROM c WINDOW p AS (PARTITION BY type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT type, hour, n, round(m, 6) AS baseline_mean, round(sd, 6) AS baseline_std, k AS prior_hours,
  k >= 24 AND n > m + 2 * sd AS is_spike FROM w""")
def stream_hourly_spikes(spark, sf_dir):
    """Per-type hourly spikes against the running baseline, over three
    micro-batches of ten days (keyed state, one version a batch)."""
    out = J.hourly_spikes(_ten_days(spark, sf_dir)).read("spikes")
    return out.select("type", F.col("hour").cast("timestamp_ntz").alias("hour"), "n", r6("baseline_mean").alias("baseline_mean"),
                      r6("baseline_std").alias("baseline_std"), "prior_hours", "is_spike")


@query("stream_monitored_rescore", """WITH j AS (SELECT e.id AS enrichment_id, e.ioc_id, e.enrichment_type, e.data
  FROM enrichment e JOIN ioc i ON e.ioc_id = i.id AND e.created_at >= i.created_at AND e.created_at <= i.created_at + INTERVAL 1 HOUR
  WHERE e.enrichment_type IN ('virustotal', 'geolocation', 'resolved_ip'))
SELECT ioc_id, enrichment_id, enrichment_type,
  round(CASE WHEN enrichment_type = 'virustotal' AND list_sum(map_values(vt.last_analysis_stats)) > 0
       THEN coalesce(vt.last_analysis_stats['malicious'], 0) / list_sum(map_values(vt.last_analysis_stats)) * 0.8 ELSE 0.0 END, 6) AS detection,
  round(CASE WHEN enrichment_type = 'virustotal' AND coalesce(vt.reputation, 0) < 0 THEN least(abs(vt.reputation) / 100.0, 0.5) ELSE 0.0 END, 6) AS reputation,
  round(CASE WHEN enrichment_type = 'geolocation' AND json_extract_string(data, '$.country_code') IN ('RU', 'CN', 'IR', 'KP') THEN 0.2 ELSE 0.0 END, 6) AS geo
FROM (SELECT *, CASE WHEN enrichment_type = 'virustotal' THEN
        json_transform(data, '{"reputation": "INTEGER", "last_analysis_stats": "MAP(VARCHAR, INTEGER)"}') END AS vt FROM j) t""")
def stream_monitored_rescore(spark, sf_dir):
    """Stream-stream join of sightings and enrichments (one-hour range,
    watermarks on both sides) with their risk contributions."""
    out = J.run(J.monitored_rescore(S.ioc_stream(spark, sf_dir), S.enrichment_stream(spark, sf_dir)), "monitor")
    return out.select("ioc_id", "enrichment_id", "enrichment_type", *[r6(c).alias(c) for c in ("detection", "reputation", "geo")])


@query("stream_flow_scoring")
def stream_flow_scoring(spark, sf_dir):
    """The network random forest (fitted once on the batch flow
    table's train split) scores the flow stream (lineitem replayed)."""
    from ..functions.network import NETWORK_FEATURES
    from .ml import _flow_training_set, _network_rf
    feats = ["packet_count", "bytes_transferred", "duration_seconds", "connection_count", "failed_connections"] + NETWORK_FEATURES
    model = _network_rf(spark, sf_dir, _flow_training_set(spark, sf_dir), feats)
    return J.run(J.score_stream(S.flow_stream(spark, sf_dir), model), "flowscore")


#: Files that land in the drop folder, however many tasks read the inputs: a
#: micro-batch merges into all buckets its indicators touch, mostly all.
DROPS = 8


@query("stream_bulk_ingest", _bulk_sql())
def stream_bulk_ingest(spark, sf_dir):
    """Bulk CSV files landing in a drop folder are normalised and merged
    into the IOC table, two files a micro-batch; a batch rewrites the buckets
    of its own indicators, under one version."""
    from ..operators import ingest as I
    from ..session import scratch_path
    from ..sources import sinks
    from ..sources.versioned import Tables
    drop = scratch_path(spark, "drops")
    raw = views.raw_inputs(spark, sf_dir).select(F.lit(None).cast("string").alias("type"), "value")
    sinks.write_csv(raw.repartition(DROPS), drop)
    ioc = views.ioc(spark, sf_dir)
    now = ioc.select(F.max("created_at")).first()[0]
    base = I.upsert_iocs(ioc, ioc.where(F.lit(False)).select("type", "value"), F.lit(now))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields)
    tables = Tables(spark, scratch_path(spark, "ioc-tables"), {"ioc": (ddl, ["type", "value"])})
    tables.commit(-1, replaces={"ioc": (base, list(range(tables.buckets)))})

    def per_batch(batch, batch_id, _out):
        if tables.done(batch_id):
            return
        acc, _ = I.split_batch(batch, "value", "type")
        found = acc.select("type", "value").distinct()
        touched = tables.touched("ioc", found)
        tables.commit(batch_id, replaces={"ioc": (I.upsert_iocs_table(tables.read("ioc", touched), found, F.lit(now)), touched)})

    J.run_batches(S.bulk_drops(spark, drop, fmt="csv", files=2), "bulk", per_batch)
    return tables.read("ioc")


TEN_DAYS = [("2024-01-21", "2100-01-01"), ("1970-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21")]


def _files(spark, sf_dir, name, ranges, view=views.ioc_from_events):
    """The events as one file for each range of days, one file a micro-batch,
    in the order of ``ranges``; written once per dataset."""
    from ..session import scratch_path
    from ..sources.tables import table
    import time
    folder = scratch_path(spark, name)
    events = table(spark, sf_dir, "events")
    for lo, hi in ranges:
        events.where((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz"))).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # the file source takes files by their times, in seconds
    return view(S.events(spark, folder, files_per_trigger=1, pattern="*.parquet"))


def _ten_days(spark, sf_dir):
    return _files(spark, sf_dir, "events-in-order", sorted(TEN_DAYS))


@query("stream_late_arrivals", f"""WITH e AS (SELECT created_at AS ts, CASE {' '.join(f"WHEN created_at >= '{lo}' AND created_at < '{hi}' THEN {k}" for k, (lo, hi) in enumerate(TEN_DAYS))} END AS b FROM ioc),
m AS (SELECT b, max(ts) AS t FROM e GROUP BY b)
SELECT cast(e.b AS bigint) AS batch_id, count(*) AS rows,
  count(*) FILTER (WHERE e.ts < (SELECT max(t) FROM m WHERE m.b < e.b) - {WM}) AS late FROM e GROUP BY e.b""")
def stream_late_arrivals(spark, sf_dir):
    """Rows per micro-batch and how many arrived behind the watermark:
    the last ten days come first, so all rows of the later files are late."""
    return J.count_late(_files(spark, sf_dir, "events-late", TEN_DAYS)).read("counts")
