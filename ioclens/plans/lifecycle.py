"""Lifecycle queries over the ``lifecycle`` log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import LIFECYCLE_STATES, TRANSITIONS
from ..operators import lifecycle as L
from ..sources import views
from .common import r6
from .registry import query

LATEST_SQL = """latest AS (
  SELECT a.* FROM lifecycle a JOIN (
    SELECT threat_input_id, ioc_id, max(ts) AS max_ts FROM lifecycle GROUP BY 1, 2) m
  ON a.threat_input_id = m.threat_input_id AND a.ioc_id = m.ioc_id AND a.ts = m.max_ts)"""
LATEST_NS_SQL = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY threat_input_id, ioc_id ORDER BY ts DESC, id DESC) AS rn
                 FROM lifecycle) WHERE rn = 1)"""
STATES_SQL = "states AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}')" for s in LIFECYCLE_STATES) + ") AS t(state))"


@query("lifecycle_history", """SELECT id, threat_input_id, ioc_id, state, ts,
  row_number() OVER (PARTITION BY threat_input_id, ioc_id ORDER BY ts, id) AS seq FROM lifecycle""")
def lifecycle_history(spark, sf_dir):
    """Ordered history with a per-threat ordinal."""
    return L.history(views.lifecycle(spark, sf_dir))


@query("lifecycle_current_state", f"""WITH {LATEST_NS_SQL}
SELECT threat_input_id, ioc_id, state AS current_state, ts AS since FROM latest""")
def lifecycle_current_state(spark, sf_dir):
    """Current state of every threat (NULL-safe keys, ties by id)."""
    lt = L.latest(views.lifecycle(spark, sf_dir), null_safe=True)
    return lt.select("threat_input_id", "ioc_id", F.col("state").alias("current_state"), F.col("ts").alias("since"))


def _allowed_sql():
    pairs = [f"('{a}', '{b}')" for a, tos in TRANSITIONS.items() for b in tos]
    return "(prev_state, state) IN (" + ", ".join(pairs) + ")"


_VERDICT = f"""CASE WHEN prev_state = state THEN 'noop'
       WHEN (prev_state IS NULL AND state = 'new') OR (prev_state IS NOT NULL AND {_allowed_sql()}) THEN 'valid' ELSE 'invalid' END"""
#: Every entry with its threat's last accepted state, one entry a step.
JUDGED_SQL = f"""entry AS (SELECT *, row_number() OVER (PARTITION BY threat_input_id, ioc_id ORDER BY ts, id) AS k FROM lifecycle),
walk AS (SELECT id, threat_input_id, ioc_id, ts, k, cast(NULL AS varchar) AS prev_state, state,
           CASE WHEN state = 'new' THEN state END AS after_state FROM entry WHERE k = 1
  UNION ALL SELECT id, threat_input_id, ioc_id, ts, k, prev_state, state, CASE WHEN {_VERDICT} = 'invalid' THEN prev_state ELSE state END
  FROM (SELECT e.*, w.after_state AS prev_state FROM walk w JOIN entry e ON e.k = w.k + 1
          AND e.threat_input_id IS NOT DISTINCT FROM w.threat_input_id AND e.ioc_id IS NOT DISTINCT FROM w.ioc_id) x),
judged AS (SELECT id, threat_input_id, ioc_id, ts, k, prev_state, state, after_state, {_VERDICT} AS verdict FROM walk)"""


@query("lifecycle_transitions", f"""WITH RECURSIVE {JUDGED_SQL}
SELECT id, threat_input_id, ioc_id, prev_state, state, verdict FROM judged""")
def lifecycle_transitions(spark, sf_dir):
    """Validity of every entry against the last accepted state."""
    t = L.transitions(views.lifecycle(spark, sf_dir))
    return t.select("id", "threat_input_id", "ioc_id", "prev_state", "state", "verdict")


@query("lifecycle_accepted_state", f"""WITH RECURSIVE {JUDGED_SQL}
SELECT threat_input_id, ioc_id, arg_max(coalesce(after_state, 'none'), k) AS state,
  count(*) FILTER (verdict = 'valid') AS n_valid, count(*) FILTER (verdict = 'noop') AS n_noop, count(*) FILTER (verdict = 'invalid') AS n_invalid
FROM judged GROUP BY 1, 2""")
def lifecycle_accepted_state(spark, sf_dir):
    """The state each threat is in after its accepted transitions
    ('none' before a first 'new'), with its numbers of verdicts."""
    t = L.transitions(views.lifecycle(spark, sf_dir))
    after = F.coalesce(F.when(F.col("verdict") == "invalid", F.col("prev_state")).otherwise(F.col("state")), F.lit("none"))
    count = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("valid", "noop", "invalid")]
    return t.groupBy("threat_input_id", "ioc_id").agg(F.max_by(after, F.struct("ts", "id")).alias("state"), *count)


LAST_DAY = "(SELECT max(ts) FROM lifecycle) - INTERVAL 1 DAY"


def _requests(spark, sf_dir):
    lc = views.lifecycle(spark, sf_dir)
    cut = lc.select(F.max("ts") - F.expr("INTERVAL 1 DAY")).scalar()
    return L.apply_requests(lc.where(F.col("ts") < cut), lc.where(F.col("ts") >= cut))


@query("lifecycle_batch_accepted", f"""WITH RECURSIVE {JUDGED_SQL}
SELECT id, threat_input_id, ioc_id, state, ts FROM judged WHERE verdict = 'valid' AND ts >= {LAST_DAY}""")
def lifecycle_batch_accepted(spark, sf_dir):
    """L2: the last day's entries as a batch of requests on the log before
    it: the rows to append."""
    return _requests(spark, sf_dir)[0]


@query("lifecycle_batch_rejects", f"""WITH RECURSIVE {JUDGED_SQL}
SELECT id, threat_input_id, ioc_id, state, ts, prev_state, 'transition_from_' || coalesce(prev_state, 'none') AS reject_reason
FROM judged WHERE verdict = 'invalid' AND ts >= {LAST_DAY}""")
def lifecycle_batch_rejects(spark, sf_dir):
    """L2: the requests of that batch that are refused, and from which state."""
    return _requests(spark, sf_dir)[1]


@query("lifecycle_state_counts", f"""WITH {LATEST_SQL}, {STATES_SQL}
SELECT s.state, coalesce(c.n, 0) AS n FROM states s
LEFT JOIN (SELECT state, count(*) AS n FROM latest GROUP BY 1) c ON s.state = c.state""")
def lifecycle_state_counts(spark, sf_dir):
    """G3 (reference rule D7): counts of latest states, zero-filled."""
    return L.state_counts(L.latest(views.lifecycle(spark, sf_dir)))


@query("lifecycle_state_counts_null_safe", f"""WITH {LATEST_NS_SQL}, {STATES_SQL}
SELECT s.state, coalesce(c.n, 0) AS n FROM states s
LEFT JOIN (SELECT state, count(*) AS n FROM latest GROUP BY 1) c ON s.state = c.state""")
def lifecycle_state_counts_null_safe(spark, sf_dir):
    """G3 with ``null_safe=true``: NULL keys kept, one latest row per threat."""
    return L.state_counts(L.latest(views.lifecycle(spark, sf_dir), null_safe=True))


@query("lifecycle_summary", """SELECT state, count(*) AS n_entries,
  round(CASE WHEN count(*) < 2 THEN 0.0 ELSE (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 / (count(*) - 1) END, 6) AS avg_hours,
  (SELECT count(*) FROM lifecycle) AS total_entries
FROM lifecycle GROUP BY state""")
def lifecycle_summary(spark, sf_dir):
    """Entries per state, mean hours between successive entries of
    the state, and the total entry count (scalar subquery)."""
    lc = views.lifecycle(spark, sf_dir)
    total = lc.select(F.count(F.lit(1))).scalar()
    return L.avg_time_in_state(lc).select("state", "n_entries", r6("avg_hours").alias("avg_hours"),
                                          total.alias("total_entries"))


@query("threats_by_state", f"""WITH {LATEST_SQL}
SELECT id, threat_input_id, ioc_id, state, ts, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY state ORDER BY ts DESC, id DESC) AS rank FROM latest) t
WHERE rank <= 50""")
def threats_by_state(spark, sf_dir):
    """The 50 newest threats currently in each state (top-k per state)."""
    lt = L.latest(views.lifecycle(spark, sf_dir))
    return L.top_per_state(lt, 50).select("id", "threat_input_id", "ioc_id", "state", "ts", "rank")


@query("input_status", f"""WITH {LATEST_NS_SQL}
SELECT threat_input_id, state, CASE WHEN state = 'new' THEN 'pending' ELSE 'processed' END AS status
FROM latest WHERE threat_input_id IS NOT NULL""")
def input_status(spark, sf_dir):
    """L3: input status implied by each threat's current state."""
    return L.input_status(L.latest(views.lifecycle(spark, sf_dir), null_safe=True))
