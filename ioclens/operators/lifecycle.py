"""Lifecycle state log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LIFECYCLE_STATES, STATE_TO_STATUS

KEYS = ["threat_input_id", "ioc_id"]


def history(lc: DataFrame) -> DataFrame:
    """Every entry with its ordinal inside its threat (time, then id),
    ordered in time buckets so a hot threat is not sorted by one task."""
    from .sequences import rank_and_previous
    return rank_and_previous(lc, KEYS, "ts", "id", "state").drop("prev")


def latest(lc: DataFrame, null_safe: bool = False) -> DataFrame:
    """Latest entry per threat.

    Default = the reference rule: max(ts) per (input, ioc) joined back with
    plain equality, so rows with a NULL key vanish and ties duplicate.
    ``null_safe`` keeps NULL keys (<=>) and breaks ties by the larger id.
    """
    if null_safe:
        # an aggregate (partial per task), not a sorted window per threat
        last = F.max_by(F.struct(*[F.col(c) for c in lc.columns]), F.struct("ts", "id"))
        return lc.groupBy(*KEYS).agg(last.alias("_l")).select(*[F.col(f"_l.{c}").alias(c) for c in lc.columns])
    mx = lc.groupBy(*KEYS).agg(F.max("ts").alias("_max_ts"))
    a, m = lc.alias("a"), mx.alias("m")
    cond = (F.col("a.threat_input_id") == F.col("m.threat_input_id")) & \
           (F.col("a.ioc_id") == F.col("m.ioc_id")) & (F.col("a.ts") == F.col("m._max_ts"))
    return a.join(m, cond, "inner").select("a.*")


def state_counts(latest_rows: DataFrame) -> DataFrame:
    """Count per state, zero-filled for absent states (one aggregate row
    unpivoted, so no join with a state list is needed)."""
    agg = latest_rows.agg(*[F.count_if(F.col("state") == s).alias(s) for s in LIFECYCLE_STATES])
    pairs = ", ".join(f"'{s}', `{s}`" for s in LIFECYCLE_STATES)
    return agg.selectExpr(f"stack({len(LIFECYCLE_STATES)}, {pairs}) AS (state, n)")


def avg_time_in_state(lc: DataFrame) -> DataFrame:
    """Mean hours between successive entries of each state; the mean of
    consecutive gaps telescopes to (max - min) / (n - 1), so no sort."""
    from ..functions.timeutil import micros
    return (lc.groupBy("state")
              .agg(F.count(F.lit(1)).alias("n_entries"),
                   ((F.max(micros("ts")) - F.min(micros("ts"))) / 3.6e9).alias("_span"))
              .select("state", "n_entries",
                      F.when(F.col("n_entries") < 2, 0.0)
                       .otherwise(F.col("_span") / (F.col("n_entries") - 1)).alias("avg_hours")))


def transitions(lc: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Judge each entry against its threat's last accepted state:
    ``valid``, ``noop`` (same state) or ``invalid`` (first must be 'new');
    an invalid entry changes nothing.  ``known``: the states (KEYS, state)
    that threats come with."""
    from .statemaps import judged
    return judged(lc, KEYS, "ts", "id", "state", known=known)


def apply_requests(log: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L2: (rows to append, rejects, state of each touched threat) of a batch
    of requests on a log.  Both are judged in one order of time; requests
    that find their state already set add no row."""
    both = transitions(log.withColumn("_new", F.lit(False)).unionByName(requests.withColumn("_new", F.lit(True))))
    new = both.where("_new").drop("_new")
    accepted = new.where("verdict = 'valid'").drop("prev_state", "verdict")
    rejects = new.where("verdict = 'invalid'").withColumn("reject_reason", F.concat_ws("", F.lit("transition_from_"), F.coalesce("prev_state", F.lit("none")))).drop("verdict")
    last = F.max_by(F.when(F.col("verdict") == "invalid", F.col("prev_state")).otherwise(F.col("state")), F.struct("ts", "id"))
    return accepted, rejects, new.groupBy(*KEYS).agg(last.alias("state"))


def input_status(latest_rows: DataFrame) -> DataFrame:
    """L3: threat-input status implied by its latest lifecycle state."""
    m = F.create_map(*[F.lit(x) for kv in STATE_TO_STATUS.items() for x in kv])
    return latest_rows.where(F.col("threat_input_id").isNotNull()) \
        .select("threat_input_id", "state", F.coalesce(m[F.col("state")], F.lit("pending")).alias("status"))


def reject_unknown_states(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L1: (accepted, rejected) split on the state enumeration."""
    ok = F.col("state").isin(*LIFECYCLE_STATES)
    return entries.where(ok), entries.where(~ok | F.col("state").isNull())


def top_per_state(latest_rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` newest latest-entries per state (five states =
    five hot groups, so a two-level top-n)."""
    from .topn import top_n
    return top_n(latest_rows, ["state"], [F.col("ts").desc(), F.col("id").desc()], limit, ["id"])

