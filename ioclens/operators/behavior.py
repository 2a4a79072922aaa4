"""Behavioural analytics (W4, G7-G11, G31) as distributed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (ANOMALY_HIGH_SIGMA, ANOMALY_MIN_BUCKETS, ANOMALY_MIN_ROWS, ANOMALY_SIGMA,
                         LATERAL_HIGH_TYPES, LATERAL_MIN_ALERTS, LATERAL_MIN_TYPES, REPEAT_MEAN_HOURS,
                         REPEAT_MIN_COUNT, REPEAT_STD_HOURS)
from .sequences import gap_stats


def lookback(df: DataFrame, ts: str, as_of: Column | None, interval: str | None) -> DataFrame:
    """keep rows with ts >= as_of - interval (``as_of`` defaults to the
    table's latest ts, so results do not depend on the wall clock)."""
    if interval is None:
        return df
    if as_of is None:
        as_of = df.select(F.max(ts)).scalar()
    return df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {interval}"))


def repeated_values(iocs: DataFrame, ts: str = "created_at") -> DataFrame:
    """Values seen more than 3 times, with the mean and population std
    of their inter-arrival hours and the 'frequent and regular' flag."""
    counts = iocs.groupBy("value").agg(F.count(F.lit(1)).alias("occurrences"))
    rep = iocs.join(counts.where(F.col("occurrences") > REPEAT_MIN_COUNT).select("value"), "value", "left_semi")
    st = gap_stats(rep, ["value"], ts)
    return st.select(F.col("value").alias("ioc_value"), F.col("n").alias("occurrences"), "first_seen", "last_seen",
                     "avg_interval_hours", "std_interval_hours",
                     ((F.col("avg_interval_hours") < REPEAT_MEAN_HOURS) &
                      (F.col("std_interval_hours") < REPEAT_STD_HOURS)).alias("is_suspicious"))


def sighting_times(iocs: DataFrame, values: DataFrame, ts: str = "created_at") -> DataFrame:
    """Long-form timestamps of the repeated values (one row per sighting,
    instead of an unbounded list per value)."""
    return iocs.join(values.select(F.col("ioc_value").alias("value")), "value", "left_semi").select("value", ts, "id")


def hourly_counts(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Non-empty hourly buckets."""
    return df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def hourly_anomalies(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Hours whose count exceeds mean + 2 std of the hourly counts
    (population std); severity high above 3 std.  Needs >= 10 rows and
    >= 24 non-empty hours.  The statistics are scalar subqueries over the
    small hourly table, not a cross join."""
    h = hourly_counts(df, ts)
    stats = h.agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("s"), F.count(F.lit(1)).alias("k"),
                  F.sum("n").alias("rows"))
    m, s = stats.select("m").scalar(), stats.select("s").scalar()
    k, rows = stats.select("k").scalar(), stats.select("rows").scalar()
    out = h.where((F.col("n") > m + ANOMALY_SIGMA * s) & (k >= ANOMALY_MIN_BUCKETS) & (rows >= ANOMALY_MIN_ROWS))
    return out.select(F.col("hour").alias("timestamp"), F.col("n").alias("count"), m.alias("expected"),
                      ((F.col("n") - m) / s).alias("deviation"),
                      F.when(F.col("n") > m + ANOMALY_HIGH_SIGMA * s, "high").otherwise("medium").alias("severity"))


def lateral_movement(alerts: DataFrame, iocs: DataFrame) -> DataFrame:
    """Hourly alert windows with >= 3 alerts spanning >= 2 IOC
    types; severity high with >= 3 types.  Sources keep a NULL flag."""
    i = iocs.select(F.col("id").alias("ioc_id"), F.col("type").alias("ioc_type"), F.col("source").alias("ioc_source"))
    j = alerts.select("id", "ioc_id", F.date_trunc("hour", "created_at").alias("time_window")).join(i, "ioc_id", "left")
    g = j.groupBy("time_window").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.collect_set("ioc_type").alias("_types"), F.collect_set("ioc_source").alias("_sources"),
        F.count_if(F.col("ioc_type").isNotNull() & F.col("ioc_source").isNull()).alias("_null_src"))
    g = g.where((F.col("alert_count") >= LATERAL_MIN_ALERTS) & (F.size("_types") >= LATERAL_MIN_TYPES))
    return g.select("time_window", "alert_count",
                    F.array_join(F.array_sort("_types"), ",").alias("ioc_types"),
                    F.array_join(F.array_sort("_sources"), ",").alias("sources"),
                    (F.col("_null_src") > 0).alias("has_null_source"),
                    F.when(F.size("_types") >= LATERAL_HIGH_TYPES, "high").otherwise("medium").alias("severity"))
