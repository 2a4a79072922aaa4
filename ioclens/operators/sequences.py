"""Sequence operators that must not funnel a hot key (or the whole table)
into one task: inter-arrival statistics per key (W4) and global burst
segmentation (W5).

Both cut the ordered sequence into buckets.  By default a bucket is a range
partition of the ordering key (``repartitionByRange`` samples split points,
so buckets are balanced even when one value or one hour holds a third of
the rows); ``unit='hour'`` etc. buckets by time instead.  Ordered work
(``lag``/``lead``, running sums) runs inside each bucket; the links between
consecutive buckets come from a per-bucket summary table with one row per
bucket.  That summary is joined back without a broadcast hint, so AQE
broadcasts it only when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BURST_GAP_MINUTES, BURST_HIGH_SEVERITY, BURST_MIN_INPUT, BURST_MIN_ROWS, BURST_RISK
from ..functions.timeutil import micros

US_PER_HOUR = 3.6e9


def _bucketed(df: DataFrame, order: list[str], unit: str | None, ts: str, buckets: int | None) -> DataFrame:
    """Add ``_b``: a bucket id monotone in ``order`` (range partition id).
    Only for plans that read the result once (the id comes from the
    exchange, so two evaluations could number buckets differently)."""
    if unit:
        return df.withColumn("_b", F.date_trunc(unit, F.col(ts)))
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).withColumn("_b", F.spark_partition_id())


def _time_buckets(df: DataFrame, ts: str, unit: str | None, buckets: int | None) -> DataFrame:
    """Add ``_b``: a deterministic bucket of ``ts`` -- by time unit, or by
    approximate quantiles of the event time (one sketch aggregate; only the
    split points reach the driver), so a busy hour is split across buckets."""
    if unit:
        return df.withColumn("_b", F.date_trunc(unit, F.col(ts)))
    from pyspark.ml.feature import Bucketizer
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = df.withColumn("_m", micros(ts).cast("double"))
    qs = m.approxQuantile("_m", [i / n for i in range(1, n)], 0.0005) if n > 1 else []
    splits = [float("-inf")] + sorted(set(q for q in qs if q == q)) + [float("inf")]
    return Bucketizer(splits=splits, inputCol="_m", outputCol="_b", handleInvalid="keep").transform(m).drop("_m")


def gap_stats(df: DataFrame, keys: list[str], ts: str, unit: str | None = None, buckets: int | None = None) -> DataFrame:
    """Per key: n, first/last ts, mean and population std (hours) of the
    gaps between consecutive sorted timestamps."""
    rows = _bucketed(df.select(*keys, F.col(ts).alias("_ts")), [*keys, "_ts"], unit, "_ts", buckets)
    w = Window.partitionBy(*keys, "_b").orderBy("_ts")
    d = (micros("_ts") - micros(F.lag("_ts").over(w))) / US_PER_HOUR
    per_b = (rows.withColumn("_d", d)
                 .groupBy(*keys, "_b")
                 .agg(F.count(F.lit(1)).alias("_n"), F.min("_ts").alias("_first"), F.max("_ts").alias("_last"),
                      F.sum("_d").alias("_sd"), F.sum(F.col("_d") * F.col("_d")).alias("_sd2")))
    wk = Window.partitionBy(*keys).orderBy("_b")
    gap = (micros("_first") - micros(F.lag("_last").over(wk))) / US_PER_HOUR
    per_b = per_b.withColumn("_g", gap)
    tot = per_b.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.min("_first").alias("first_seen"), F.max("_last").alias("last_seen"),
        (F.sum(F.coalesce("_sd", F.lit(0.0))) + F.sum(F.coalesce("_g", F.lit(0.0)))).alias("_s1"),
        (F.sum(F.coalesce("_sd2", F.lit(0.0))) + F.sum(F.coalesce(F.col("_g") * F.col("_g"), F.lit(0.0)))).alias("_s2"))
    m = F.col("n") - 1
    mean = F.when(m > 0, F.col("_s1") / m).otherwise(F.lit(0.0))
    var = F.when(m > 0, F.col("_s2") / m - mean * mean).otherwise(F.lit(0.0))
    return tot.select(*keys, "n", "first_seen", "last_seen", mean.alias("avg_interval_hours"),
                      F.sqrt(F.greatest(var, F.lit(0.0))).alias("std_interval_hours"))


def bursts(iocs: DataFrame, ts: str = "created_at", risk: str = "risk_score", flush_open: bool = False,
           unit: str | None = None, buckets: int | None = None) -> DataFrame:
    """W5 burst segmentation over all rows in (ts, id) order.

    A row with risk > 0.7 joins the open burst; if the next row (of any
    risk) comes more than 30 minutes later the burst closes.  Bursts with
    >= 3 rows are kept.  A burst still open at the end is kept only if the
    last row is high-risk (reference rule) or ``flush_open``.  Nothing is
    returned for fewer than 5 input rows.
    """
    rows = _time_buckets(iocs.select("id", F.col(ts).alias("_ts"), F.col(risk).alias("_risk"), "type"),
                         "_ts", unit, buckets)
    wb = Window.partitionBy("_b").orderBy("_ts", "id")
    rows = rows.withColumn("_next_in", F.lead("_ts").over(wb))
    # first timestamp of each bucket, and of the next non-empty bucket
    bk = rows.groupBy("_b").agg(F.min("_ts").alias("_first"))
    bk = bk.withColumn("_next_first", F.lead("_first").over(Window.orderBy("_b")))
    rows = rows.join(bk.select("_b", "_next_first"), "_b")
    nxt = F.coalesce("_next_in", "_next_first")
    high = F.col("_risk") > BURST_RISK
    close = high & nxt.isNotNull() & ((micros(nxt) - micros("_ts")) > BURST_GAP_MINUTES * 60 * 1_000_000)
    rows = rows.withColumn("_close", close.cast("int")).withColumn("_last", nxt.isNull())
    # burst id = closing flags before this row: earlier buckets + earlier in bucket
    fl = rows.groupBy("_b").agg(F.sum("_close").alias("_nf"))
    fl = fl.withColumn("_off", F.coalesce(F.sum("_nf").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(fl.select("_b", "_off"), "_b")
    before = F.coalesce(F.sum("_close").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("burst_id", (F.col("_off") + before).cast("bigint")).where(high)
    total = iocs.select(F.count(F.lit(1))).scalar()
    g = rows.groupBy("burst_id").agg(
        F.min("_ts").alias("start_time"), F.max("_ts").alias("end_time"),
        F.count(F.lit(1)).alias("ioc_count"), F.avg(F.col("_risk").cast("double")).alias("avg_risk"),
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("ioc_types"),
        F.max("_close").alias("_closed"), F.max(F.col("_last").cast("int")).alias("_ends"))
    closed = (F.col("_closed") == 1) | (F.col("_ends") == 1) | F.lit(flush_open)
    g = g.where((F.col("ioc_count") >= BURST_MIN_ROWS) & closed & (total >= BURST_MIN_INPUT))
    return g.select("burst_id", "start_time", "end_time",
                    ((micros("end_time") - micros("start_time")) / 6e7).alias("duration_minutes"),
                    "ioc_count", "avg_risk", "ioc_types",
                    F.when(F.col("ioc_count") >= BURST_HIGH_SEVERITY, "high").otherwise("medium").alias("severity"))


def _eq_null_safe(a: DataFrame, b: DataFrame, cols: list[str]):
    cond = None
    for c in cols:
        x = a[c].eqNullSafe(b[c])
        cond = x if cond is None else (cond & x)
    return cond


def rank_and_previous(df: DataFrame, keys: list[str], ts: str, tie: str, value: str,
                      unit: str | None = None, buckets: int | None = None) -> DataFrame:
    """Per key (NULL keys form their own group), ordered by (ts, tie): the
    1-based ordinal ``seq`` and the previous row's ``value`` as ``prev``.

    Rows are split into event-time buckets (deterministic, balanced by
    quantiles), ordered inside (key, bucket); ordinals continue from the
    earlier buckets' counts and the first row of a bucket takes the last
    value of the key's previous non-empty bucket -- both from a summary
    with one row per (key, bucket).  A key holding a third of the rows is
    thus ordered by many tasks, not one."""
    b = _time_buckets(df, ts, unit, buckets)
    w = Window.partitionBy(*keys, "_b").orderBy(ts, tie)
    rows = b.withColumn("_rn", F.row_number().over(w)).withColumn("_lag", F.lag(value).over(w))
    summ = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.max_by(value, F.struct(ts, tie)).alias("_last"))
    wk = Window.partitionBy(*keys).orderBy("_b")
    summ = summ.withColumn("_off", F.coalesce(F.sum("_n").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
               .withColumn("_prev_last", F.lag("_last").over(wk)).drop("_n", "_last")
    s = summ.alias("s")
    r = rows.alias("r")
    j = r.join(s, _eq_null_safe(r, s, [*keys, "_b"]), "inner")
    out_cols = [F.col(f"r.{c}") for c in df.columns]
    return j.select(*out_cols, (F.col("s._off") + F.col("r._rn")).alias("seq"),
                    F.when(F.col("r._rn") == 1, F.col("s._prev_last")).otherwise(F.col("r._lag")).alias("prev"))
