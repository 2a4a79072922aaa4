"""Streaming jobs.  Each builder returns a streaming DataFrame; ``run``
drives it to completion (``availableNow``) into a Parquet sink under the
shared checkpoint folder and returns the sink as a batch DataFrame.

Append mode emits a window only once the watermark has passed its end, so
the newest windows (within the watermark delay of the latest event) stay in
state; that is the streaming contract, and the oracles state it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BURST_GAP_MINUTES, BURST_MIN_ROWS, BURST_RISK, LIFECYCLE_STATES
from ..operators.alerts import rule_alerts
from ..operators.lifecycle import KEYS, transitions
from ..operators.upsert import new_keys
from ..session import scratch_path
from ..sources.versioned import Tables

WATERMARK = "10 minutes"


def run(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a streaming DataFrame to completion into a Parquet sink."""
    spark = df.sparkSession
    out, ckpt = scratch_path(spark, f"stream-{name}"), scratch_path(spark, f"stream-{name}-ckpt")
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    res = spark.read.schema(df.schema).parquet(out)
    # back to zone-less wall-clock time, like the batch tables
    return res.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp"
                        else F.col(f.name) for f in res.schema.fields])


def run_batches(df: DataFrame, name: str, fn) -> str:
    """Drive a stream through ``foreachBatch(fn(batch_df, batch_id, out))``."""
    spark = df.sparkSession
    out, ckpt = scratch_path(spark, f"stream-{name}"), scratch_path(spark, f"stream-{name}-ckpt")
    q = (df.writeStream.foreachBatch(lambda b, i: fn(b, i, out)).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return out


def hourly_counts(iocs: DataFrame) -> DataFrame:
    """S3: tumbling one-hour counts with a watermark."""
    return (iocs.withWatermark("created_at", WATERMARK).groupBy(F.window("created_at", "1 hour"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("hour"), "n"))


def sliding_counts(iocs: DataFrame, length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Sliding look-back counts."""
    return (iocs.withWatermark("created_at", WATERMARK).groupBy(F.window("created_at", length, slide))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n"))


def session_bursts(iocs: DataFrame) -> DataFrame:
    """Sessions of high-risk sightings with a 30-minute gap, >= 3 rows,
    per indicator type (a session window needs a grouping key besides the
    window).  Unlike W5, low-risk rows in between do not close a session."""
    hi = iocs.where(F.col("risk_score") > BURST_RISK).withWatermark("created_at", WATERMARK)
    g = hi.groupBy("type", F.session_window("created_at", f"{BURST_GAP_MINUTES} minutes")).agg(
        F.count(F.lit(1)).alias("ioc_count"), F.min("created_at").alias("start_time"),
        F.max("created_at").alias("end_time"), F.avg(F.col("risk_score").cast("double")).alias("avg_risk"))
    return g.where(F.col("ioc_count") >= BURST_MIN_ROWS).select("type", "start_time", "end_time", "ioc_count", "avg_risk")


def lateral_windows(alerts: DataFrame, iocs_static: DataFrame) -> DataFrame:
    """Stream-static join of alerts to IOCs, hourly windows with >= 3
    alerts and >= 2 IOC types."""
    i = iocs_static.select(F.col("id").alias("ioc_id"), F.col("type").alias("ioc_type"), F.col("source").alias("ioc_source"))
    j = alerts.join(i, "ioc_id", "left").withWatermark("created_at", WATERMARK)
    g = j.groupBy(F.window("created_at", "1 hour")).agg(
        F.count(F.lit(1)).alias("alert_count"), F.collect_set("ioc_type").alias("types"),
        F.collect_set("ioc_source").alias("sources"))
    g = g.where((F.col("alert_count") >= 3) & (F.size("types") >= 2))
    return g.select(F.col("window.start").alias("time_window"), "alert_count",
                    F.array_join(F.array_sort("types"), ",").alias("ioc_types"),
                    F.array_join(F.array_sort("sources"), ",").alias("sources"),
                    F.when(F.size("types") >= 3, "high").otherwise("medium").alias("severity"))


def dedupe_keys(iocs: DataFrame) -> DataFrame:
    """S2 as a streaming operator: each (type, value) once, however late and
    in whatever micro-batch it comes again.  Its state holds all keys."""
    return iocs.select("type", "value").dropDuplicates(["type", "value"])


KEY_TABLE = {"keys": ("type string, value string", ["type", "value"])}


def distinct_batches(iocs: DataFrame, name: str = "distinct") -> Tables:
    """S2 without a growing state: the table of distinct keys is itself what
    a batch looks its keys up in, and only in the buckets they fall in."""
    tables = Tables(iocs.sparkSession, scratch_path(iocs.sparkSession, f"stream-{name}-tables"), KEY_TABLE)

    def per_batch(batch: DataFrame, batch_id: int, out: str) -> None:
        if tables.done(batch_id):
            return
        found = batch.select("type", "value").distinct()
        tables.commit(batch_id, appends={"keys": new_keys(found, tables.read("keys", tables.touched("keys", found)), ["type", "value"])})

    run_batches(iocs, name, per_batch)
    return tables


ALERT_TABLE = {"alerts": ("ioc_id long, type string, risk_score double, rule_name string, severity string, message string", ["ioc_id", "message"])}


def rule_alert_batches(iocs: DataFrame, name: str = "rule-alerts") -> Tables:
    """Rule alerts appended once per (IOC, message).  A batch reads and
    adds to the buckets its own hits fall in; a replayed batch is already in."""
    tables = Tables(iocs.sparkSession, scratch_path(iocs.sparkSession, f"stream-{name}-tables"), ALERT_TABLE)

    def per_batch(batch: DataFrame, batch_id: int, out: str) -> None:
        if tables.done(batch_id):
            return
        none = batch.sparkSession.createDataFrame([], ALERT_TABLE["alerts"][0])
        hits = rule_alerts(batch, none).dropDuplicates(["ioc_id", "message"])
        seen = tables.read("alerts", tables.touched("alerts", hits))
        tables.commit(batch_id, appends={"alerts": hits.join(seen.select("ioc_id", "message"), ["ioc_id", "message"], "left_anti")})
    run_batches(iocs, name, per_batch)
    return tables


# ----------------------------------------------------- lifecycle state machine
LIFECYCLE_TABLES = {
    "verdicts": ("id long, threat_input_id long, ioc_id long, prev_state string, state string, verdict string", []),
    "states": ("threat_input_id long, ioc_id long, state string", ["threat_input_id", "ioc_id"]),
}


def lifecycle_state_machine(lifecycle: DataFrame, name: str = "lifecycle") -> Tables:
    """Each entry judged against its threat's last accepted state.  The
    state of all threats is a keyed table, of which a batch reads and rewrites
    the buckets of its own threats, so neither memory nor a batch's work grows
    with the threats ever seen; a threat with a third of a batch is judged by
    composed state maps in many tasks.  Unknown states are left out (L1)."""
    tables = Tables(lifecycle.sparkSession, scratch_path(lifecycle.sparkSession, f"stream-{name}-tables"), LIFECYCLE_TABLES)

    def per_batch(batch: DataFrame, batch_id: int, out: str) -> None:
        if tables.done(batch_id):
            return
        staged = f"{tables.path}/_staged/{batch_id}"
        rows = batch.where(F.col("state").isin(*LIFECYCLE_STATES))
        touched = tables.touched("states", rows)
        known = tables.read("states", touched)
        transitions(rows, known).write.mode("overwrite").parquet(staged)
        done = batch.sparkSession.read.parquet(staged)
        after = F.when(F.col("verdict") == "invalid", F.col("prev_state")).otherwise(F.col("state"))
        last = done.groupBy(*KEYS).agg(F.max_by(after, F.struct("ts", "id")).alias("state")).where("state IS NOT NULL")
        both = known.withColumn("v", F.lit(0)).unionByName(last.withColumn("v", F.lit(1)))
        tables.commit(batch_id, appends={"verdicts": done}, replaces={"states": (both.groupBy(*KEYS).agg(F.max_by("state", "v").alias("state")), touched)})

    run_batches(lifecycle, name, per_batch)
    return tables


# --------------------------------------------------------- spike detection
DELAY_US = 10 * 60 * 1_000_000


SPIKE_TABLES = {
    "pending": ("type string, hour timestamp, n long", ["type", "hour"]),
    "stats": ("type string, k long, s double, s2 double", ["type"]),
    "clock": ("one long, m long", ["one"]),
    "spikes": ("type string, hour timestamp, n long, baseline_mean double, baseline_std double, prior_hours long, is_spike boolean", []),
}


def hourly_spikes(iocs: DataFrame, name: str = "spikes") -> Tables:
    """Per-type hourly spikes against the trailing baseline of all
    earlier closed hours (mean + 2 std, needs >= 24 hours).

    Each micro-batch is first reduced to (type, hour) counts, written and
    read by what follows -- a partial aggregation across tasks, so a hot type
    never lands raw in one task.  The state is keyed: counts of hours still
    open under the watermark, the running (k, sum, sum of squares) of each
    type, and the clock.  Hours close when max event time - 10 minutes passes
    their end; closed hours are scored in order with window sums over the few
    closed rows.  Scores and state of a batch are one version of all tables,
    of which only touched buckets are written; a batch that is in, or died
    halfway, is never counted twice."""
    from ..functions.timeutil import micros
    tables = Tables(iocs.sparkSession, scratch_path(iocs.sparkSession, f"stream-{name}-tables"), SPIKE_TABLES)

    def per_batch(batch: DataFrame, batch_id: int, out: str) -> None:
        if tables.done(batch_id):
            return
        spark = batch.sparkSession
        staged = f"{tables.path}/_staged/{batch_id}"
        batch.groupBy("type", F.date_trunc("hour", "created_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.max(micros("created_at")).alias("m")) \
            .write.mode("overwrite").parquet(staged)
        new = spark.read.parquet(staged)
        pending, stats = tables.read("pending"), tables.read("stats")
        clock = tables.read("clock").select("m").unionByName(new.select("m")).agg(F.lit(0).cast("long").alias("one"), F.max("m").alias("m"))
        wm = clock.select("m").scalar() - DELAY_US
        every = pending.unionByName(new.select("type", "hour", "n")).groupBy("type", "hour").agg(F.sum("n").alias("n"))
        over = micros("hour") + 3_600_000_000 <= wm
        closed, still = every.where(over), every.where(~over)
        w = Window.partitionBy("type").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
        j = closed.join(stats, "type", "left").select(
            "type", "hour", "n",
            (F.coalesce("k", F.lit(0)) + F.coalesce(F.count(F.lit(1)).over(w), F.lit(0))).alias("_k"),
            (F.coalesce("s", F.lit(0.0)) + F.coalesce(F.sum("n").over(w), F.lit(0)).cast("double")).alias("_s"),
            (F.coalesce("s2", F.lit(0.0)) + F.coalesce(F.sum(F.col("n") * F.col("n")).over(w), F.lit(0)).cast("double")).alias("_s2"))
        mean = F.when(F.col("_k") > 0, F.col("_s") / F.col("_k")).otherwise(0.0)
        std = F.when(F.col("_k") > 0, F.sqrt(F.greatest(F.col("_s2") / F.col("_k") - mean * mean, F.lit(0.0)))).otherwise(0.0)
        scored = j.select("type", "hour", "n", mean.alias("baseline_mean"), std.alias("baseline_std"), F.col("_k").alias("prior_hours"),
                          ((F.col("_k") >= 24) & (F.col("n") > mean + 2 * std)).alias("is_spike"))
        added = closed.groupBy("type").agg(F.count(F.lit(1)).alias("k"), F.sum("n").cast("double").alias("s"), F.sum(F.col("n") * F.col("n")).cast("double").alias("s2"))
        of_stats = tables.touched("stats", added)
        sums = tables.read("stats", of_stats).unionByName(added).groupBy("type").agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
        of_pending = tables.touched("pending", new, closed)
        left = still.where(tables.bucket("pending").isin(of_pending))
        tables.commit(batch_id, appends={"spikes": scored}, replaces={"pending": (left, of_pending), "stats": (sums, of_stats), "clock": (clock, tables.touched("clock", clock))})

    run_batches(iocs, name, per_batch)
    return tables


# ------------------------------------------------- stream-stream join
def monitored_rescore(iocs: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Sightings joined with enrichments arriving within an hour of
    them (both sides watermarked), with the risk contributions (R1-R3)."""
    from ..operators.enrich import contributions
    i = iocs.select(F.col("id").alias("ioc_id"), "type", F.col("created_at").alias("seen_at")).withWatermark("seen_at", "1 hour")
    e = enrichments.withWatermark("created_at", "1 hour").alias("e")
    j = e.join(i, (F.col("e.ioc_id") == i.ioc_id) & (F.col("e.created_at") >= F.col("seen_at"))
               & (F.col("e.created_at") <= F.col("seen_at") + F.expr("INTERVAL 1 HOUR")), "inner")
    j = j.select(i.ioc_id.alias("ioc_id"), F.col("e.id").alias("enrichment_id"), F.col("e.enrichment_type").alias("enrichment_type"),
                 F.col("e.data").alias("data"))
    return contributions(j).withColumn("enrichment_id", F.col("enrichment_id"))


# ------------------------------------------------------ streaming scoring
def score_stream(flows: DataFrame, model) -> DataFrame:
    """Apply a fitted pipeline to a stream."""
    from ..functions.network import network_features
    out = model.transform(network_features(flows))
    return out.select("l_orderkey", "l_linenumber", F.col("prediction").cast("int").alias("prediction"))


LATE_TABLES = {"counts": ("batch_id long, rows long, late long", []), "clock": ("one long, m long", ["one"])}


def count_late(stream: DataFrame, ts: str = "created_at", name: str = "late") -> Tables:
    """Per micro-batch, how many rows arrive behind the watermark (max
    event time of earlier batches - 10 minutes).  Spark guarantees only
    that rows within the watermark are kept -- older rows may or may not be
    dropped by a stateful operator -- so late arrivals are reported here
    explicitly.  Counts and the clock are one version of two tables."""
    from ..functions.timeutil import micros
    tables = Tables(stream.sparkSession, scratch_path(stream.sparkSession, f"stream-{name}-tables"), LATE_TABLES)

    def per_batch(batch: DataFrame, batch_id: int, out: str) -> None:
        if tables.done(batch_id):
            return
        before = tables.read("clock").agg(F.max("m").alias("m"))
        wm = before.select("m").scalar() - DELAY_US
        now = batch.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.count_if(micros(ts) < wm), F.lit(0)).alias("late"), F.max(micros(ts)).alias("m"))
        clock = before.unionByName(now.select("m")).agg(F.lit(0).cast("long").alias("one"), F.max("m").alias("m"))
        tables.commit(batch_id, appends={"counts": now.select(F.lit(batch_id).cast("long").alias("batch_id"), "rows", "late")},
                      replaces={"clock": (clock, tables.touched("clock", clock))})

    run_batches(stream, name, per_batch)
    return tables
