"""Streaming state across several micro-batches equals the batch result."""

import time

from pyspark.sql import functions as F

from ioclens.operators import lifecycle as L
from ioclens.sources import views
from ioclens.sources.tables import table
from ioclens.streaming import jobs as J
from ioclens.streaming import sources as S
from tests.conftest import SMALL


def _split_events(spark, tmp_path):
    """Events written as three time-ordered files (one append per day range)."""
    ev = table(spark, SMALL, "events")
    d = str(tmp_path / "ev")
    bounds = ["2024-01-01", "2024-01-11", "2024-01-21", "2024-02-01"]
    for lo, hi in zip(bounds, bounds[1:]):
        part = ev.where((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz")))
        part.coalesce(1).write.mode("append").parquet(d)
        time.sleep(1.1)   # the file source orders files by modification time
    return d


def test_lifecycle_state_machine_across_batches(spark, tmp_path):
    d = _split_events(spark, tmp_path)
    lc_stream = views.lifecycle_from_events(S.events(spark, d, files_per_trigger=1, pattern="*.parquet"))
    tables = J.lifecycle_state_machine(lc_stream, "lc-multi")
    got = tables.read("verdicts")
    want = L.transitions(views.lifecycle(spark, SMALL)).select("id", "prev_state", "state", "verdict")
    g = sorted(tuple(r) for r in got.select("id", "prev_state", "state", "verdict").collect())
    w = sorted(tuple(r) for r in want.collect())
    assert len(g) == len(w) and g == w
    # one row a threat that was ever accepted, however many batches came
    after = F.when(F.col("verdict") == "invalid", F.col("prev_state")).otherwise(F.col("state"))
    last = L.transitions(views.lifecycle(spark, SMALL)).groupBy(*L.KEYS).agg(F.max_by(after, F.struct("ts", "id")).alias("state")).where("state IS NOT NULL")
    key = lambda df: sorted((tuple(r) for r in df.select(*L.KEYS, "state").collect()), key=str)
    assert key(tables.read("states")) == key(last)


def test_distinct_keys_across_batches(spark, tmp_path):
    d = _split_events(spark, tmp_path)
    stream = views.ioc_from_events(S.events(spark, d, files_per_trigger=1, pattern="*.parquet"))
    tables = J.distinct_batches(stream, "distinct-multi")
    got = sorted(tuple(r) for r in tables.read("keys").collect())
    assert got == sorted(tuple(r) for r in views.ioc(spark, SMALL).select("type", "value").distinct().collect())
    assert tables.state()["version"] == 3


def test_hourly_counts_across_batches(spark, tmp_path):
    d = _split_events(spark, tmp_path)
    s = views.ioc_from_events(S.events(spark, d, files_per_trigger=1, pattern="*.parquet"))
    got = {r.hour: r.n for r in J.run(J.hourly_counts(s), "hourly-multi").collect()}
    ioc = views.ioc(spark, SMALL)
    batch = {r.hour: r.n for r in ioc.groupBy(F.date_trunc("hour", "created_at").alias("hour")).count()
             .withColumnRenamed("count", "n").collect()}
    assert got and all(batch[h] == n for h, n in got.items())
    # every hour closed by the final watermark is emitted
    last = max(batch)
    assert set(batch) - set(got) <= {last}


def test_late_rows_are_counted(spark, tmp_path):
    """A file of older events arriving after newer ones is behind the
    watermark; every one of its rows is counted as late."""
    ev = table(spark, SMALL, "events")
    d = str(tmp_path / "late")
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    ev.where(F.col("ts") >= cut).coalesce(1).write.mode("append").parquet(d)   # newer first
    time.sleep(1.1)                                                            # distinct file times
    old = ev.where(F.col("ts") < cut)
    old.coalesce(1).write.mode("append").parquet(d)                            # then older
    def stream():
        return views.ioc_from_events(S.events(spark, d, files_per_trigger=1, pattern="*.parquet"))
    counts = J.count_late(stream()).read("counts")
    late = counts.agg(F.sum("late")).first()[0]
    assert late == old.count()
    per_batch = sorted((r.batch_id, r.late) for r in counts.collect())
    assert per_batch[0][1] == 0 and per_batch[-1][1] == old.count()


def test_spike_state_across_batches(spark, tmp_path):
    """Pending hours and the running baseline carried across three
    micro-batches give the same scored hours as one batch."""
    d = _split_events(spark, tmp_path)

    def scored(stream, name):
        return sorted(tuple(r) for r in J.hourly_spikes(stream, name).read("spikes")
                      .select("type", "hour", "n", F.round("baseline_mean", 9), F.round("baseline_std", 9),
                              "prior_hours", "is_spike").collect())
    multi = scored(views.ioc_from_events(S.events(spark, d, files_per_trigger=1, pattern="*.parquet")), "spk-multi")
    single = scored(views.ioc_from_events(S.events(spark, SMALL)), "spk-single")
    assert multi and multi == single


def test_spikes_survive_a_crash_before_the_commit(spark, tmp_path, monkeypatch):
    """A batch that dies between its writes and its commit is replayed by the
    stream and counted once."""
    import pytest
    from ioclens.sources.versioned import Tables
    d = _split_events(spark, tmp_path)
    path, ckpt = str(tmp_path / "tables"), str(tmp_path / "ckpt")
    names = {"stream-crash-tables": path, "stream-crash-ckpt": ckpt, "stream-crash": str(tmp_path / "out")}
    monkeypatch.setattr(J, "scratch_path", lambda spark, name: names[name])
    stream = lambda: views.ioc_from_events(S.events(spark, d, files_per_trigger=1, pattern="*.parquet"))
    publish, calls = Tables._publish, []

    def die_once(self, state):
        calls.append(state["version"])
        if len(calls) == 2:
            raise RuntimeError("lost")
        publish(self, state)
    monkeypatch.setattr(Tables, "_publish", die_once)
    with pytest.raises(Exception):
        J.hourly_spikes(stream(), "crash")
    got = J.hourly_spikes(stream(), "crash").read("spikes")
    monkeypatch.undo()
    want = J.hourly_spikes(stream(), "whole").read("spikes")
    key = lambda df: sorted(tuple(r) for r in df.select("type", "hour", "n", "prior_hours", F.round("baseline_mean", 9)).collect())
    assert calls[:3] == [1, 2, 2] and key(got) == key(want)
