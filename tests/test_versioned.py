"""Tables under one version: commits, replays, crashes between writes."""

import datetime as dt

import pytest

from ioclens.operators import ingest as I
from ioclens.sources.versioned import Tables

NOW = dt.datetime(2024, 1, 5)
REQUESTS = "input_id string, type string, value string, account_id long"
FIRST = [("a", None, "http://Example.com/x", 7), ("b", None, "1.2.3[.]4", None), ("c", "ip", "2001:DB8:0::1", None), ("d", None, " ", 7), ("e", "email", "x@y.z", None), ("f", None, "http://example.com/x", None)]
SECOND = [("g", None, "1.2.3.4", 9), ("h", None, "good.example.org", None), ("i", None, "300.1.1.1", None)]


def ingest(spark, tables, rows, batch, days=0):
    return I.ingest_batch(tables, spark.createDataFrame(rows, REQUESTS), batch, NOW + dt.timedelta(days=days))


def dump(tables):
    return {name: sorted((tuple(r) for r in tables.read(name).collect()), key=str) for name in tables.schemas}


def test_batches_reach_all_tables_and_replays_change_nothing(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"), I.INGEST_TABLES)
    assert ingest(spark, tables, FIRST, 1) and ingest(spark, tables, SECOND, 2, days=1)
    got = dump(tables)
    assert [(r[0], r[1], r[4], r[5]) for r in got["ioc"]] == [
        ("domain", "good.example.org", NOW + dt.timedelta(days=1), NOW + dt.timedelta(days=1)), ("ip", "1.2.3.4", NOW, NOW + dt.timedelta(days=1)),
        ("ip", "2001:db8::1", NOW, NOW), ("url", "http://example.com/x", NOW, NOW)]
    assert [r[0] for r in got["threat_input"]] == ["a", "b", "c", "f", "g", "h"] == [r[0] for r in got["lifecycle"]] == [r[0] for r in got["prediction"]]
    assert [(r[0], r[3]) for r in got["mapping"]] == [(7, "a"), (9, "g")]
    assert [r[:4] for r in got["job"]] == [(1, 6, 4, 2), (2, 3, 2, 1)]
    assert not ingest(spark, tables, SECOND, 2, days=3) and not ingest(spark, tables, FIRST, 1)
    assert dump(tables) == got and tables.state()["version"] == 2


def test_a_crash_between_writes_leaves_the_old_version_of_all_tables(spark, tmp_path, monkeypatch):
    tables = Tables(spark, str(tmp_path / "t"), I.INGEST_TABLES)
    ingest(spark, tables, FIRST, 1)
    before = dump(tables)

    def die(self, state):
        raise RuntimeError("executor lost")
    with monkeypatch.context() as m:
        m.setattr(Tables, "_publish", die)
        with pytest.raises(RuntimeError):
            ingest(spark, tables, SECOND, 2, days=1)
    assert dump(tables) == before
    ingest(spark, tables, SECOND, 2, days=1)
    whole = Tables(spark, str(tmp_path / "u"), I.INGEST_TABLES)
    ingest(spark, whole, FIRST, 1)
    ingest(spark, whole, SECOND, 2, days=1)
    assert dump(tables) == dump(whole)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"), {"kv": ("k long, v long", ["k"])}, buckets=16)
    rows = spark.range(1000).selectExpr("id AS k", "0L AS v")
    t.commit(1, replaces={"kv": (rows, t.touched("kv", rows))})
    one = spark.createDataFrame([(5, 1)], "k long, v long")
    touched = t.touched("kv", one)
    t.commit(2, replaces={"kv": (t.read("kv", touched).where("k <> 5").unionByName(one), touched)})
    folders = t.state()["folders"]["kv"]
    assert len(touched) == 1 and sum(f[0].startswith("v=2/") for f in folders.values()) == 1
    assert t.read("kv").count() == 1000 and t.read("kv").where("v = 1").count() == 1
    gone = t.read("kv", touched)
    t.commit(3, replaces={"kv": (gone.limit(0), touched)})  # a bucket may end empty
    assert t.read("kv").count() == 1000 - gone.count()


def test_two_writers_cannot_publish_one_version(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"), {"kv": ("k long", [])})
    state = t.state()
    t.commit(1, appends={"kv": spark.range(3).toDF("k")})
    with pytest.raises(OSError):
        t._publish({"version": state["version"] + 1, "batch": 1, "folders": {}})
    assert t.read("kv").count() == 3
