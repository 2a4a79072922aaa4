"""Literal-row tests for set-wise operators without a registered query."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from ioclens.operators import accounts as A
from ioclens.operators import alerts as AL
from ioclens.operators import datasets as D
from ioclens.sources.files import read_blacklist, read_bulk, read_pulses

NOW = dt.datetime(2024, 2, 1)


def test_acknowledge_and_create(spark):
    alerts = spark.createDataFrame([(1, 10, "high", False), (2, 11, "low", True)], "id long, ioc_id long, severity string, acknowledged boolean")
    upd = spark.createDataFrame([(1, True, 7), (2, False, 7), (3, True, 7)], "id long, acknowledged boolean, user_id long")
    out, logs = AL.acknowledge(alerts, upd, NOW)
    got = {r.id: r for r in out.collect()}
    assert got[1].acknowledged and got[1].acknowledged_by == 7 and got[1].acknowledged_at == NOW
    assert not got[2].acknowledged and got[2].acknowledged_by is None
    assert sorted((r.alert_id, r.action) for r in logs.collect()) == [(1, "acknowledged"), (2, "unacknowledged")]
    iocs = spark.createDataFrame([(10,), (11,)], "id long")
    req = spark.createDataFrame([(5, 10, ""), (6, 99, "high")], "id long, ioc_id long, severity string")
    a, lg = AL.create_alerts(req, iocs, NOW)
    rows = a.collect()
    assert [(r.id, r.severity) for r in rows] == [(5, "medium")] and lg.count() == 1


def test_assign_unassign(spark):
    m = spark.createDataFrame([(1, 1, 10, None), (2, 1, None, 5)], "id long, account_id long, ioc_id long, threat_input_id long")
    req = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "account_id long, ioc_id long")
    new = A.assign(m, req, "ioc_id")
    assert sorted((r.account_id, r.ioc_id) for r in new.collect()) == [(1, 11), (2, 10)]
    left = A.unassign(m, spark.createDataFrame([(1, 10)], "account_id long, ioc_id long"), "ioc_id")
    assert [r.id for r in left.collect()] == [2]


def test_dataset_preparation(spark):
    df = spark.createDataFrame([(1.0, "b", 1), (None, "a", 0), (3.0, "a", 1), (float("inf"), "c", 0)], "x double, cat string, y int")
    assert D.fill_zero(df).where(F.col("x") == 0).count() == 1
    med = D.impute_median(df.where(F.col("x") < 10).union(df.where(F.col("x").isNull())), ["x"])
    assert sorted(r.x for r in med.collect()) == [1.0, 1.0, 3.0]
    clipped = D.clip_infinite(df, ["x"]).where(F.col("x") > 1e300).count()
    assert clipped == 1
    p, names = D.preprocess(df, ["x", "cat"], "y")
    assert names == ["x", "cat_encoded"] and p.count() == 3
    assert {r.cat: r.cat_encoded for r in p.collect()} == {"a": 0.0, "b": 1.0, "c": 2.0}
    model, _ = D.train_from_dataset(df.where(F.col("x") < 10), ["x", "cat"], "y")
    assert model is not None
    assert D.map_feature_name("IOC_TYPE") == "ioc_type_encoded" and D.map_feature_name("value_length") == "value_length"
    assert D.map_feature_name("first_alert") == "alert_count" and D.map_feature_name("zzz") is None


def test_registry_upsert(spark):
    reg = spark.createDataFrame([("d1", "/a", True, NOW, NOW)], "name string, path string, is_trained boolean, created_at timestamp, updated_at timestamp")
    upd = spark.createDataFrame([("d1", "/b"), ("d2", "/c")], "name string, path string")
    later = dt.datetime(2024, 3, 1)
    got = {r.name: r for r in D.register(reg, upd, later).collect()}
    assert got["d1"].path == "/b" and got["d1"].is_trained is False and got["d1"].created_at == NOW
    assert got["d2"].path == "/c" and got["d2"].created_at == later and got["d2"].updated_at == later


def test_map_with_model(spark):
    df = spark.createDataFrame([("error burst on port scan",), ("quiet",)], "text string")

    def load():
        return {"scan", "error"}

    def predict(model, pdf):
        return pd.DataFrame({"text": pdf["text"], "hit": pdf["text"].map(lambda t: any(w in t for w in model))})
    out = {r.text: r.hit for r in D.map_with_model(df, load, predict, "text string, hit boolean").collect()}
    assert out == {"error burst on port scan": True, "quiet": False}


def test_file_sources(spark, tmp_path):
    csv = tmp_path / "up.csv"
    csv.write_text("type,value\nip,1.2.3.4\n,example[.]com\nurl,HTTP://Host:80/a/\n")
    js = tmp_path / "up.json"
    js.write_text('[{"type": "hash", "value": "' + "a" * 32 + '"}, {"value": "x.org"}]')
    c = read_bulk(spark, str(csv)).collect()
    j = read_bulk(spark, str(js)).collect()
    assert [r.value for r in c] == ["1.2.3.4", "example[.]com", "HTTP://Host:80/a/"] and c[1].type is None
    assert [r.value for r in j] == ["a" * 32, "x.org"]
    pul = tmp_path / "pulses.json"
    pul.write_text('{"results": [{"created": "2024-01-02T03:04:05.123", "modified": "2024-01-03T00:00:00",'
                   ' "indicators": [{"type": "IPv4", "indicator": "1.1.1.1"}, {"type": null, "indicator": "x"},'
                   ' {"type": "FileHash-MD5", "indicator": "' + "b" * 32 + '"}]}]}')
    p = read_pulses(spark, str(pul)).collect()
    assert [(r.type, r.value) for r in p] == [("ip", "1.1.1.1"), ("hash", "b" * 32)]
    assert p[0].first_seen == dt.datetime(2024, 1, 2, 3, 4, 5, 123000)
    bl = tmp_path / "bl.json"
    bl.write_text('{"data": [{"ipAddress": "9.9.9.9", "lastReportedAt": "2024-01-05T10:00:00+00:00"}]}')
    b = read_blacklist(spark, str(bl)).collect()
    assert b[0].type == "ip" and b[0].value == "9.9.9.9" and b[0].last_seen is not None


def test_training_prep_augment_and_metric_sinks(spark, tmp_path):
    base = spark.createDataFrame([("abc", 1, 0.5, "s"), ("abcd.com", 0, 0.1, "t"), ("evil.tk", 1, 0.9, "u")],
                                 "domain string, is_malicious int, risk_score double, source string")
    prep = D.drop_short_and_leaky(base, "domain")
    assert prep.columns == ["domain", "is_malicious"] and prep.count() == 2
    seed = spark.createDataFrame([("evil.tk", 0), ("new.xyz", 1), ("more.top", 1)], "domain string, is_malicious int")
    aug = D.augment(prep, seed, "domain", target=3)
    rows = {r.domain: r.is_malicious for r in aug.collect()}
    assert len(rows) == 3 and set(rows) <= {"abcd.com", "evil.tk", "new.xyz", "more.top"}
    full = {r.domain: r.is_malicious for r in D.augment(prep, seed, "domain", target=10).collect()}
    assert full["evil.tk"] == 1 and len(full) == 4          # rows of the base table win the dedupe
    D.save_metrics(spark, {"model": "rf", "accuracy": 0.9, "f1": 0.8, "training_time": 1.5}, str(tmp_path / "m" / "rf"))
    D.save_metrics(spark, {"model": "lr", "accuracy": 0.7, "f1": 0.6, "training_time": 0.5}, str(tmp_path / "m" / "lr"))
    D.save_report(spark, {"algorithm": "rf", "features": ["a", "b"], "f1": 0.8}, str(tmp_path / "r"))
    summ = D.model_summary(spark, str(tmp_path / "m" / "*" / "*.json")).collect()
    assert [r.model for r in summ] == ["rf", "lr"]


def test_small_batch_operators(spark):
    from ioclens.functions.risk import hash_risk
    from ioclens.operators import accounts as AC
    from ioclens.operators import enrich as EN
    from ioclens.operators import ingest as IN
    acc = spark.createDataFrame([(1, "acme")], "id long, name string")
    assert sorted(tuple(r) for r in AC.default_account(acc).collect()) == [(1, "acme"), (2, "Default")]
    assert AC.default_account(AC.default_account(acc)).count() == 2
    iocs = spark.createDataFrame([("ip", "1.1.1.1")], "type string, value string")
    req = spark.createDataFrame([("ip", "1.1.1.1"), ("ip", "2.2.2.2"), ("ip", "2.2.2.2")], "type string, value string")
    made, rej = IN.create_iocs(req, iocs)
    assert [r.value for r in made.collect()] == ["2.2.2.2"] and [r.reject_reason for r in rej.collect()] == ["duplicate"]
    preds = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "id long, ioc_id long")
    keep, removed = IN.delete_predictions(preds, spark.createDataFrame([(10,)], "ioc_id long"), by="ioc_id")
    assert [r.id for r in keep.collect()] == [3] and removed.first().deleted == 2
    shape = D.dataset_shape(preds).collect()
    assert [(r.column_name, r.dtype, r.rows, r.columns) for r in shape] == [("id", "bigint", 3, 2), ("ioc_id", "bigint", 3, 2)]
    enr = spark.createDataFrame([(5, "resolved_ip", "10.0.0.1")], "ioc_id long, enrichment_type string, data string")
    geo = spark.createDataFrame([("10.0.0.1", '{"country_code": "RU", "country": "Russia", "city": "M"}')], "ip string, data string")
    g = EN.domain_geo(enr, geo).first()
    assert (g.ioc_id, g.country_code, g.city) == (5, "RU", "M")
    p = spark.createDataFrame([(0.123456,), (0.45,), (0.9,)], "p double")
    s, lvl = hash_risk("p")
    assert [(r.s, r.l) for r in p.select(s.alias("s"), lvl.alias("l")).collect()] == [(0.1235, "LOW"), (0.45, "MEDIUM"), (0.9, "HIGH")]
