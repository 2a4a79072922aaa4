"""Explanation features: counts and dates come from the tables."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as entry
from ioclens.operators import explain as E
from ioclens.sources import views
from tests.conftest import SMALL

T0 = dt.datetime(2024, 1, 1)


def test_enrichment_counts_and_last_seen(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    preds = spark.createDataFrame([(1, 10, "m", "benign", 0.9), (2, 11, "m", "benign", 0.9), (3, 12, "m", "malicious", 0.9),
                                   (4, 14, "m", "benign", 0.9), (5, 99, "m", "benign", 0.9)],
                                  "id long, ioc_id long, model_name string, prediction string, confidence double")
    iocs = spark.createDataFrame([(10, "ip", "a", 0.5, day(0)), (11, "ip", "a", 0.5, day(60)), (12, "url", "a", 0.5, day(5)),
                                  (13, "ip", "b", 0.5, day(99)), (14, "ip", None, 0.5, day(40)), (15, "ip", None, 0.5, day(90))],
                                 "id long, type string, value string, risk_score double, created_at timestamp_ntz")
    alerts = spark.createDataFrame([(1, 10), (2, 10)], "id long, ioc_id long")
    enr = spark.createDataFrame([(n, 10) for n in range(2)] + [(2, 11)] + [(n, 12) for n in range(3, 9)], "id long, ioc_id long")
    feats = E.explanation_features(preds, iocs, alerts, enr, F.lit(day(100)))
    got = {r.id: (r.enrichment_count, r.alert_count, r.days_since_first_seen, r.days_since_last_seen) for r in feats.collect()}
    assert got == {1: (2, 2, 100, 40), 2: (1, 0, 40, 40), 3: (6, 0, 95, 95), 4: (0, 0, 60, 60), 5: (0, 0, 0, 0)}
    codes = {r.id: r.contributing_factors for r in E.explain(feats).collect()}
    assert codes == {1: "long_known", 2: "few_enrichments,long_known", 3: "many_enrichments",
                     4: "few_enrichments,long_known", 5: "low_risk_score,few_enrichments"}


def test_queries_use_the_enrichment_table(spark):
    ids = views.prediction(spark, SMALL).select("ioc_id").distinct()
    want = dict(views.enrichment(spark, SMALL).join(ids, "ioc_id").groupBy("ioc_id").count().collect())
    ioc_of = dict(views.prediction(spark, SMALL).select("id", "ioc_id").collect())
    rows = entry.queries()["feature_importance"](spark, SMALL).where("feature = 'enrichment_count'").collect()
    assert any(want.values()) and all(r.value == want.get(ioc_of[r.id], 0) for r in rows)
    for r in entry.queries()["prediction_explanations"](spark, SMALL).where("prediction <> 'malicious'").collect():
        assert ("few_enrichments" in r.contributing_factors.split(",")) == (want.get(r.ioc_id, 0) < 2)
