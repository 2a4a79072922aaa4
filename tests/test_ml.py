"""ML queries are checked by invariants (row counts, label domains,
probability ranges, metric floors), not by value hashes."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from ioclens.sources import views
from ioclens.sources.tables import table
from tests.conftest import SMALL

Q = entry.queries()


def test_network_scoring_invariants(spark):
    s = Q["network_scoring"](spark, SMALL)
    n = views.flow(spark, SMALL).count()
    r = s.agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"),
              F.min("risk_score").alias("rlo"), F.max("risk_score").alias("rhi")).first()
    assert r.n == n and 0.5 <= r.lo <= r.hi <= 1.0 and 0.0 <= r.rlo <= r.rhi <= 1.0
    assert {x.prediction for x in s.select("prediction").distinct().collect()} <= {"malicious", "benign"}
    assert {x.split for x in s.select("split").distinct().collect()} == {"train", "validation", "test"}


def test_model_selection_invariants(spark):
    res = Q["network_model_training"](spark, SMALL).collect()
    assert sorted(r.model for r in res) == ["gbt", "lr", "rf"]
    assert all(0.0 <= r.validation_f1 <= 1.0 and r.train_seconds > 0 for r in res)
    winners = [r for r in res if r.accuracy is not None]
    assert len(winners) == 1 and 0.0 <= winners[0].roc_auc <= 1.0
    assert [r.model for r in Q["model_comparison"](spark, SMALL).collect()] != []


def test_clusters_and_text_models(spark):
    prof = Q["ioc_clusters"](spark, SMALL).collect()
    n = views.ioc(spark, SMALL).count()
    assert 1 <= len(prof) <= 5 and sum(p.size for p in prof) <= n and all(p.size >= 2 for p in prof)
    docs = table(spark, SMALL, "documents").count()
    rep = Q["report_analysis"](spark, SMALL)
    r = rep.agg(F.count(F.lit(1)).alias("n"), F.min("toxic_score").alias("a"), F.min("quality_score").alias("b")).first()
    assert r.n == docs and r.a >= 0.5 and r.b >= 0.5
    conv = Q["conversation_attribution"](spark, SMALL)
    assert conv.count() == table(spark, SMALL, "conversations").select("conv_id").distinct().count()
