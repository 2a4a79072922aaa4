"""Property checks on operators."""

from pyspark.sql import functions as F

from ioclens.operators import graph as G
from ioclens.operators.dashboard import band_counts
from ioclens.operators.topn import top_n
from ioclens.operators.upsert import merge_upsert
from ioclens.sources import views
from tests.conftest import SMALL


def test_band_counts_sum_to_non_null_total(spark):
    r = band_counts(views.ioc(spark, SMALL)).collect()[0]
    assert r.critical + r.high + r.medium + r.low == r.total


def test_components_partition_and_direction_invariance(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10)], "src long, dst long")
    a = {r.id: r.component for r in G.connected_components(e).collect()}
    b = {r.id: r.component for r in G.connected_components(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).collect()}
    assert a == b
    assert a == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8}


def test_long_chain_converges(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    comp = G.connected_components(e)
    assert comp.select(F.countDistinct("component")).first()[0] == 1
    assert comp.count() == n + 1


def test_top_n_exact_with_hot_group(spark):
    rows = [("hot", i) for i in range(2000)] + [("cold", i) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, id long")
    t = top_n(df, ["g"], [F.col("id").desc()], 5, ["id"], salt_buckets=16)
    got = sorted((r.g, r.id, r["rank"]) for r in t.collect())
    assert sorted(x[1:] for x in got if x[0] == "hot") == sorted((1999 - k, k + 1) for k in range(5))
    assert sorted(x[1] for x in got if x[0] == "cold") == [2, 3, 4, 5, 6]


def test_merge_upsert(spark):
    cur = spark.createDataFrame([("ip", "1.1.1.1", "a", 1), ("ip", "2.2.2.2", "b", 2)], "type string, value string, source string, n int")
    upd = spark.createDataFrame([("ip", "2.2.2.2", None, 5), ("ip", "3.3.3.3", "c", 1)], "type string, value string, source string, n int")
    out = {r.value: r for r in merge_upsert(cur, upd, ["type", "value"], rules={"n": F.coalesce(F.col("c.n"), F.lit(0)) + F.col("u.n")}).collect()}
    assert out["1.1.1.1"].source == "a" and out["1.1.1.1"].n == 1
    assert out["2.2.2.2"].source == "b" and out["2.2.2.2"].n == 7
    assert out["3.3.3.3"].source == "c" and out["3.3.3.3"].n == 1
