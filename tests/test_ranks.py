"""Running totals over ranges, exact quantiles, ROC-AUC, ANOVA and routing."""

import numpy as np
from pyspark.sql import functions as F

from ioclens.operators import ranks as R
from ioclens.operators.routing import EXTRACTORS, long_features, route


def test_running_totals_over_many_ranges(spark):
    rng = np.random.default_rng(1)
    rows = sorted({(g, int(x)): int(rng.integers(0, 9)) for g, x in zip(rng.choice(["a", "a", "a", "b", None], 600), rng.integers(0, 10**6, 600))}.items(), key=str)
    rows = [(g, x, n) for (g, x), n in rows if g is not None]
    got = {(r.g, r.x): r.before_n for r in R.running(spark.createDataFrame(rows, "g string, x long, n long"), ["g"], "x", ["n"], rows=50).collect()}
    assert got == {(g, x): sum(m for h, y, m in rows if h == g and y < x) for g, x, _ in rows}


def test_quantiles_and_auc_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(800) < 1 / 3, 5.0, rng.normal(size=800).round(2))
    y = (x + rng.normal(size=800) > 0).astype(int)
    rows = [(float(a), float(-a) if k % 7 else None, int(b) if k % 11 else None) for k, (a, b) in enumerate(zip(x, y))] + [(float("nan"), None, 1)]
    df = spark.createDataFrame(rows, "p double, q double, y int")
    got = {r.name: r[1:] for r in R.quantiles(df, ["p", "q"], [0.0, 0.3, 1.0]).collect()}
    q = np.array([b for _, b, _ in rows if b is not None])
    assert np.allclose(got["p"], np.quantile(x, [0, 0.3, 1])) and np.allclose(got["q"], np.quantile(q, [0, 0.3, 1]))
    auc = {r.name: r.auc for r in R.roc_auc(df, ["p", "q"], "y").collect()}
    for name, k in (("p", 0), ("q", 1)):
        own = [(r[k], r[2]) for r in rows if r[2] is not None and r[k] is not None and r[k] == r[k]]
        pos, neg = (np.array([v for v, c in own if c == want]) for want in (1, 0))
        assert abs(auc[name] - np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))) < 1e-9
    assert R.roc_auc(df.where("y = 1"), ["p"], "y").first().auc is None


def test_anova_by_hand(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=300) + y
    rows = [(float(a), 4.0, int(c)) for a, c in zip(x, y)]
    got = {r.name: r for r in R.anova(spark.createDataFrame(rows, "x double, same double, y int"), ["x", "same"], "y").collect()}
    groups = [x[y == c] for c in range(3)]
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups) / 2
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (300 - 3)
    assert abs(got["x"].f_value - between / within) < 1e-6 and abs(got["x"].std - x.std()) < 1e-9
    assert got["same"].f_value is None and got["same"].std == 0


def test_each_type_meets_its_own_extractor(spark):
    rows = [("1", "ip", "10.0.0.1"), ("2", "ip", "2001:db8::1"), ("3", "domain", "a.example.org"), ("4", "url", "http://a.example.org/x?y=1"), ("5", "hash", "a" * 32),
            ("6", "network", "port scan error"), ("7", "email", "x@y"), ("8", None, "z"), ("9", "url", None)]
    routed = route(spark.createDataFrame(rows, "id string, type string, value string"))
    counts = {(r.id, r.type): r.n for r in long_features(routed).groupBy("id", "type").agg(F.count("*").alias("n")).collect()}
    assert counts == {(i, t): len(EXTRACTORS[t][1]) for i, t, _ in rows if i in "13456"}
