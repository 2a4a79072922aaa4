"""Work and memory of a query that must not outgrow its input."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from ioclens.operators import graph as G
from ioclens.operators import ml as M
from ioclens.operators import models
from ioclens.plans import ml
from ioclens.session import settings, small_tasks
from ioclens.sources import sinks, views
from ioclens.sources.versioned import Tables
from tests.conftest import SMALL

Q = entry.queries()


def fresh(monkeypatch):
    """Nothing written or fitted by other tests."""
    monkeypatch.setattr(models, "_PATHS", {})
    monkeypatch.setattr(models, "_TABLES", {})
    monkeypatch.setattr(models, "_ROWS", {})


def counted(monkeypatch, owner, name):
    calls, real = [], getattr(owner, name)

    def call(*args, **kwargs):
        calls.append(args)
        return real(*args, **kwargs)
    monkeypatch.setattr(owner, name, call)
    return calls


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_training_set_is_ranked_once_and_kept(spark, monkeypatch):
    fresh(monkeypatch)
    ranks = counted(monkeypatch, M, "stratified_rank")
    flows = ml._flow_training_set(spark, SMALL)
    assert len(ranks) == 1 and "Window" not in plan(flows) and "Join" not in plan(flows)
    old = M.stratified_folds(M.stratified_split(views.flow(spark, SMALL), "is_anomalous", ml._flow_order(), ["l_orderkey", "l_linenumber"]),
                             "is_anomalous", ml._flow_order(), ["l_orderkey", "l_linenumber"], k=3)
    cols = ["l_orderkey", "l_linenumber", "split", "fold"]
    assert sorted(map(tuple, flows.select(cols).collect())) == sorted(map(tuple, old.select(cols).collect()))


def test_split_and_folds_of_repeated_and_missing_keys(spark):
    rows = [(k % 2, None if k % 7 == 0 else k % 50, k // 3) for k in range(400)] + [(None, k, k) for k in range(9)]
    df = spark.createDataFrame(rows, "label int, ord long, tie int")
    one = M.stratified_split_folds(df, "label", F.col("ord"), ["tie"])
    two = M.stratified_folds(M.stratified_split(df, "label", F.col("ord"), ["tie"]), "label", F.col("ord"), ["tie"], k=3)
    assert sorted(map(str, one.select("*").collect())) == sorted(map(str, two.select(*one.columns).collect()))


def test_selection_and_scaling_are_fitted_once_a_fold(spark, monkeypatch):
    from pyspark.ml.feature import UnivariateFeatureSelector
    fits = counted(monkeypatch, UnivariateFeatureSelector, "_fit")
    rows = [(float(k % 2), k % 2 + (k * 37 % 11) / 10, float(k * 17 % 13), "train" if k % 5 else "test" if k % 2 else "validation", k // 2 % 3) for k in range(120)]
    data = spark.createDataFrame(rows, "label double, a double, b double, split string, fold int")
    res, model, kind = M.train_select(data, ["a", "b"], "label", k=2, kinds=("lr", "rf"))
    assert len(fits) == 4 and [r.model for r in res.collect()] == ["lr", "rf"] and kind in ("lr", "rf")
    assert model.transform(data).where("prediction = label").count() > 60


def test_selection_agrees_with_cross_validated_pipelines(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator
    rows = [(float(k * 7 % 10 < 4), (k * 37 % 11) / 3 + (k * 7 % 10 < 4), float(k * 17 % 13), "train" if k % 5 else "validation", k // 2 % 3) for k in range(240)]
    data = spark.createDataFrame(rows, "label double, a double, b double, split string, fold int").coalesce(1)
    train, f1 = data.where("split = 'train'"), MulticlassClassificationEvaluator(labelCol="label", metricName="f1")
    for kind in ("lr", "rf"):
        pipe = M.classifier_pipeline(["a", "b"], kind, 2)
        want = CrossValidator(estimator=pipe, estimatorParamMaps=M.grids(pipe, kind), evaluator=f1, foldCol="fold", numFolds=3).fit(train).bestModel
        res, model, _ = M.train_select(data, ["a", "b"], "label", k=2, kinds=(kind,))
        assert abs(res.first().train_f1 - f1.evaluate(want.transform(train))) < 1e-9
        got, old = (sorted((r.a, r.b, tuple(round(x, 9) for x in r.probability)) for r in m.transform(data).collect()) for m in (model, want))
        assert got == old


def test_forests_of_smaller_depths_are_cut_from_the_deepest(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    rows = [(float(k * 7 % 10 < 4), (k * 37 % 11) / 3 + (k * 7 % 10 < 4), float(k * 17 % 13), float(k * k % 29), float(k % 3)) for k in range(400)]
    for label in ("label", "d"):   # two classes, and three
        data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
            spark.createDataFrame(rows, "label double, a double, b double, c double, d double").repartition(3, "c")).persist()
        est = RandomForestClassifier(labelCol=label, numTrees=5, seed=42)
        points = [{est.maxDepth: d} for d in (2, 5, 3)]
        want = [est.fit(data, p) for p in points]
        with monkeypatch.context() as m:
            fits = counted(m, RandomForestClassifier, "_fit")
            got = M.forests(est, points, data)
        assert len(fits) == 1
        for g, w in zip(got, want):
            assert g.toDebugString.split("\n")[1:] == w.toDebugString.split("\n")[1:]
            assert [r.probability for r in g.transform(data).collect()] == [r.probability for r in w.transform(data).collect()]
        data.unpersist()


def test_forests_whose_levels_take_several_passes_are_fitted_each(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    rows = [(float(k * 7 % 10 < 4), (k * 37 % 11) / 3, float(k * 17 % 13), float(k * k % 29)) for k in range(60)]
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(rows, "label double, a double, b double, c double").coalesce(1))
    est = RandomForestClassifier(numTrees=2, seed=42, maxMemoryInMB=0)
    points = [{est.maxDepth: d} for d in (1, 2)]
    want = [est.fit(data, p).toDebugString.split("\n")[1:] for p in points]
    fits = counted(monkeypatch, RandomForestClassifier, "_fit")
    assert [f.toDebugString.split("\n")[1:] for f in M.forests(est, points, data)] == want and len(fits) == 2


def test_selection_is_the_same_where_memory_is_short(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier
    rows = [(float(k % 2), k % 2 + (k * 37 % 11) / 10, float(k * 17 % 13), "train" if k % 5 else "test" if k % 2 else "validation", k // 2 % 3) for k in range(120)]
    data = spark.createDataFrame(rows, "label double, a double, b double, split string, fold int").coalesce(1)
    found = []
    for bytes_a_row, ids in ((560, True), (1 << 50, False)):
        with monkeypatch.context() as m:
            m.setattr(M, "BYTES_A_ROW", bytes_a_row)
            fits = counted(m, RandomForestClassifier, "_fit")
            res, model, _ = M.train_select(data, ["a", "b"], "label", k=2, kinds=("rf",))
        assert len(fits) == 4 and {f[0].getCacheNodeIds() for f in fits} == {ids}
        found.append(([r[1:4] for r in res.collect()], sorted(str(r.probability) for r in model.transform(data).collect())))
    assert found[0] == found[1]


def test_f1_is_that_of_the_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    f1 = MulticlassClassificationEvaluator(metricName="f1")
    rows = [(float(k % 3), float(k * 7 % 4 % 3), "ab"[k % 5 == 0]) for k in range(50)] + [(1.0, 0.0, "c"), (0.0, 0.0, "d"), (2.0, 9.0, "d")]
    df = spark.createDataFrame(rows, "label double, prediction double, split string")
    got = M.weighted_f1(df, "label", "split")
    assert sorted(got) == ["a", "b", "c", "d"]
    assert all(abs(got[s] - f1.evaluate(df.where(F.col("split") == s))) < 1e-12 for s in got)
    assert abs(M.weighted_f1(df, "label")[None] - f1.evaluate(df)) < 1e-12 and M.weighted_f1(df.limit(0), "label") == {}


def test_texts_are_searched_once_for_digests(spark, monkeypatch):
    fresh(monkeypatch)
    reads = counted(monkeypatch, views, "raw_inputs")
    ml._labelled_indicators(spark, SMALL, "hash")
    digests = ml._found(spark, SMALL, "hash")
    assert len(reads) == 1 and "regexp" not in plan(digests).lower()
    assert Q["hash_risk_scoring"](spark, SMALL).count() == digests.select("value").distinct().count() and len(reads) == 1


def test_terms_of_a_text_are_counted_once_a_fit(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF
    held = []
    for owner in (IDF, LogisticRegression):
        def fit(self, data, *rest, real=owner._fit):
            held.append("InMemoryRelation" in data._jdf.queryExecution().withCachedData().toString())
            return real(self, data, *rest)
        monkeypatch.setattr(owner, "_fit", fit)
    rows = [(float(k % 2), f"word{k % 7} {'good' if k % 2 else 'bad'} text {k % 3}") for k in range(60)]
    data = spark.createDataFrame(rows, "label double, text string").coalesce(1)
    model = M.fit_text(data)
    assert held == [True, True]
    want = M.text_pipeline().fit(data)
    got, old = (sorted(map(str, M.text_scores(m, data, ["benign", "toxic"]).collect())) for m in (model, want))
    assert got == old


def test_drops_do_not_grow_with_the_tasks_that_read(spark, monkeypatch):
    real, found = views.raw_inputs, sinks.write_csv
    commits, files = counted(monkeypatch, Tables, "commit"), []
    monkeypatch.setattr(views, "raw_inputs", lambda *a: real(*a).repartition(40))

    def write(df, path, *rest):
        found(df, path, *rest)
        files.extend(spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path").collect())
    monkeypatch.setattr(sinks, "write_csv", write)
    Q["stream_bulk_ingest"](spark, SMALL)
    assert 1 <= len(files) <= 8 and len(commits) <= 5


def test_rounds_of_components_take_tasks_by_rows(spark, monkeypatch):
    seen, real = [], G._labels

    def labels(adj, kept):
        seen.append({k: spark.conf.get(f"spark.sql.adaptive.{k}") for k in ("advisoryPartitionSizeInBytes", "skewJoin.skewedPartitionThresholdInBytes", "coalescePartitions.initialPartitionNum")})
        return real(adj, kept)
    monkeypatch.setattr(G, "_labels", labels)
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    edges = spark.range(1, 400).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    assert {r.component for r in G.connected_components(edges).collect()} == {0}
    assert seen == [{"advisoryPartitionSizeInBytes": "2m", "skewJoin.skewedPartitionThresholdInBytes": "4m", "coalescePartitions.initialPartitionNum": "8"}]
    assert spark.conf.get(name) == before
    with small_tasks(spark, 10_000_000):
        assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "40"


def test_settings_are_put_back_after_an_error(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        with settings(spark, spark__sql__shuffle__partitions=3):
            assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
            raise ValueError
    except ValueError:
        pass
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
