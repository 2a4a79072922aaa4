"""MLlib operators.

Everything here is a distributed aggregate or an MLlib estimator; nothing
collects data-sized frames.  Assignments that need a rank inside a label
(stratified split / folds) use hash buckets plus a small per-(label, bucket)
count table instead of a window over the whole label, because a binary
label makes each class a hot group.
"""

from __future__ import annotations

import time
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (HashingTF, IDF, StandardScaler, StringIndexer, Tokenizer, UnivariateFeatureSelector,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .models import reloaded, shallower
from ..constants import CLUSTER_CAMPAIGN_RISK, CLUSTER_CAMPAIGN_SIZE, CLUSTER_MAX_K, CLUSTER_MIN_ROWS, CLUSTER_MIN_SIZE, \
    CAMPAIGN_HIGH_RISK, CLUSTER_TYPE_CODES


# ------------------------------------------------------------------ metrics
def confusion_metrics(df: DataFrame, label: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """Confusion counts and accuracy, precision, recall, F1, FPR, FNR,
    specificity (0 where a denominator is 0), in one aggregate."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    agg = [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
           F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn")]
    g = df.groupBy(*group).agg(*agg) if group else df.agg(*agg)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def safe(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))
    prec, rec = safe(tp, tp + fp), safe(tp, tp + fn)
    return g.select(*(group or []), "tp", "fp", "tn", "fn",
                    safe(tp + tn, tp + fp + tn + fn).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
                    safe(2 * prec * rec, prec + rec).alias("f1"), safe(fp, tn + fp).alias("fpr"),
                    safe(fn, tp + fn).alias("fnr"), safe(tn, tn + fp).alias("specificity"))


def class_report(df: DataFrame, label: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """Per-class precision, recall, F1 and support (long form);
    weighted averages follow by weighting with support."""
    group = group or []
    cnt = df.groupBy(*group).agg(
        *[F.count_if((F.col(label) == c) & (F.col(pred) == c)).alias(f"tp_{c}") for c in (0, 1)],
        *[F.count_if(F.col(pred) == c).alias(f"pp_{c}") for c in (0, 1)],
        *[F.count_if(F.col(label) == c).alias(f"sup_{c}") for c in (0, 1)])
    rows = cnt.selectExpr(*group, "stack(2, 0, tp_0, pp_0, sup_0, 1, tp_1, pp_1, sup_1) AS (class, tp, predicted, support)")
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    out = rows.select(*group, "class", "support", prec.alias("precision"), rec.alias("recall"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                       2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def weighted_f1(scored: DataFrame, label: str, group: str | None = None) -> dict:
    """F1 of ``prediction`` by class, weighted with the class's rows, of each
    value of ``group`` (or of None), as MLlib's evaluator gives it: from the
    counts of (label, prediction), which one native aggregate makes."""
    cells: dict = {}
    key = F.col(group) if group else F.lit(None)
    for g, y, p, n in scored.groupBy(key, F.col(label), F.col("prediction")).count().collect():
        cells.setdefault(g, {})[y, p] = n
    out = {}
    for g, found in cells.items():
        total, f1 = sum(found.values()), 0.0
        for c in sorted({y for y, _ in found}):
            tp, support = found.get((c, c), 0), sum(n for (y, _), n in found.items() if y == c)
            predicted = sum(n for (_, p), n in found.items() if p == c)
            prec, rec = tp / predicted if predicted else 0.0, tp / support
            f1 += (2 * prec * rec / (prec + rec) if prec + rec else 0.0) * support / total
        out[g] = f1
    return out


def quality_warnings(metrics: DataFrame, auc: Column | None = None, train_test_gap: Column | None = None,
                     network: bool = False) -> Column:
    """Warning codes for implausible scores, as one array column."""
    m = lambda c: F.col(c)
    checks = [F.when(m("accuracy") > 0.98, "accuracy_above_0_98"),
              F.when((m("precision") == 1.0) & (m("recall") == 1.0), "perfect_precision_recall"),
              F.when((m("fp") == 0) & (m("fn") == 0), "no_errors"),
              F.when(m("fpr") == 0, "zero_false_positives"), F.when(m("fnr") == 0, "zero_false_negatives")]
    if auc is not None:
        checks.append(F.when(auc > 0.99, "roc_auc_above_0_99"))
    if train_test_gap is not None:
        checks.append(F.when(train_test_gap > 0.1, "train_test_gap_above_0_1"))
    if network:
        checks += [F.when(m("fpr") < 0.01, "fpr_below_0_01"), F.when(m("fnr") < 0.01, "fnr_below_0_01")]
    return F.array_compact(F.array(*checks))


def anomaly_share(scores: DataFrame, score: str, threshold: float = 0.0) -> DataFrame:
    """Rows beyond the threshold (below 0 for threshold 0, else above)."""
    cond = F.col(score) < 0 if threshold == 0 else F.col(score) > threshold
    g = scores.agg(F.count_if(cond).alias("anomaly_count"), F.count(F.lit(1)).alias("total_samples"))
    return g.withColumn("anomaly_percentage", F.col("anomaly_count") / F.col("total_samples") * 100)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n = df.select(F.count(F.lit(1))).scalar()
    k = per.select(F.count(F.lit(1))).scalar()
    return per.select(label, "n_c", (n / (k * F.col("n_c"))).alias("weight"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Class counts and percentage of the total."""
    n = df.select(F.count(F.lit(1))).scalar()
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count")).withColumn("percentage", F.col("count") / n * 100)


def missing_values(df: DataFrame) -> DataFrame:
    """NULL (and NaN) count per column, long form."""
    def miss(c, t):
        cond = F.col(c).isNull()
        if t in ("double", "float"):
            cond = cond | F.isnan(c)
        return F.count_if(cond).alias(c)
    one = df.agg(*[miss(c, t) for c, t in df.dtypes])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return one.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, missing)")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles (linear
    interpolation), max per numeric column, long form: one aggregate for all
    columns, and one ranking of their distinct values."""
    from .ranks import quantiles
    stats = (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in stats])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{n}_{i}").cast("double").alias(n) for n, _ in stats]) for i, c in enumerate(cols)])))
    q = quantiles(df, cols, [0.25, 0.5, 0.75]).select(F.col("name").alias("column_name"), F.col("q_0").alias("p25"), F.col("q_1").alias("p50"), F.col("q_2").alias("p75"))
    return rows.join(q, "column_name", "left").select("column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


# ----------------------------------------------------- stratified assignment
def stratified_rank(df: DataFrame, label: str, order: Column, ties: list[str], buckets: int = 1024) -> DataFrame:
    """Exact 0-based rank of each row inside its label by (``order``,
    ``ties``), plus the label size, without a window over a whole label:
    ``order`` (a non-negative integer key) is cut into ``buckets`` ranges;
    rows rank inside (label, range) partitions and range offsets come from a
    small per-(label, range) count table."""
    d = df.withColumn("_ord", F.coalesce(order.cast("long"), F.lit(-1)))  # rows without an order key rank first
    top = d.select(F.max("_ord")).scalar()
    d = d.withColumn("_bk", F.floor(F.col("_ord") * F.lit(float(buckets)) / (top + 1)).cast("int"))
    cnt = d.groupBy(label, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))) \
             .withColumn("_size", F.sum("_n").over(Window.partitionBy(label)))
    cnt = cnt.select(F.col(label).alias("_lab"), F.col("_bk").alias("_cbk"), "_off", "_size")
    # at most ``buckets`` + 1 rows a label: broadcast, so the rows move once, for the window
    d = d.join(F.broadcast(cnt), F.col(label).eqNullSafe(F.col("_lab")) & (F.col("_bk") == F.col("_cbk"))).drop("_lab", "_cbk")
    wl = Window.partitionBy(label, "_bk").orderBy("_ord", *ties)
    return d.withColumn("_rank", F.col("_off") + F.row_number().over(wl) - 1).drop("_bk", "_off")


def _split(test: float, val: float) -> Column:
    n_test = F.floor(F.col("_size") * test)
    n_val = F.floor((F.col("_size") - n_test) * val)
    return F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_val, "validation").otherwise("train")


def _fold(k: int) -> Column:
    return (F.col("_rank") % k).cast("int")


def stratified_split(df: DataFrame, label: str, order: Column, ties: list[str], test: float = 0.2,
                     val: float = 0.2) -> DataFrame:
    """Per label, the first ``test`` share (by order key) is test, the
    next ``val`` share of the remainder is validation, the rest train
    (64/16/20 by default)."""
    r = stratified_rank(df, label, order, ties)
    return r.withColumn("split", _split(test, val)).drop("_rank", "_size", "_ord")


def stratified_folds(df: DataFrame, label: str, order: Column, ties: list[str], k: int = 10) -> DataFrame:
    """fold = rank inside the label mod k (balanced per class)."""
    r = stratified_rank(df, label, order, ties)
    return r.withColumn("fold", _fold(k)).drop("_rank", "_size", "_ord")


def stratified_split_folds(df: DataFrame, label: str, order: Column, ties: list[str], test: float = 0.2,
                           val: float = 0.2, k: int = 3) -> DataFrame:
    """W9 and W10 from one ranking, as both follow the same order."""
    r = stratified_rank(df, label, order, ties)
    return r.withColumn("split", _split(test, val)).withColumn("fold", _fold(k)).drop("_rank", "_size", "_ord")


# ------------------------------------------------------------ classifiers
def classifier_pipeline(features: list[str], kind: str, k: int, label: str = "label", weight: str | None = None,
                        **params) -> Pipeline:
    """M1 (ANOVA F top-k) -> M2 (standardise) -> one of M3-M6."""
    asm = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep")
    sel = UnivariateFeatureSelector(featuresCol="raw", outputCol="selected", labelCol=label,
                                    selectionMode="numTopFeatures").setFeatureType("continuous") \
        .setLabelType("categorical").setSelectionThreshold(min(k, len(features)))
    sc = StandardScaler(inputCol="selected", outputCol="features", withMean=True, withStd=True)
    kw = {"featuresCol": "features", "labelCol": label}
    if weight and kind in ("lr", "rf", "svc", "gbt"):
        kw["weightCol"] = weight
    defaults = {"lr": {"maxIter": 30}, "svc": {"maxIter": 30}, "rf": {"numTrees": 30, "seed": 42},
                "gbt": {"maxIter": 10, "seed": 42}}[kind]
    est = {"lr": LogisticRegression, "rf": RandomForestClassifier, "gbt": GBTClassifier, "svc": LinearSVC}[kind](
        **kw, **{**defaults, **params})
    return Pipeline(stages=[asm, sel, sc, est])


def grids(pipe: Pipeline, kind: str):
    est = pipe.getStages()[-1]
    g = ParamGridBuilder()
    if kind == "lr":
        g = g.addGrid(est.regParam, [0.01, 0.1])
    elif kind == "rf":
        g = g.addGrid(est.maxDepth, [5, 8])
    elif kind == "gbt":
        g = g.addGrid(est.maxDepth, [3, 5])
    elif kind == "svc":
        g = g.addGrid(est.regParam, [0.01, 0.1])
    return g.build()


#: Bytes kept of a row while 30 trees grow: bins, draws and, twice, the node
#: each tree has it in; or of two boosted fits at once.
BYTES_A_ROW = 560


def roomy(data: DataFrame) -> bool:
    """Whether memory holds what ``BYTES_A_ROW`` counts.  Else grid points are
    fitted one at a time and trees walk each row down anew: rows that go to
    disk and back between passes cost more than either saves."""
    each = data.sparkSession.sparkContext._jsc.sc().getExecutorMemoryStatus().valuesIterator()
    room = 0
    while each.hasNext():
        room += each.next()._1()
    return data.count() * BYTES_A_ROW <= 0.8 * room


def forests(est: RandomForestClassifier, points: list[dict], data: DataFrame, node_ids: bool = True) -> list:
    """A forest for each point of a grid of depths.  Trees grow level by level
    and draw their rows and features in that order, so a forest of a smaller
    depth is the deepest one cut there; only that is fitted.  This holds while
    the nodes of a level fit in the memory of one pass; where they do not,
    each point is fitted."""
    depths = [p[est.maxDepth] for p in points]
    deep = max(depths)
    model = est.fit(data, {**points[depths.index(deep)], est.cacheNodeIds: node_ids})
    less = [d for d in depths if d < deep]
    a_node = model.numFeatures * est.getMaxBins() * (model.numClasses + 1) * 8
    if less and est.getNumTrees() * 2 ** (max(less) - 1) * a_node > est.getMaxMemoryInMB() << 20:
        return [model if d == deep else est.fit(data, {**p, est.cacheNodeIds: node_ids}) for d, p in zip(depths, points)]
    spark = data.sparkSession
    cut = dict(zip(less, shallower(spark, model, less, scratch_path(spark, "forest")))) if less else {}
    return [cut.get(d, model) for d in depths]


def train_select(data: DataFrame, features: list[str], label: str, k: int, kinds=("lr", "rf", "gbt", "svc"),
                 folds: int = 3, parallelism: int = 4, weight: str | None = None):
    """M7-M9: cross-validated grid per model kind on the train split (fold
    column), choose by validation F1, evaluate on test.  Returns
    (results DataFrame, best PipelineModel, best kind).

    ``data`` is read many times: pass a written table.  Selection and scaling
    depend on a fold's rows only, so they are fitted once a fold, and once
    on the whole split, for all kinds and grid points; one such prepared set
    is held at a time."""
    spark = data.sparkSession
    train = data.where(F.col("split") == "train")
    held = data.where(F.col("split").isin("validation", "test"))
    pipes = {kind: classifier_pipeline(features, kind, k, label=label, weight=weight) for kind in kinds}
    points = {kind: grids(pipe, kind) for kind, pipe in pipes.items()}
    front = Pipeline(stages=pipes[kinds[0]].getStages()[:-1])
    kept = [c for c in (label, "features", "fold", weight) if c]
    sums = {kind: [0.0] * len(points[kind]) for kind in kinds}
    secs = dict.fromkeys(kinds, 0.0)

    def scores(kind, fit_on, score_on, room) -> list[float]:
        est = pipes[kind].getStages()[-1]
        f1 = lambda model: weighted_f1(model.transform(score_on), label).get(None, 0.0)
        if kind == "rf":
            return [f1(model) for model in forests(est, points[kind], fit_on, node_ids=room)]
        fit = lambda point: f1(est.fit(fit_on, point))
        return pool.map(inheritable_thread_target(spark)(fit), points[kind]) if room else [fit(point) for point in points[kind]]

    with ThreadPool(parallelism) as pool:
        for fold in range(folds):
            prepared = front.fit(train.where(F.col("fold") != fold)).transform(train).select(*kept).persist()
            sets = prepared.where(F.col("fold") != fold), prepared.where(F.col("fold") == fold)
            room = roomy(sets[0])
            for kind in kinds:
                t0 = time.perf_counter()
                sums[kind] = [a + b for a, b in zip(sums[kind], scores(kind, *sets, room))]
                secs[kind] += time.perf_counter() - t0
            prepared.unpersist()
    rows, best = [], None
    whole = front.fit(train)
    prepared = whole.transform(train).select(*kept).persist()
    for kind in kinds:
        t0 = time.perf_counter()
        point, est = points[kind][sums[kind].index(max(sums[kind]))], pipes[kind].getStages()[-1]
        if kind == "rf":
            point = {**point, est.cacheNodeIds: roomy(prepared)}
        model = PipelineModel([*whole.stages, est.fit(prepared, point)])
        # scored as saved: a fresh model holds its training summary, and with it the session
        model = reloaded(model, scratch_path(spark, f"model-{kind}"))
        secs[kind] += time.perf_counter() - t0
        of = weighted_f1(model.transform(held), label, "split")
        vf1, tf1 = of.get("validation", 0.0), of.get("test", 0.0)
        trf1 = weighted_f1(model.stages[-1].transform(prepared), label).get(None, 0.0)
        rows.append((kind, float(vf1), float(tf1), float(trf1), float(secs[kind])))
        if best is None or vf1 > best[1]:
            best = (kind, vf1, model)
    prepared.unpersist()
    res = spark.createDataFrame(rows, "model string, validation_f1 double, test_f1 double, train_f1 double, train_seconds double")
    return res, best[2], best[0]


def predict_with(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Label and max class probability (raw margin for linear SVM)."""
    out = model.transform(df)
    if "probability" in out.columns:
        prob = F.array_max(vector_to_array("probability"))
    else:
        prob = F.lit(None).cast("double")
    return out.withColumn("probability_max", prob)


def feature_importance(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """Importances (trees) or |coefficients| (linear) for the
    selected features; a tiny (feature, importance) table."""
    sel = model.stages[1]
    chosen = [features[i] for i in sel.selectedFeatures]
    est = model.stages[-1]
    if hasattr(est, "featureImportances"):
        imp = est.featureImportances.toArray().tolist()
    else:
        imp = [abs(x) for x in est.coefficients.toArray().tolist()]
    return spark.createDataFrame(list(zip(chosen, [float(x) for x in imp])), "feature string, importance double")


# ------------------------------------------------------------- clustering
def cluster_features(iocs: DataFrame, enrich_counts: DataFrame | None, as_of) -> DataFrame:
    """XG1: type code, value length, risk, enrichment count, age in days."""
    codes = F.create_map(*[x for kv in CLUSTER_TYPE_CODES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    df = iocs
    if enrich_counts is not None:
        df = df.join(enrich_counts, "id", "left")
    else:
        df = df.withColumn("enrichment_count", F.lit(0))
    age = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 8.64e10)
    return df.select("id", "type", "value", "risk_score",
                     F.coalesce(codes[F.col("type")], F.lit(0)).cast("double").alias("type_code"),
                     F.length("value").cast("double").alias("value_length"),
                     F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0)).alias("risk"),
                     F.coalesce("enrichment_count", F.lit(0)).cast("double").alias("enrichment_count"),
                     F.coalesce(age, F.lit(0)).cast("double").alias("age_days"))


def kmeans_clusters(feats: DataFrame, seed: int = 42) -> DataFrame:
    """k = min(5, n // 2) on standardised XG1 features (needs n >= 10);
    returns rows with a ``cluster`` column."""
    n = feats.count()   # k depends on n: one count action
    if n < CLUSTER_MIN_ROWS:
        return feats.withColumn("cluster", F.lit(None).cast("int")).where(F.lit(False))
    k = min(CLUSTER_MAX_K, n // 2)
    cols = ["type_code", "value_length", "risk", "enrichment_count", "age_days"]
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="raw"),
                            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
                            KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")])
    return pipe.fit(feats).transform(feats).drop("raw", "features")


def cluster_profiles(clustered: DataFrame) -> DataFrame:
    """Size >= 2, dominant type (ties by name), average risk, 5 sample
    values (smallest ids), campaign flag."""
    g = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("risk").alias("avg_risk_score"))
    tc = clustered.groupBy("cluster", "type").agg(F.count(F.lit(1)).alias("_n"))
    dom = tc.groupBy("cluster").agg(F.max_by("type", F.struct(F.col("_n"), F.lit(0) - F.length("type"))).alias("dominant_type"))
    samples = clustered.select("cluster", "id", "value")
    from .topn import top_n
    s = top_n(samples, ["cluster"], [F.col("id")], 5, ["id"]).groupBy("cluster") \
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda x: x["value"]), ",").alias("ioc_samples"))
    out = g.join(dom, "cluster").join(s, "cluster").where(F.col("size") >= CLUSTER_MIN_SIZE)
    return out.withColumn("is_campaign", (F.col("size") > CLUSTER_CAMPAIGN_SIZE) & (F.col("avg_risk_score") > CLUSTER_CAMPAIGN_RISK))


def campaigns(profiles: DataFrame) -> DataFrame:
    """Campaigns from cluster profiles."""
    return profiles.where("is_campaign").select(
        F.concat(F.lit("campaign_"), F.col("cluster").cast("string")).alias("campaign_id"), "size",
        F.col("dominant_type").alias("threat_type"),
        F.when(F.col("avg_risk_score") > CAMPAIGN_HIGH_RISK, "high").otherwise("medium").alias("risk_level"),
        F.col("ioc_samples").alias("indicators"), F.lit("active").alias("status"))


# ------------------------------------------------------------------ text
def text_pipeline(label: str = "label", num_features: int = 1 << 16) -> Pipeline:
    """Tokenizer -> HashingTF -> IDF -> LogisticRegression."""
    return Pipeline(stages=[Tokenizer(inputCol="text", outputCol="tokens"),
                            HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
                            IDF(inputCol="tf", outputCol="features"),
                            LogisticRegression(featuresCol="features", labelCol=label, maxIter=30, regParam=0.01)])


def fit_text(labelled: DataFrame) -> PipelineModel:
    """``text_pipeline`` fitted on (label, text): the terms of a text are
    counted once and held for the inverse frequencies and the classifier."""
    tok, tf, idf, lr = text_pipeline().getStages()
    terms = tf.transform(tok.transform(labelled)).select("label", "tf").persist()
    weights = idf.fit(terms)
    model = PipelineModel([tok, tf, weights, lr.fit(weights.transform(terms))])
    terms.unpersist()
    return model


def text_scores(model: PipelineModel, df: DataFrame, labels: list[str]) -> DataFrame:
    """Best label, its score and all scores per row."""
    out = model.transform(df)
    probs = vector_to_array("probability")
    return out.select(*df.columns, F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1).alias("label_text"),
                      F.array_max(probs).alias("score"), probs.alias("all_scores"))


def index_labels(df: DataFrame, col: str, out: str) -> DataFrame:
    """Alphabetical label codes (StringIndexer alphabetAsc)."""
    return StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc").fit(df).transform(df)
