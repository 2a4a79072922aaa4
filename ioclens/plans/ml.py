"""Model quality, profiling, split, training, scoring, clustering and text
classification queries."""

from __future__ import annotations

from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ..functions.network import NETWORK_FEATURES, network_features
from ..functions.risk import score_from_prediction
from ..operators import ml as M
from ..sources import views
from ..sources.tables import table
from .common import r6
from .registry import query

FLOW_ORDER_SQL = "((l_orderkey * 31 + l_linenumber * 7) % 1000003)"
FLOW_COLS = ["packet_count", "bytes_transferred", "duration_seconds", "connection_count", "failed_connections"]


def _flow_order():
    return F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7, F.lit(1000003))


def _scored_predictions(spark, sf_dir):
    p = views.prediction(spark, sf_dir)
    lb = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ioc_id"), "toxic")
    return p.join(lb, "ioc_id").select("id", "model_name", F.col("toxic").alias("y"),
                                       (F.col("prediction") == "malicious").cast("int").alias("p"))


def _round_all(df, skip=()):
    types = dict(df.dtypes)
    return df.select(*[r6(c).alias(c) if types[c] == "double" and c not in skip else F.col(c) for c in df.columns])


@query("model_confusion_metrics", """WITH s AS (SELECT p.model_name, l.toxic AS y, CASE WHEN p.prediction = 'malicious' THEN 1 ELSE 0 END AS p
  FROM prediction p JOIN labels l ON p.ioc_id = l.doc_id),
c AS (SELECT model_name, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp,
  count(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn, count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn FROM s GROUP BY 1),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM c)
SELECT model_name, tp, fp, tn, fn, round(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0.0 END, 6) AS accuracy,
  round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1,
  round(CASE WHEN tn + fp > 0 THEN fp / (tn + fp) ELSE 0.0 END, 6) AS fpr, round(CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0.0 END, 6) AS fnr,
  round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END, 6) AS specificity FROM m""")
def model_confusion_metrics(spark, sf_dir):
    """Confusion matrix and rates of each model's verdicts against the
    labelled truth (toxic = malicious)."""
    return _round_all(M.confusion_metrics(_scored_predictions(spark, sf_dir), "y", "p", ["model_name"]))


@query("model_class_report", """WITH s AS (SELECT p.model_name, l.toxic AS y, CASE WHEN p.prediction = 'malicious' THEN 1 ELSE 0 END AS p
  FROM prediction p JOIN labels l ON p.ioc_id = l.doc_id),
c AS (SELECT model_name, cls AS class, count(*) FILTER (WHERE y = cls AND p = cls) AS tp, count(*) FILTER (WHERE p = cls) AS predicted,
  count(*) FILTER (WHERE y = cls) AS support FROM s, (SELECT 0 AS cls UNION ALL SELECT 1) k GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM c)
SELECT model_name, class, support, round(pr, 6) AS precision, round(rc, 6) AS recall,
  round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1 FROM m""")
def model_class_report(spark, sf_dir):
    """Per-class precision, recall, F1 and support per model."""
    return _round_all(M.class_report(_scored_predictions(spark, sf_dir), "y", "p", ["model_name"]))


@query("flow_class_distribution", """SELECT is_anomalous, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM flow), 6) AS percentage
FROM flow GROUP BY 1""")
def flow_class_distribution(spark, sf_dir):
    """Class counts and shares of the flow table."""
    return _round_all(M.class_distribution(views.flow(spark, sf_dir), "is_anomalous"))


@query("flow_missing_values", """SELECT column_name, missing FROM (SELECT
  count(*) FILTER (WHERE l_orderkey IS NULL) AS l_orderkey, count(*) FILTER (WHERE l_linenumber IS NULL) AS l_linenumber,
  count(*) FILTER (WHERE packet_count IS NULL) AS packet_count, count(*) FILTER (WHERE bytes_transferred IS NULL) AS bytes_transferred,
  count(*) FILTER (WHERE duration_seconds IS NULL OR isnan(duration_seconds)) AS duration_seconds,
  count(*) FILTER (WHERE connection_count IS NULL) AS connection_count, count(*) FILTER (WHERE failed_connections IS NULL) AS failed_connections,
  count(*) FILTER (WHERE is_anomalous IS NULL) AS is_anomalous FROM flow)
UNPIVOT (missing FOR column_name IN (l_orderkey, l_linenumber, packet_count, bytes_transferred, duration_seconds, connection_count, failed_connections, is_anomalous))""")
def flow_missing_values(spark, sf_dir):
    """Missing values per column."""
    return M.missing_values(views.flow(spark, sf_dir))


def _describe_sql():
    parts = []
    for c in FLOW_COLS:
        x = f"cast({c} AS double)"
        parts.append(f"""SELECT '{c}' AS column_name, cast(count({x}) AS double) AS count, round(avg({x}), 6) AS mean,
  round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS p25,
  round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max FROM flow""")
    return "\nUNION ALL\n".join(parts)


@query("flow_describe", _describe_sql())
def flow_describe(spark, sf_dir):
    """Summary statistics with exact quartiles."""
    return _round_all(M.describe(views.flow(spark, sf_dir), FLOW_COLS), skip=("count",))


@query("flow_class_weights", """SELECT is_anomalous, count(*) AS n_c,
  round((SELECT count(*) FROM flow) / ((SELECT count(DISTINCT is_anomalous) FROM flow) * count(*)), 6) AS weight
FROM flow GROUP BY 1""")
def flow_class_weights(spark, sf_dir):
    """Balanced class weights."""
    return _round_all(M.class_weights(views.flow(spark, sf_dir), "is_anomalous"))


SPLIT_SQL = f"""WITH r AS (SELECT l_orderkey, l_linenumber, is_anomalous,
  row_number() OVER (PARTITION BY is_anomalous ORDER BY {FLOW_ORDER_SQL}, l_orderkey, l_linenumber) - 1 AS rk,
  count(*) OVER (PARTITION BY is_anomalous) AS sz FROM flow)"""


@query("flow_split", SPLIT_SQL + """
SELECT l_orderkey, l_linenumber, is_anomalous,
  CASE WHEN rk < floor(sz * 0.2) THEN 'test' WHEN rk < floor(sz * 0.2) + floor((sz - floor(sz * 0.2)) * 0.2) THEN 'validation'
       ELSE 'train' END AS split FROM r""")
def flow_split(spark, sf_dir):
    """Exact stratified 64/16/20 split, deterministic by key."""
    f = views.flow(spark, sf_dir).select("l_orderkey", "l_linenumber", "is_anomalous")
    return M.stratified_split(f, "is_anomalous", _flow_order(), ["l_orderkey", "l_linenumber"])


@query("flow_folds", SPLIT_SQL + """
SELECT l_orderkey, l_linenumber, is_anomalous, cast(rk % 10 AS integer) AS fold FROM r""")
def flow_folds(spark, sf_dir):
    """Stratified 10-fold assignment."""
    f = views.flow(spark, sf_dir).select("l_orderkey", "l_linenumber", "is_anomalous")
    return M.stratified_folds(f, "is_anomalous", _flow_order(), ["l_orderkey", "l_linenumber"], k=10)


@query("flow_anomaly_share", """SELECT count(*) FILTER (WHERE (cast(packet_count AS double) / (duration_seconds + 0.001))
  * (cast(bytes_transferred AS double) / (duration_seconds + 0.001)) * (cast(connection_count AS double) / (duration_seconds + 0.001)) / 1000000 > 1000.0) AS anomaly_count,
  count(*) AS total_samples,
  round(count(*) FILTER (WHERE (cast(packet_count AS double) / (duration_seconds + 0.001))
  * (cast(bytes_transferred AS double) / (duration_seconds + 0.001)) * (cast(connection_count AS double) / (duration_seconds + 0.001)) / 1000000 > 1000.0) / count(*) * 100, 6) AS anomaly_percentage
FROM flow""")
def flow_anomaly_share(spark, sf_dir):
    """Share of flows whose traffic intensity score exceeds 1000."""
    f = network_features(views.flow(spark, sf_dir))
    return _round_all(M.anomaly_share(f, "traffic_intensity_score", 1000.0))


def _auc_sql():
    names = FLOW_COLS + NETWORK_FEATURES
    return f"""WITH feats AS ({_net_long()}),
s AS (SELECT name, x, sum(y) AS pos, sum(1 - y) AS neg FROM feats WHERE x IS NOT NULL GROUP BY name, x),
b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY name ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT name, cast(sum(pos) AS bigint) AS positives, cast(sum(neg) AS bigint) AS negatives,
  round(sum(pos * (before + neg / 2.0)) / sum(pos) / sum(neg), 6) AS auc FROM b GROUP BY name"""


def _net_long():
    from .features import _net_sql
    import re
    whole = re.sub(r"round\(cast\((.*?) AS double\), 6\) AS (\w+)(?=,|\nFROM)", r"cast(\1 AS double) AS \2", _net_sql("flow", "is_anomalous"))
    names = ", ".join(FLOW_COLS + NETWORK_FEATURES)
    return f"SELECT name, x, is_anomalous AS y FROM (UNPIVOT (SELECT is_anomalous, COLUMNS(* EXCLUDE (is_anomalous))::double FROM ({whole}) q) ON {names} INTO NAME name VALUE x) u"


@query("flow_feature_auc", _auc_sql())
def flow_feature_auc(spark, sf_dir):
    """Exact ROC-AUC of every flow feature as a score of anomaly, ties
    counting half."""
    from ..operators.ranks import roc_auc
    f = network_features(views.flow(spark, sf_dir))
    return _round_all(roc_auc(f, FLOW_COLS + NETWORK_FEATURES, "is_anomalous"))


@query("flow_feature_scores", f"""WITH feats AS ({_net_long()}),
c AS (SELECT name, y, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM feats GROUP BY name, y),
w AS (SELECT name, sum(n) AS total, sum(n * m) / sum(n) AS mean, count(*) AS k FROM c GROUP BY name),
g AS (SELECT w.name, total, mean, k, sum(n * (m - mean) * (m - mean)) AS between_, sum(n * v) AS within_ FROM c JOIN w ON w.name = c.name GROUP BY ALL)
SELECT name, round((between_ / (k - 1)) / (within_ / (total - k)), 4) AS f_value, round(mean, 4) AS mean, round(sqrt((between_ + within_) / total), 4) AS std FROM g""")
def flow_feature_scores(spark, sf_dir):
    """M1/M2: ANOVA F, mean and deviation of every flow feature from one
    mergeable aggregate."""
    from ..operators.ranks import anova
    f = network_features(views.flow(spark, sf_dir))
    s = anova(f, FLOW_COLS + NETWORK_FEATURES, "is_anomalous")
    return s.select("name", *[F.round(c, 4).alias(c) for c in ("f_value", "mean", "std")])


def _flow_training_set(spark, sf_dir):
    """Labelled flows with features, split and fold, ranked and checkpointed
    once per dataset: every pass of an estimator reads those rows."""
    from ..operators.models import checkpointed

    def build():
        f = network_features(views.flow(spark, sf_dir)).withColumnRenamed("is_anomalous", "label")
        f = f.withColumn("label", F.col("label").cast("double"))
        return M.stratified_split_folds(f, "label", _flow_order(), ["l_orderkey", "l_linenumber"], k=3)
    return checkpointed(spark, (sf_dir, "flow_training"), build)


def _metrics_dir(spark, sf_dir):
    from ..operators.models import key_name
    from ..session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/metrics/{key_name((spark.sparkContext.applicationId, sf_dir))}"


def _training_results(spark, sf_dir):
    """One model selection per dataset: results table materialised in the
    shared folder, per-model metrics JSON (A22) and a report (A23) next to it."""
    import time as _t
    from ..operators.datasets import save_metrics, save_report
    from ..operators.models import materialized

    def build():
        t0 = _t.perf_counter()
        data = _flow_training_set(spark, sf_dir)
        feats = ["packet_count", "bytes_transferred", "duration_seconds", "connection_count", "failed_connections"] + NETWORK_FEATURES
        res, model, kind = M.train_select(data, feats, "label", k=10, kinds=("lr", "rf", "gbt"))
        pred = model.transform(data.where(F.col("split") == "test")).select("label", "prediction", "rawPrediction").persist()
        cm = M.confusion_metrics(pred.withColumn("p", F.col("prediction").cast("int")).withColumn("y", F.col("label").cast("int")), "y", "p")
        from pyspark.ml.evaluation import BinaryClassificationEvaluator
        auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName="areaUnderROC").evaluate(pred)
        cm = cm.withColumn("roc_auc", F.lit(float(auc)))
        cm = cm.withColumn("warnings", F.array_join(M.quality_warnings(cm, auc=F.col("roc_auc"), network=True), ","))
        best = cm.select(F.lit(kind).alias("model"), "accuracy", "precision", "recall", "f1", "roc_auc", "warnings")
        best = spark.createDataFrame(best.collect(), best.schema)  # one row
        pred.unpersist()
        out = res.join(best, "model", "left")
        d = _metrics_dir(spark, sf_dir)
        for r in out.collect():   # one row per model family (3 rows)
            save_metrics(spark, {"model": r.model, "f1": r.validation_f1, "test_f1": r.test_f1,
                                 "accuracy": r.accuracy, "training_time": r.train_seconds}, f"{d}/{r.model}")
        save_report(spark, {"algorithm": kind, "features": feats, "selected_k": 10,
                            "total_seconds": _t.perf_counter() - t0, "metrics_dir": d}, f"{d}/_report")
        return out
    return materialized(spark, (sf_dir, "network_training"), build)


@query("network_model_training")
def network_model_training(spark, sf_dir):
    """Train the network model: features -> ANOVA
    top-10 -> standardise -> LR / RF / GBT (the three network model
    families), each cross-validated over a grid on the train split; best by
    validation F1; per-model results plus test metrics, ROC-AUC and
    warnings of the winner.  Metrics and report are written as JSON."""
    return _training_results(spark, sf_dir)


@query("model_comparison")
def model_comparison(spark, sf_dir):
    """Model comparison table read back from the saved metrics files."""
    from ..operators.datasets import model_summary
    _training_results(spark, sf_dir).count()
    return model_summary(spark, f"{_metrics_dir(spark, sf_dir)}/[a-z]*/*.json")


def _network_rf(spark, sf_dir, data, feats):
    """The network random forest fitted on the train split (stored once)."""
    from ..operators.models import fitted
    return fitted(spark, (sf_dir, "network_rf"), lambda: M.classifier_pipeline(feats, "rf", 10, label="label", maxDepth=8)
                  .fit(data.where(F.col("split") == "train")))


@query("network_scoring")
def network_scoring(spark, sf_dir):
    """Fit the network pipeline (random forest) on the train split
    and score every flow: label, max probability, risk from prediction."""
    data = _flow_training_set(spark, sf_dir)
    feats = ["packet_count", "bytes_transferred", "duration_seconds", "connection_count", "failed_connections"] + NETWORK_FEATURES
    model = _network_rf(spark, sf_dir, data, feats)
    out = M.predict_with(model, data)
    verdict = F.when(F.col("prediction") == 1.0, "malicious").otherwise("benign")
    return out.select("l_orderkey", "l_linenumber", "split", F.col("label").cast("int").alias("label"),
                      verdict.alias("prediction"), F.col("probability_max").alias("confidence"),
                      score_from_prediction(verdict, F.col("probability_max")).alias("risk_score"))


@query("network_feature_ranking")
def network_feature_ranking(spark, sf_dir):
    """Top features of the fitted network random forest."""
    feats = ["packet_count", "bytes_transferred", "duration_seconds", "connection_count", "failed_connections"] + NETWORK_FEATURES
    model = _network_rf(spark, sf_dir, _flow_training_set(spark, sf_dir), feats)
    return M.feature_importance(model, feats, spark).orderBy(F.col("importance").desc(), "feature").limit(10)


def _clusters(spark, sf_dir):
    ioc = views.ioc(spark, sf_dir)
    as_of = ioc.select(F.max("created_at")).scalar()
    counts = views.enrichment(spark, sf_dir).groupBy(F.col("ioc_id").alias("id")).agg(F.count(F.lit(1)).alias("enrichment_count"))
    return M.kmeans_clusters(M.cluster_features(ioc, counts, as_of))


@query("ioc_clusters")
def ioc_clusters(spark, sf_dir):
    """K-means clusters of IOCs and their profiles."""
    return M.cluster_profiles(_clusters(spark, sf_dir))


@query("campaigns")
def campaigns(spark, sf_dir):
    """Campaign list derived from the cluster profiles."""
    return M.campaigns(M.cluster_profiles(_clusters(spark, sf_dir)))


def _text_model(spark, sf_dir):
    from ..operators.models import fitted
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lb = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("label"))
    return fitted(spark, (sf_dir, "report_text_toxic"), lambda: M.fit_text(docs.join(lb, "doc_id"))), docs


@query("report_classification")
def report_classification(spark, sf_dir):
    """Text classifier (tokens -> hashed TF -> IDF -> logistic
    regression) trained on labelled documents, scoring every document
    (whole texts): best label, score and all scores."""
    model, docs = _text_model(spark, sf_dir)
    out = M.text_scores(model, docs, ["benign", "toxic"])
    return out.select("doc_id", "label_text", "score", F.array_join(F.transform("all_scores", lambda x: F.format_number(x, 6)), ",").alias("all_scores"))


@query("conversation_attribution")
def conversation_attribution(spark, sf_dir):
    """Classify each conversation as one text.  The bag of words of the
    concatenation is the sum of the turns' bags, so turn vectors are summed
    per conversation (a distributive aggregate) instead of concatenating
    strings in one task."""
    model, _ = _text_model(spark, sf_dir)
    tok, tf, idf, lr = model.stages
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    per_turn = tf.transform(tok.transform(conv))
    summed = per_turn.groupBy("conv_id").agg(Summarizer.sum(F.col("tf")).alias("tf"), F.count(F.lit(1)).alias("turns"))
    scored = lr.transform(idf.transform(summed))
    from pyspark.ml.functions import vector_to_array
    probs = vector_to_array("probability")
    return scored.select("conv_id", "turns", F.when(F.col("prediction") == 1.0, "toxic").otherwise("benign").alias("label_text"),
                         F.array_max(probs).alias("score"))


@query("segment_label_codes", """SELECT c_custkey, c_mktsegment, cast(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS double) AS c_mktsegment_encoded
FROM customer WHERE c_custkey IS NOT NULL AND c_name IS NOT NULL AND c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL""")
def segment_label_codes(spark, sf_dir):
    """W8/M21/XG3: a registered dataset (customer) preprocessed: NULL rows
    dropped, string features encoded with alphabetical codes."""
    from ..operators.datasets import preprocess
    d, _ = preprocess(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_acctbal"], None)
    return d.select("c_custkey", "c_mktsegment", "c_mktsegment_encoded")


def _text_model_for(spark, sf_dir, label_col):
    from ..operators.models import fitted
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lb = table(spark, sf_dir, "labels").select("doc_id", F.col(label_col).cast("double").alias("label"))
    return fitted(spark, (sf_dir, f"report_text_{label_col}"), lambda: M.fit_text(docs.join(lb, "doc_id")))


@query("report_analysis")
def report_analysis(spark, sf_dir):
    """Several text models over the same reports (whole documents),
    each scored independently and the verdicts joined by document id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = []
    for label_col, names in (("toxic", ["benign", "toxic"]), ("quality", ["low_quality", "high_quality"])):
        s = M.text_scores(_text_model_for(spark, sf_dir, label_col), docs, names)
        parts.append(s.select("doc_id", F.col("label_text").alias(f"{label_col}_label"), F.col("score").alias(f"{label_col}_score")))
    return parts[0].join(parts[1], "doc_id")


def _labelled_indicators(spark, sf_dir, type_):
    """Indicators of one type found in labelled documents, each once, with
    the class of most of its documents (toxic or of low quality: 1; ties: 1),
    split and folds.  Written once, so extractors start from plain columns."""
    from ..operators.models import materialized
    return materialized(spark, (sf_dir, "labelled", type_), lambda: _labelled(spark, sf_dir, type_))


def _found(spark, sf_dir, type_):
    """Accepted indicators of one type, written once: whole texts are searched
    in one pass for all that follows."""
    from ..operators.models import materialized
    from .common import accepted
    return materialized(spark, (sf_dir, "found", type_), lambda: accepted(spark, sf_dir, type_).select("origin", "ref_id", "value"))


def _labelled(spark, sf_dir, type_):
    found = _found(spark, sf_dir, type_).where(F.col("origin").startswith("doc")).select(F.col("ref_id").alias("doc_id"), "value")
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad")
    rows = found.join(table(spark, sf_dir, "labels").select("doc_id", bad), "doc_id").groupBy("value").agg((F.avg("bad") >= 0.5).cast("double").alias("label"))
    rows = rows.withColumn("ord", F.pmod(F.xxhash64("value"), F.lit(1000003)))
    return M.stratified_split_folds(rows, "label", F.col("ord"), ["value"], k=3).drop("ord")


RESULTS = "model string, validation_f1 double, test_f1 double, train_f1 double, train_seconds double, tp long, fp long, tn long, fn long, accuracy double, f1 double, type string"
CLASS_LEAST = 15  # rows of each class that training, its folds and its test need


def _trainable(data) -> bool:
    """Whether both classes have rows enough (two counts reach the driver)."""
    counts = [r["count"] for r in data.groupBy("label").count().collect()]
    return len(counts) == 2 and min(counts) >= CLASS_LEAST


def _type_training(spark, sf_dir, type_):
    """Model selection on one type's features, with the test metrics of the
    winner; no rows where a class is too small to train on."""
    from ..operators.models import materialized
    from ..operators.routing import EXTRACTORS
    extract, names = EXTRACTORS[type_]

    def build():
        data = extract(_labelled_indicators(spark, sf_dir, type_)).checkpoint(eager=True)
        if not _trainable(data):
            return spark.createDataFrame([], RESULTS)
        res, model, kind = M.train_select(data, names, "label", k=15, kinds=("lr", "rf"))
        test = model.transform(data.where("split = 'test'"))
        cm = M.confusion_metrics(test.select(F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("p")), "y", "p")
        return res.join(cm.select(F.lit(kind).alias("model"), "tp", "fp", "tn", "fn", "accuracy", "f1"), "model", "left").select(*[F.col(f.split(" ")[0]) for f in RESULTS.split(", ")[:-1]], F.lit(type_).alias("type"))
    return materialized(spark, (sf_dir, f"{type_}_training"), build)


@query("ip_model_training")
def ip_model_training(spark, sf_dir):
    """The IP model, on addresses of labelled documents: features ->
    ANOVA top 15 -> standardise -> LR / RF, cross-validated."""
    return _type_training(spark, sf_dir, "ip")


@query("hash_model_training")
def hash_model_training(spark, sf_dir):
    """The hash model, on digests of labelled documents."""
    return _type_training(spark, sf_dir, "hash")


@query("hash_risk_scoring")
def hash_risk_scoring(spark, sf_dir):
    """Every digest found scored by a logistic hash model: the
    probability of the malicious class and its risk level."""
    from pyspark.ml.functions import vector_to_array

    from ..functions.risk import hash_risk_level
    from ..operators.models import fitted, materialized
    from ..operators.routing import EXTRACTORS
    extract, names = EXTRACTORS["hash"]
    data = extract(_labelled_indicators(spark, sf_dir, "hash"))
    rows = extract(materialized(spark, (sf_dir, "hashes"), lambda: _found(spark, sf_dir, "hash").select("value").distinct()))
    if not _trainable(data):  # no model: undecided, as the fallback prediction is
        return rows.select("value", F.lit(0.5).alias("probability"), hash_risk_level(F.lit(0.5)).alias("risk_level"))
    model = fitted(spark, (sf_dir, "hash_lr"), lambda: M.classifier_pipeline(names, "lr", 8).fit(data.where("split = 'train'")))
    p = F.element_at(vector_to_array("probability"), 2)
    return model.transform(rows).select("value", p.alias("probability"), hash_risk_level(p).alias("risk_level"))
