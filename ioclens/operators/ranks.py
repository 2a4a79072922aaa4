"""Running totals in the order of a value, without a window over a whole
group: the base of exact quantiles (G17) and exact ROC-AUC (G23).

Rows, already one per distinct value of a group, are cut into ranges of about
ROWS of them and written once with their range's number; totals run inside
(group, range), and each range starts from the earlier ranges' sums, one row
a (group, range).  The number of ranges follows the data, and a group with
nearly all rows lies in many ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

ROWS = 1 << 18


def running(values: DataFrame, keys: list[str], order: str, sums: list[str], rows: int = ROWS) -> DataFrame:
    """``values`` with ``before_<s>`` for each of ``sums``: its total over the
    smaller values of ``order`` within ``keys``.  (keys, order) is unique."""
    spark = values.sparkSession
    staged, cut = scratch_path(spark, "ranks"), scratch_path(spark, "ranks-cut")
    values.write.parquet(staged)
    values = spark.read.parquet(staged)
    n = max(1, -(-values.count() // rows))
    values.repartitionByRange(n, *keys, order).withColumn("_b", F.spark_partition_id()).write.parquet(cut)
    own = spark.read.parquet(cut)
    groups = own.groupBy(*keys, "_b").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(*keys, "_b", *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}") for s in sums])
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"in_{s}") for s in sums])
    joined = own.join(starts, [*keys, "_b"])
    return joined.select(*values.columns, *[(F.col(f"in_{s}") + F.col(f"_{s}")).alias(f"before_{s}") for s in sums])


def unpivot(df: DataFrame, cols: list[str], carry: list[str] | None = None) -> DataFrame:
    """(carry..., name, x): one row for each finite-or-infinite number of the
    columns; nulls and NaN are left out."""
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in cols])
    return df.select(*(carry or []), F.inline(items)).where(F.col("x").isNotNull() & ~F.isnan("x"))


def quantiles(df: DataFrame, cols: list[str], qs: list[float]) -> DataFrame:
    """(name, q_0...): exact quantiles of several columns at once, with linear
    interpolation; repeated values are counted map-side first."""
    counts = unpivot(df, cols).groupBy("name", "x").agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, ["name"], "x", ["n"])
    total = ranked.groupBy("name").agg(F.sum("n").alias("total"))
    ranked = ranked.join(total, "name")
    aggs = []
    for i, q in enumerate(qs):
        pos = (F.col("total") - 1) * q
        low, high = (F.max(F.when((F.col("before_n") <= k) & (k < F.col("before_n") + F.col("n")), F.col("x"))) for k in (F.floor(pos), F.ceil(pos)))
        part = F.max(pos - F.floor(pos))
        aggs.append((low + part * (high - low)).alias(f"q_{i}"))
    return ranked.groupBy("name").agg(*aggs)


def roc_auc(df: DataFrame, scores: list[str], label: str) -> DataFrame:
    """(name, positives, negatives, auc) of each score column against a 0/1
    label: the share of (positive, negative) pairs in the right order, ties
    counting half; null where a class is missing."""
    y = F.col(label).cast("long")
    counts = unpivot(df.where(F.col(label).isNotNull()), scores, [label]).groupBy("name", "x").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    ranked = running(counts, ["name"], "x", ["neg"])
    total = ranked.groupBy("name").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
                                       F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("area"))
    return total.select("name", "positives", "negatives", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("area") / F.col("positives") / F.col("negatives")).alias("auc"))


def anova(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """M1/M2: (name, f_value, mean, std) of each feature: the ANOVA F of its
    values by class, and what standardising needs (population deviation).  One
    aggregate over all features gives each class's count, mean and variance,
    which merge; a class is one row of it."""
    per = df.where(F.col(label).isNotNull()).groupBy(label).agg(*[f(F.col(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(features)
                                                                for p, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v")) for i, c in enumerate(features)])
    rows = per.select(F.inline(items)).where("n > 0")
    whole = rows.groupBy("name").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("k"))
    rows = rows.join(whole, "name")
    g = rows.groupBy("name", "total", "mean", "k").agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    f = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("total") - F.col("k")))
    return g.select("name", F.when((F.col("k") > 1) & (F.col("within") > 0), f).alias("f_value"), "mean", F.sqrt((F.col("between") + F.col("within")) / F.col("total")).alias("std"))
