"""Top-n per group that survives a hot group.

A plain ``row_number() over (partition by g order by o) <= n`` sorts every
row of a group inside one task.  Here the first pass ranks inside
(group, salt) sub-partitions (salt = hash of the row key), keeping at most n
candidates per sub-partition; the second pass ranks those few candidates per
group.  The result is exact: a global top-n row is a top-n row of its
sub-partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, key: list[str],
          salt_buckets: int = 64, rank_col: str = "rank") -> DataFrame:
    salt = F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(salt_buckets))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    cand = df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return cand.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= n).drop("_salt", "_r1")
