"""Account roll-ups and assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ACCOUNT_HIGH_RISK
from .joins import left_join_known
from .topn import top_n
from .upsert import new_keys


def account_statistics(accounts: DataFrame, mapping: DataFrame, iocs: DataFrame) -> DataFrame:
    """G6 for every account: mapping counts, and average / high (> 0.7) risk
    over the distinct IOCs mapped to it (NULL scores ignored)."""
    counts = mapping.groupBy("account_id").agg(F.count(F.lit(1)).alias("total_threats"),
                                               F.count("ioc_id").alias("ioc_count"),
                                               F.count("threat_input_id").alias("threat_input_count"))
    mapped = mapping.where(F.col("ioc_id").isNotNull()).select("account_id", "ioc_id").distinct()
    risk = mapped.join(iocs.select(F.col("id").alias("ioc_id"), "risk_score"), "ioc_id") \
        .where(F.col("risk_score").isNotNull()) \
        .groupBy("account_id").agg(F.avg(F.col("risk_score").cast("double")).alias("avg_risk_score"),
                                   F.count_if(F.col("risk_score") > ACCOUNT_HIGH_RISK).alias("high_risk_count"))
    a = accounts.select(F.col("id").alias("account_id"), "name")
    j = a.join(counts, "account_id", "left").join(risk, "account_id", "left")
    return j.select("account_id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in
                                            ("total_threats", "ioc_count", "threat_input_count")],
                    F.coalesce("avg_risk_score", F.lit(0.0)).alias("avg_risk_score"),
                    F.coalesce("high_risk_count", F.lit(0)).alias("high_risk_count"))


def account_threats(mapping: DataFrame, iocs: DataFrame, limit: int = 100) -> DataFrame:
    """Each account's first ``limit`` mappings (by id) with the IOC
    details; a hot account is ranked with a two-level top-n."""
    top = top_n(mapping, ["account_id"], [F.col("id")], limit, ["id"])
    i = iocs.select(F.col("id").alias("ioc_id"), F.col("type").alias("ioc_type"), F.col("value").alias("ioc_value"),
                    F.col("risk_score").cast("double").alias("ioc_risk_score"))
    return left_join_known(top, i, "ioc_id").select("account_id", F.col("id").alias("mapping_id"), "ioc_id", "ioc_type",
                                                "ioc_value", "ioc_risk_score", "threat_input_id", "assigned_at", "rank")


def scoped(df: DataFrame, mapping: DataFrame, account_id, key: str = "id") -> DataFrame:
    """Rows whose IOC is mapped to ``account_id`` (semi join)."""
    ids = mapping.where(F.col("account_id") == account_id).select(F.col("ioc_id").alias(key))
    return df.join(ids, key, "left_semi")


def assign(mapping: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """New mapping rows for (account, key) pairs not yet assigned."""
    return new_keys(requests, mapping.where(F.col(key).isNotNull()), ["account_id", key])


def unassign(mapping: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Mapping without the requested (account, key) pairs."""
    return mapping.join(requests.select("account_id", key), ["account_id", key], "left_anti")


def default_account(accounts: DataFrame, name: str = "Default", now=None) -> DataFrame:
    """The accounts table with a default account added if absent."""
    spark = accounts.sparkSession
    row = spark.createDataFrame([(name,)], "name string")
    missing = row.join(accounts.select("name"), "name", "left_anti")
    next_id = accounts.select(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
    add = missing.select(next_id.alias("id"), "name")
    return accounts.select("id", "name").unionByName(add)
