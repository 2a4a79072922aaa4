"""X-ANY: one plan that routes a mixed indicator table to the extractor of
each row's type.

The table is written once, by type; each extractor then reads only its own
part, so the source is scanned once and no row meets an extractor that is not
its own.  Results have one shape for all types: (id, type, feature, x).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domain import DOMAIN_FEATURES, domain_features
from ..functions.hashes import HASH_FEATURES, hash_features
from ..functions.ipv4 import IP_FEATURES, ip_features
from ..functions.network import NETWORK_FEATURES, network_features, network_text_flows
from ..functions.urlfeat import URL_FEATURES, url_features
from ..session import scratch_path

FLOW_FEATURES = ["packet_count", "bytes_transferred", "duration_seconds", "connection_count", "failed_connections"]
#: type -> (rows with ``value`` -> rows with features, the features).
EXTRACTORS = {
    "ip": (lambda df: ip_features(df.where(~F.contains("value", F.lit(":"))), "value"), IP_FEATURES),  # IPv4 only, as trained
    "domain": (lambda df: domain_features(df, "value"), DOMAIN_FEATURES),
    "url": (lambda df: url_features(df, "value"), URL_FEATURES),
    "hash": (lambda df: hash_features(df, "value"), HASH_FEATURES),
    "network": (lambda df: network_features(network_text_flows(df, "value")), FLOW_FEATURES + NETWORK_FEATURES),
}


def route(rows: DataFrame) -> dict[str, DataFrame]:
    """type -> (id, value, features...) of (id, type, value) rows.  Types
    without an extractor, and null types or values, are left out."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "routed")
    rows.select("id", "type", "value").where(F.col("type").isin(*EXTRACTORS) & F.col("value").isNotNull()).write.partitionBy("type").parquet(path)
    schema = rows.select("id", "value", F.col("type").cast("string").alias("type")).schema
    parts = spark.read.schema(schema).parquet(path)
    return {t: extract(parts.where(F.col("type") == t).drop("type")).select("id", "value", *names) for t, (extract, names) in EXTRACTORS.items()}


def long_features(routed: dict[str, DataFrame]) -> DataFrame:
    """(id, type, feature, x) of all types' features."""
    parts = []
    for t, df in routed.items():
        names = EXTRACTORS[t][1]
        items = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names])
        parts.append(df.select("id", F.lit(t).alias("type"), F.inline(items)))
    return reduce(lambda a, b: a.unionByName(b), parts)
