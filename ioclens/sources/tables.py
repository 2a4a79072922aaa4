"""Driver tables: one Parquet file (or directory) per table.

Reads stay lazy so Catalyst pushes filters and column pruning into the
Parquet scan.  Timestamps in the files carry no zone and are read as
``timestamp_ntz``; the engine keeps that type (the session zone is UTC, so
conversions to instants are exact where arithmetic needs them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
