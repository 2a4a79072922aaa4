"""Stream sources: the driver's events file replayed as a file stream, and
drop folders of bulk CSV/JSON files (S1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import views
from ..sources.files import BULK_SCHEMA

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1, pattern: str = "events.parquet") -> DataFrame:
    """``events.parquet`` of ``sf_dir`` as a streaming source.  Event time
    becomes TIMESTAMP (watermarks require it); with the UTC session zone the
    instant is unchanged."""
    from pyspark.sql import functions as F
    s = (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", pattern)
         .option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir))
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def ioc_stream(spark, sf_dir):
    return views.ioc_from_events(events(spark, sf_dir))


def alert_stream(spark, sf_dir):
    return views.alert_from_events(events(spark, sf_dir))


def lifecycle_stream(spark, sf_dir):
    return views.lifecycle_from_events(events(spark, sf_dir))


def bulk_drops(spark: SparkSession, folder: str, fmt: str = "json", files: int = 1000) -> DataFrame:
    """Newly landed bulk files (type?, value) in a drop folder, at most
    ``files`` a micro-batch."""
    r = spark.readStream.schema(BULK_SCHEMA).option("maxFilesPerTrigger", files)
    if fmt == "json":
        return r.option("multiLine", True).json(folder)
    return r.option("header", True).csv(folder)


LINEITEM_SCHEMA = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                   "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                   "l_linestatus string, l_shipdate timestamp_ntz")


def enrichment_stream(spark, sf_dir):
    """Enrichment payloads derived from the events stream (same rule as the
    batch view)."""
    return views.enrichment_from_events(events(spark, sf_dir))


def flow_stream(spark, sf_dir):
    """lineitem.parquet replayed as a stream of flows."""
    from pyspark.sql import functions as F
    li = (spark.readStream.schema(LINEITEM_SCHEMA).option("pathGlobFilter", "lineitem.parquet")
          .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    return li.select(
        "l_orderkey", "l_linenumber",
        F.floor("l_quantity").cast("bigint").alias("packet_count"),
        F.floor("l_extendedprice").cast("bigint").alias("bytes_transferred"),
        (F.col("l_tax") * 100).alias("duration_seconds"),
        F.col("l_linenumber").alias("connection_count"),
        (F.floor(F.col("l_discount") * 100 + 0.5).cast("bigint") % 3).alias("failed_connections"))
