"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from ..sources.tables import table

__all__ = ["documents", "scratch_path", "stored", "table"]

#: White space of words and lines (fixed value): space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]"


#: Rows of an Arrow batch where the session has Spark's default: texts are
#: long, and a worker holds a batch several times over.
BATCH_ROWS = 3000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    return table(spark, sf_dir, "documents")


FILES = 3


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """The rows written once as Parquet in the shared folder, then read back:
    cuts lineage and survives lost executors as a checkpoint does, but is
    computed once and readable column by column.  ``narrow`` rows, of a few
    numbers each, are written as FILES files a core at most, so many
    partitions do not make many small files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.coalesce(FILES * spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_file(uri: str):
    """(file system, path) of a file in the shared folder, for use in tasks;
    any store pyarrow knows (local or mounted paths, HDFS, object stores)."""
    from pyarrow import fs
    if "://" not in uri and uri.startswith("file:"):
        uri = uri[len("file:"):]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
