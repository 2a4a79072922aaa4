"""Sinks (A17-A23, A20-A22, A24): reports and metrics written by Spark to
any Hadoop path; write-then-swap commits for table rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines report."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV report with a header row."""
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet table (optionally partitioned, e.g. by day or type)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def commit_swap(spark, df: DataFrame, table_path: str) -> str:
    """Write-then-swap: write the new version next to the table, then move
    the directories, so readers never see a half-written table."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    new = Path(table_path.rstrip("/") + ".__new")
    old = Path(table_path.rstrip("/") + ".__old")
    cur = Path(table_path)
    fs = cur.getFileSystem(conf)
    df.write.mode("overwrite").parquet(new.toString())
    if fs.exists(cur):
        if fs.exists(old):
            fs.delete(old, True)
        if not fs.rename(cur, old):
            raise OSError(f"{cur} could not be moved aside; the new version is in {new}")
    # the old version stays until the new one is in place
    if not fs.rename(new, cur):
        restored = not fs.exists(old) or fs.rename(old, cur)
        raise OSError(f"{new} could not be moved into place; the old version is {'back' if restored else f'in {old}'}")
    if fs.exists(old):
        fs.delete(old, True)
    return table_path
