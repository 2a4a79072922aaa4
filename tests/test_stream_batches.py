"""Streams over several micro-batches."""

from pyspark.sql import functions as F

from ioclens.sources import sinks
from ioclens.streaming import jobs


def test_dedupe_over_micro_batches(spark, tmp_path):
    """A key that comes again days later, in another batch, comes out once."""
    src = str(tmp_path / "in")
    for day in range(3):
        rows = spark.range(40).select(F.lit("ip").alias("type"), (F.col("id") % 15).cast("string").alias("value"),
                                      F.expr(f"timestamp'2024-01-01' + make_dt_interval({day * 3})").alias("created_at"))
        rows.coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = jobs.run(jobs.dedupe_keys(stream), "dedupe-test").collect()
    assert sorted(int(r.value) for r in out) == list(range(15))


def test_swap_keeps_one_version(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in (3, 5):
        sinks.commit_swap(spark, spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["table"]
