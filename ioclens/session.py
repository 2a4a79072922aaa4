"""SparkSession factory and cluster-facing settings.

On a cluster the session comes from the platform; ``configure`` only fills in
settings that are unset, so operators never override what the cluster names
(``spark.checkpoint.dir`` in particular).
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE coalesces small shuffle partitions and
# splits skewed join partitions at run time; the session zone pins timestamp
# arithmetic to UTC (the reference stores naive UTC times).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only sides whose measured size is small.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def build_local(app: str = "ioclens", cores: str | int = "*", shuffle_partitions: int = 8,
                extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench.  UI off, no extra ports."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply DEFAULTS where unset and make sure a checkpoint dir exists.

    The checkpoint directory is read from the session; a scratch folder is set
    only when nothing is configured (local tests).  On a cluster the shared
    folder named in ``spark.checkpoint.dir`` is used as is.
    """
    conf = spark.conf
    for k, v in DEFAULTS.items():
        if k in ("spark.sql.shuffle.partitions",):
            continue
        try:
            if conf.get(k, None) is None:
                conf.set(k, v)
        except Exception:  # static conf on a running cluster session
            pass
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: ``spark.checkpoint.dir`` if set, else a
    fresh scratch folder on a local master; elsewhere an unset folder is an
    error, since a machine-local one would lose data with the machine."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="ioclens-ckpt-", dir=os.environ.get("IOCLENS_SCRATCH", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", named)
        except Exception:  # not settable at run time: the context setting below suffices
            pass
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate
    tables (lineage cuts, streaming sinks and checkpoints)."""
    import uuid
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, **conf):
    """Run what is inside with other SQL settings (dots of a name written as
    two underscores), which are put back after it."""
    conf = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of a narrow table of ids that a task takes.
ROWS_A_TASK = 250_000


def small_tasks(spark: SparkSession, rows: int):
    """Settings for iterated joins of about ``rows`` ids and labels.  Such
    columns shrink to a fraction in a shuffle, so tasks sized by the usual
    64 MB, and keys that count as hot from 256 MB on only, hold many times
    that in memory; here the tasks of a shuffle grow in number with the rows."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return settings(spark, spark__sql__adaptive__coalescePartitions__parallelismFirst="false",
                    spark__sql__adaptive__advisoryPartitionSizeInBytes="2m",
                    spark__sql__adaptive__coalescePartitions__initialPartitionNum=max(own, -(-rows // ROWS_A_TASK)),
                    spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="4m",
                    spark__sql__adaptive__skewJoin__skewedPartitionFactor="2.0",
                    spark__sql__files__maxPartitionBytes="8m")
