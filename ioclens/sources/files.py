"""File scans: bulk uploads (CSV/JSON), feed payloads, labelled datasets,
dataset registry lookups (A1-A11, A4, A5, N4, N17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import map_feed_type
from .jsonarray import objects

BULK_SCHEMA = "type string, value string, _corrupt_record string"

PULSE = "created string, modified string, indicators array<struct<type:string, indicator:string>>"
REPORTED = "ipAddress string, lastReportedAt string"

# Timestamp patterns tried in order (ISO with/without fraction, with zone).
TS_PATTERNS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
               "yyyy-MM-dd HH:mm:ss"]


def parse_ts(c) -> "F.Column":
    """First pattern that parses, else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in TS_PATTERNS])


def read_bulk(spark: SparkSession, path: str) -> DataFrame:
    """A1-A3: bulk file routed by suffix (.csv / .json), else rejected.
    PERMISSIVE parsing keeps malformed lines in ``_corrupt_record``; the
    source file is kept as lineage."""
    low = path.lower()
    if low.endswith(".csv"):
        df = spark.read.schema(BULK_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)
    elif low.endswith(".json"):
        df = spark.read.schema(BULK_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    else:
        raise ValueError(f"unsupported bulk file type: {path}")
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def read_bulk_array(spark: SparkSession, path: str) -> DataFrame:
    """A2: bulk files that are one JSON array of {type, value} objects, read
    in parallel however large; a file with a single object gives its row."""
    one, many = (objects(spark, path, depth).select("path", F.from_json("json", "type string, value string").alias("r")) for depth in (0, 1))
    rows = one.unionByName(many)
    return rows.select("r.type", "r.value", F.col("path").alias("source_file"))


def read_pulses(spark: SparkSession, path: str, source: str = "AlienVault OTX") -> DataFrame:
    """A4: landed pulse feed -> (type, value, source, first_seen, last_seen);
    rows lacking type or value are dropped."""
    p = objects(spark, path, 2).select(F.from_json("json", PULSE).alias("p"))
    i = p.select("p.created", "p.modified", F.explode("p.indicators").alias("i"))
    i = i.where(F.col("i.type").isNotNull() & F.col("i.indicator").isNotNull())
    return i.select(map_feed_type(F.col("i.type")).alias("type"), F.col("i.indicator").alias("value"),
                    F.lit(source).alias("source"), parse_ts("created").alias("first_seen"),
                    parse_ts("modified").alias("last_seen"))


def read_blacklist(spark: SparkSession, path: str, source: str = "AbuseIPDB") -> DataFrame:
    """A5: landed blacklist feed -> (type 'ip', value, source, last_seen)."""
    d = objects(spark, path, 2).select(F.from_json("json", REPORTED).alias("d")).where(F.col("d.ipAddress").isNotNull())
    return d.select(F.lit("ip").alias("type"), F.col("d.ipAddress").alias("value"), F.lit(source).alias("source"),
                    F.lit(None).cast("timestamp").alias("first_seen"), parse_ts("d.lastReportedAt").alias("last_seen"))


def read_feeds(spark: SparkSession, pulses: str | None, blacklist: str | None) -> DataFrame:
    """Union of the feeds (missing columns allowed)."""
    parts = []
    if pulses:
        parts.append(read_pulses(spark, pulses))
    if blacklist:
        parts.append(read_blacklist(spark, blacklist))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


DATASET_SCHEMAS = {
    "domain": "domain string, is_malicious int, risk_score double, source string",
    "ip": "ip string, is_malicious int, risk_score double, source string",
    "url": "url string, status int",
    "network": ("packet_count long, bytes_transferred long, duration_seconds double, connection_count long, "
                "failed_connections long, is_anomalous int"),
    "hash": "hash string, is_malicious int",
}
DATASET_KEYS = {"domain": "domain", "ip": "ip", "url": "url", "hash": "hash"}


def read_dataset(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Labelled CSV dataset with the columns of its kind, in any order
    and among others (a ``ValueError`` names those it lacks); of rows with one
    key the first in file order stays (U3), labels become ``is_malicious``."""
    raw = spark.read.option("header", True).csv(path)
    fields = [f.split(" ") for f in DATASET_SCHEMAS[kind].split(", ")]
    missing = [n for n, _ in fields if n not in raw.columns]
    if missing:
        raise ValueError(f"{kind} dataset lacks columns: {', '.join(missing)}")
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    df = raw.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in fields], at.alias("_at"))
    key = DATASET_KEYS.get(kind)
    if key:
        first = F.min_by(F.struct(*[n for n, _ in fields if n != key]), "_at")
        df = df.groupBy(key).agg(first.alias("_f")).select(*[F.col(n) if n == key else F.col(f"_f.{n}").alias(n) for n, _ in fields])
    return df.drop("_at").withColumnsRenamed({"status": "is_malicious", "is_anomalous": "is_malicious"})


def locate_dataset(spark: SparkSession, folder: str, name: str) -> str | None:
    """First existing of data.csv, train.csv, dataset.csv, <name>.csv,
    data.json in ``folder`` (Hadoop FS, so any cluster file system)."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for f in ["data.csv", "train.csv", "dataset.csv", f"{name}.csv", "data.json"]:
        p = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{f}")
        if p.getFileSystem(conf).exists(p):
            return p.toString()
    return None
