"""Set-wise ingestion composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize_inputs
from ..functions.risk import fallback_score
from .upsert import delete_keys, merge_upsert


def split_batch(raw: DataFrame, value: str = "value", type_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) -- one normalisation, two filters."""
    n = normalize_inputs(raw, value, type_col)
    return n.where(F.col("reject_reason").isNull()), n.where(F.col("reject_reason").isNotNull())


def upsert_iocs(iocs: DataFrame, accepted: DataFrame, as_of: Column, source: str = "User Input") -> DataFrame:
    """Dedupe the batch on (type, value), then merge: new keys get
    first_seen = last_seen = as_of, the batch source and the text fallback
    score (R6 without enrichment); existing keys get last_seen = as_of."""
    batch = accepted.groupBy("type", "value").agg(F.count(F.lit(1)).alias("_n")) \
        .select("type", "value", F.lit(source).alias("source"), F.lit(None).cast("bigint").alias("id"),
                fallback_score("type", "value").alias("risk_score"),
                as_of.alias("first_seen"), as_of.alias("last_seen"), F.lit(True).alias("is_new"))
    cur = iocs.select("id", "type", "value", "source", "risk_score", F.col("created_at").alias("first_seen"),
                      F.col("created_at").alias("last_seen"), F.lit(False).alias("is_new"))
    rules = {
        "id": F.col("c.id"),
        "source": F.coalesce(F.col("c.source"), F.col("u.source")),
        "risk_score": F.coalesce(F.col("c.risk_score"), F.col("u.risk_score")),
        "first_seen": F.coalesce(F.col("c.first_seen"), F.col("u.first_seen")),
        "last_seen": F.col("u.last_seen"),
        "is_new": F.col("c.type").isNull(),
    }
    return merge_upsert(cur, batch, ["type", "value"], rules=rules)


def upsert_iocs_table(table: DataFrame, accepted: DataFrame, as_of: Column, source: str = "User Input") -> DataFrame:
    """J2 on an already-merged IOC table (columns of ``upsert_iocs``)."""
    batch = accepted.groupBy("type", "value").agg(F.count(F.lit(1)).alias("_n")) \
        .select(F.lit(None).cast("bigint").alias("id"), "type", "value", F.lit(source).alias("source"),
                fallback_score("type", "value").alias("risk_score"), as_of.alias("first_seen"), as_of.alias("last_seen"),
                F.lit(True).alias("is_new"))
    rules = {
        "id": F.col("c.id"),
        "source": F.coalesce(F.col("c.source"), F.col("u.source")),
        "risk_score": F.coalesce(F.col("c.risk_score"), F.col("u.risk_score")),
        "first_seen": F.coalesce(F.col("c.first_seen"), F.col("u.first_seen")),
        "last_seen": F.col("u.last_seen"),
        "is_new": F.coalesce(F.col("c.is_new"), F.lit(True)),
    }
    return merge_upsert(table, batch, ["type", "value"], rules=rules)


def lifecycle_new_rows(new_iocs: DataFrame, as_of: Column) -> DataFrame:
    """L4: one 'new' lifecycle row per ingested indicator."""
    return new_iocs.select("type", "value", F.lit("new").alias("state"), as_of.alias("ts"))


def fallback_predictions(iocs_without_model: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """M14: 'unknown' at 0.5 from the 'fallback' model; ``keep``: further
    columns to carry."""
    return iocs_without_model.select(*(keep or []), "type", "value", F.lit("fallback").alias("model_name"),
                                     F.lit("unknown").alias("prediction"), F.lit(0.5).alias("confidence"),
                                     F.to_json(F.struct(F.col("type").alias("ioc_type"), "value",
                                                        F.lit("fallback").alias("model_used"),
                                                        F.lit(0.5).alias("confidence"))).alias("features_used"))


def cascade_delete(ids: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Remove the IOC ids from every child table (anti joins per key
    column; a relationship goes if either end is deleted)."""
    out = {}
    for name, (df, keys) in tables.items():
        cur = df
        for k in keys:
            cur = delete_keys(cur, ids, k, "id")
        out[name] = cur
    return out


def create_iocs(requests: DataFrame, iocs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(created, rejected duplicates) for an IOC create batch; the
    batch is deduplicated first (of repeats the smallest ``id`` stays, or the
    smallest row), existing (type, value) keys are rejected."""
    from .upsert import dedupe_min, new_keys, present_keys
    others = sorted(set(requests.columns) - {"type", "value"}, key=lambda c: (c != "id", c))
    batch = dedupe_min(requests, ["type", "value"], others[0]) if others else requests.distinct()
    return new_keys(batch, iocs, ["type", "value"]), present_keys(batch, iocs, ["type", "value"]) \
        .withColumn("reject_reason", F.lit("duplicate"))


def delete_predictions(predictions: DataFrame, ids: DataFrame, by: str = "id") -> tuple[DataFrame, DataFrame]:
    """Predictions without the given ids (``by`` = 'id' or 'ioc_id')
    and the number removed (one-row frame)."""
    keep = delete_keys(predictions, ids, by, by)
    removed = predictions.join(ids.select(by).distinct(), by, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return keep, removed


#: The tables that ingestion writes, with their keys (none: rows are added).
INGEST_TABLES = {
    "threat_input": ("input_id string, type string, value string, account_id long, status string, created_at timestamp_ntz", []),
    "ioc": ("type string, value string, source string, risk_score decimal(3,2), first_seen timestamp_ntz, last_seen timestamp_ntz", ["type", "value"]),
    "mapping": ("account_id long, type string, value string, input_id string", []),
    "lifecycle": ("input_id string, type string, value string, state string, ts timestamp_ntz", []),
    "prediction": ("input_id string, type string, value string, model_name string, prediction string, confidence double", []),
    "job": ("batch long, total_items long, processed_items long, rejected_items long, status string", []),
}


def ingest_batch(tables, requests: DataFrame, batch: int, as_of, source: str = "User Input") -> bool:
    """A batch of requests (input_id, type, value,
    account_id) into all INGEST_TABLES under one version.

    Normalisation runs once, its result is written and read by every sink:
    each accepted request is a processed input, a mapping if it names an
    account, a 'new' lifecycle row and a prediction; distinct indicators are
    inserted or have ``last_seen`` moved, rewriting only the buckets they fall
    in; rejects and requests without a value count in the job row.  False, and
    nothing written, if the batch is already in."""
    if tables.done(batch):
        return False
    spark = requests.sparkSession
    staged = f"{tables.path}/_staged/{batch}"
    normalize_inputs(requests, "value", "type").select("input_id", "type", "value", "account_id", "reject_reason").write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged)
    good = rows.where("reject_reason IS NULL")
    now = F.lit(as_of).cast("timestamp_ntz")
    found = good.select("type", "value").distinct()
    buckets = tables.touched("ioc", found)
    fresh = found.select("type", "value", F.lit(source).alias("source"), fallback_score("type", "value").alias("risk_score"), now.alias("first_seen"), now.alias("last_seen"))
    rules = {"source": F.coalesce("c.source", "u.source"), "risk_score": F.coalesce("c.risk_score", "u.risk_score"),
             "first_seen": F.coalesce("c.first_seen", "u.first_seen"), "last_seen": F.col("u.last_seen")}
    iocs = merge_upsert(tables.read("ioc", buckets), fresh, ["type", "value"], rules=rules)
    verdict = fallback_predictions(good.select("input_id", "type", "value"), keep=["input_id"])
    job = rows.agg(F.lit(batch).cast("long").alias("batch"), F.count(F.lit(1)).alias("total_items"), F.count_if(F.col("reject_reason").isNull()).alias("processed_items"),
                   F.count_if(F.col("reject_reason").isNotNull()).alias("rejected_items"), F.lit("completed").alias("status"))
    return tables.commit(batch, appends={
        "threat_input": good.select("input_id", "type", "value", "account_id", F.lit("processed").alias("status"), now.alias("created_at")),
        "mapping": good.where("account_id IS NOT NULL").select("account_id", "type", "value", "input_id"),
        "lifecycle": good.select("input_id", "type", "value", F.lit("new").alias("state"), now.alias("ts")),
        "prediction": verdict, "job": job,
    }, replaces={"ioc": (iocs, buckets)})
