"""Composite pipelines: bulk ingestion through a file round trip and the
cascading delete."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators.models import materialized
from ..session import scratch_path
from ..sources import sinks, views
from ..sources.files import read_bulk
from ..sources.versioned import Tables
from .ingest import FALLBACK_SQL, NORM
from .registry import query
from .sqlfrag import normalized_raw_inputs


BULK_SQL = f"""WITH {NORM},
b AS (SELECT DISTINCT type, value FROM norm WHERE reject_reason IS NULL),
now AS (SELECT max(created_at) AS t FROM ioc)
SELECT i.id, i.type, i.value, i.source, i.risk_score, i.created_at AS first_seen,
  CASE WHEN b.value IS NOT NULL THEN (SELECT t FROM now) ELSE i.created_at END AS last_seen, false AS is_new
FROM ioc i LEFT JOIN b ON i.type = b.type AND i.value = b.value
UNION ALL
SELECT NULL, b.type, b.value, 'User Input', {FALLBACK_SQL('b.type', 'b.value')}, (SELECT t FROM now), (SELECT t FROM now), true
FROM b WHERE NOT EXISTS (SELECT 1 FROM ioc i WHERE i.type = b.type AND i.value = b.value)"""


@query("bulk_ingest", BULK_SQL)
def bulk_ingest(spark, sf_dir):
    """Raw inputs written as a bulk CSV (A21), scanned back (A1/A3),
    normalised and split (N15), deduplicated and merged into the IOC table
    (J1/J2) with fallback scores for new indicators (M14/R6)."""
    path = scratch_path(spark, "bulk") + "/upload.csv"
    raw = views.raw_inputs(spark, sf_dir).select(F.lit(None).cast("string").alias("type"), "value")
    sinks.write_csv(raw, path)   # one part file per task, read back by glob
    scanned = read_bulk(spark, path + "/*.csv")
    acc, _ = I.split_batch(scanned, "value", "type")
    ioc = views.ioc(spark, sf_dir)
    now = ioc.select(F.max("created_at")).scalar()
    return I.upsert_iocs(ioc, acc, now)


@query("cascade_delete", """WITH d AS (SELECT id FROM ioc WHERE type = 'network' AND cast(created_at AS date) = (SELECT min(cast(created_at AS date)) FROM ioc))
SELECT 'ioc' AS table_name, count(*) AS remaining FROM ioc WHERE id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'alert', count(*) FROM alert WHERE ioc_id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'enrichment', count(*) FROM enrichment WHERE ioc_id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'prediction', count(*) FROM prediction WHERE ioc_id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'lifecycle', count(*) FROM lifecycle WHERE ioc_id IS NULL OR ioc_id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'relationship', count(*) FROM relationship WHERE ioc1_id NOT IN (SELECT id FROM d) AND ioc2_id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'mapping', count(*) FROM mapping WHERE ioc_id IS NULL OR ioc_id NOT IN (SELECT id FROM d)""")
def cascade_delete(spark, sf_dir):
    """Delete the first day's network IOCs and cascade to
    alerts, enrichments, predictions, lifecycle, relationships, mappings."""
    ioc = views.ioc(spark, sf_dir)
    first = ioc.select(F.min(F.to_date("created_at"))).scalar()
    ids = ioc.where((F.col("type") == "network") & (F.to_date("created_at") == first)).select("id")
    tables = {
        "ioc": (ioc, ["id"]), "alert": (views.alert(spark, sf_dir), ["ioc_id"]),
        "enrichment": (views.enrichment(spark, sf_dir), ["ioc_id"]), "prediction": (views.prediction(spark, sf_dir), ["ioc_id"]),
        "lifecycle": (views.lifecycle(spark, sf_dir), ["ioc_id"]),
        "relationship": (views.relationship(spark, sf_dir), ["ioc1_id", "ioc2_id"]),
        "mapping": (views.mapping(spark, sf_dir), ["ioc_id"]),
    }
    left = I.cascade_delete(ids, tables)
    parts = [df.agg(F.count(F.lit(1)).alias("remaining")).select(F.lit(n).alias("table_name"), "remaining") for n, df in left.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


INGEST_SQL = f"""norm AS ({normalized_raw_inputs("requests", "input_id, batch, account_id", "hint")}),
good AS (SELECT * FROM norm WHERE reject_reason IS NULL),
clock AS (SELECT max(created_at) AS t FROM ioc),
timed AS (SELECT g.*, CASE batch WHEN 1 THEN t - INTERVAL 1 DAY ELSE t END AS t FROM good g, clock)"""


def _landed(spark, sf_dir):
    """The requests as a landed table, written once per dataset."""
    return materialized(spark, (sf_dir, "requests"), lambda: views.requests(spark, sf_dir))


@query("ingest_pipeline", f"""WITH {INGEST_SQL}
SELECT 'threat_input' AS table_name, input_id, type, value, account_id, 'processed' AS detail, t AS first_seen, t AS last_seen, NULL AS score FROM timed
UNION ALL SELECT 'ioc', NULL, type, value, NULL, 'User Input', min(t), max(t), cast({FALLBACK_SQL('type', 'value')} AS double) FROM timed GROUP BY type, value
UNION ALL SELECT 'mapping', input_id, type, value, account_id, NULL, NULL, NULL, NULL FROM good WHERE account_id IS NOT NULL
UNION ALL SELECT 'lifecycle', input_id, type, value, NULL, 'new', t, t, NULL FROM timed
UNION ALL SELECT 'prediction', input_id, type, value, NULL, 'fallback:unknown', NULL, NULL, 0.5 FROM good
UNION ALL SELECT 'job', cast(batch AS varchar), NULL, NULL, count(*), 'completed:' || count(*) FILTER (reject_reason IS NULL), NULL, NULL, NULL
FROM norm GROUP BY batch""")
def ingest_pipeline(spark, sf_dir):
    """Two batches of requests, the second with keys
    of the first, into six tables under one version each; the first batch is
    sent again at the end and changes nothing.  Returns all tables' rows."""
    tables = Tables(spark, scratch_path(spark, "ingest"), I.INGEST_TABLES)
    asked = _landed(spark, sf_dir)
    last = views.ioc(spark, sf_dir).select(F.max("created_at")).first()[0]
    for batch in (1, 2, 1):
        I.ingest_batch(tables, asked.where(F.col("batch") == batch), batch, last if batch == 2 else last - timedelta(days=1))
    none = F.lit(None)

    def rows(name, input_id=F.col("input_id"), account=none, detail=none, first=none, last=none, score=none):
        t = tables.read(name)
        own = {c: F.col(c) if c in t.columns else none.cast("string") for c in ("type", "value")}
        return t.select(F.lit(name).alias("table_name"), input_id.cast("string").alias("input_id"), own["type"].alias("type"), own["value"].alias("value"),
                        account.cast("long").alias("account_id"), detail.cast("string").alias("detail"), first.cast("timestamp_ntz").alias("first_seen"),
                        last.cast("timestamp_ntz").alias("last_seen"), score.cast("double").alias("score"))
    c = F.col
    parts = [rows("threat_input", account=c("account_id"), detail=c("status"), first=c("created_at"), last=c("created_at")),
             rows("ioc", none, detail=c("source"), first=c("first_seen"), last=c("last_seen"), score=c("risk_score")),
             rows("mapping", account=c("account_id")), rows("lifecycle", detail=c("state"), first=c("ts"), last=c("ts")),
             rows("prediction", detail=F.concat_ws(":", "model_name", "prediction"), score=c("confidence")),
             rows("job", c("batch"), c("total_items"), F.concat_ws(":", c("status"), c("processed_items")))]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("ingest_rejects", f"""WITH {INGEST_SQL}
SELECT reject_reason, batch, count(*) AS n FROM norm WHERE reject_reason IS NOT NULL GROUP BY 1, 2""")
def ingest_rejects(spark, sf_dir):
    """Why requests are refused, by batch."""
    _, bad = I.split_batch(_landed(spark, sf_dir), "value", "type")
    return bad.groupBy("reject_reason", "batch").agg(F.count(F.lit(1)).alias("n"))
