"""Maintenance and listing queries: audit report, job lists, predictions of an
indicator, alert, account, indicator and prediction changes, feeds."""

from __future__ import annotations

import datetime as dt
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from ..functions.normalize import network_reject_reason
from ..functions.risk import fallback_score
from ..functions.timeutil import iso
from ..operators import accounts as A
from ..operators import alerts as AL
from ..operators import dashboard as D
from ..operators import ingest as I
from ..operators.upsert import new_keys
from ..session import scratch_path
from ..sources import sinks, views
from ..sources.files import read_dataset, read_feeds
from ..sources.tables import table
from . import sqlfrag as S
from .common import accepted, r6
from .dashboard import DATE_FROM, DATE_TO, _iso
from .ingest import FALLBACK_SQL, NORM
from .registry import query

NOW = dt.datetime(2024, 2, 1)
NOW_SQL = "TIMESTAMP '2024-02-01'"


def _between(c):
    return (F.col(c) >= F.lit(DATE_FROM).cast("timestamp_ntz")) & (F.col(c) <= F.lit(DATE_TO).cast("timestamp_ntz"))


@query("audit_report", f"""SELECT a.id, u.username AS "user", a.action, a.resource, a.resource_id, {_iso('a.timestamp')} AS timestamp, a.ip_address
FROM audit a LEFT JOIN users u ON a.user_id = u.id
WHERE a.timestamp >= TIMESTAMP '{DATE_FROM}' AND a.timestamp <= TIMESTAMP '{DATE_TO}'""")
def audit_report(spark, sf_dir):
    """Audit export for an inclusive date range, with the user's name
    (none for entries without a known user)."""
    from ..operators.joins import left_join_known
    u = views.users(spark, sf_dir).select(F.col("id").alias("user_id"), F.col("username").alias("user"))
    a = left_join_known(views.audit(spark, sf_dir).where(_between("timestamp")), u, "user_id")
    return a.select("id", "user", "action", "resource", "resource_id", iso("timestamp").alias("timestamp"), "ip_address")


@query("user_jobs", "SELECT * FROM jobs WHERE user_id = (SELECT max(user_id) FROM jobs) ORDER BY id LIMIT 5 OFFSET 2")
def user_jobs(spark, sf_dir):
    """A page of the jobs of one user (the one of largest id)."""
    j = views.jobs(spark, sf_dir)
    who = j.select(F.max("user_id")).scalar()
    return D.page(j.where(F.col("user_id") == who), [F.col("id")], 2, 5)


@query("ioc_predictions", """SELECT id, ioc_id, model_name, prediction, round(confidence, 6) AS confidence FROM prediction
WHERE ioc_id = (SELECT max(ioc_id) FROM prediction)""")
def ioc_predictions(spark, sf_dir):
    """F8: all predictions of one indicator (that of largest id)."""
    p = views.prediction(spark, sf_dir)
    which = p.select(F.max("ioc_id")).scalar()
    return p.where(F.col("ioc_id") == which).withColumn("confidence", r6("confidence"))


@query("network_input_check", f"""WITH n AS (SELECT doc_id, {S.strip("CASE doc_id % 10 WHEN 0 THEN ' --- !!' WHEN 1 THEN ' ab ' WHEN 2 THEN NULL ELSE text END")} AS v FROM documents)
SELECT doc_id, CASE WHEN length(coalesce(v, '')) < 3 THEN 'network_too_short' WHEN NOT regexp_matches(v, '[a-zA-Z0-9]') THEN 'network_no_alphanumeric' END AS reject_reason FROM n""")
def network_input_check(spark, sf_dir):
    """Network descriptions by the strict rule; every tenth document
    each stands for one without letters, a short one and a missing one."""
    k = F.col("doc_id") % 10
    v = F.when(k == 0, " --- !!").when(k == 1, " ab ").when(k != 2, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", network_reject_reason(v).alias("reject_reason"))


def _updates(spark, sf_dir):
    a = views.alert(spark, sf_dir)
    return a.where(F.col("id") % 6 < 2).select("id", (F.col("id") % 6 == 0).alias("acknowledged"), (F.col("id") % 9).alias("user_id"))


@query("alert_acknowledge", f"""SELECT id, ioc_id, severity, CASE id % 6 WHEN 0 THEN true WHEN 1 THEN false ELSE acknowledged END AS acknowledged,
  CASE WHEN id % 6 = 0 THEN id % 9 END AS acknowledged_by, CASE WHEN id % 6 = 0 THEN {NOW_SQL} END AS acknowledged_at FROM alert""")
def alert_acknowledge(spark, sf_dir):
    """A batch that acknowledges a sixth of all alerts and takes it back
    from another sixth."""
    out, _ = AL.acknowledge(views.alert(spark, sf_dir), _updates(spark, sf_dir), NOW)
    return out.select("id", "ioc_id", "severity", "acknowledged", "acknowledged_by", F.col("acknowledged_at").cast("timestamp_ntz").alias("acknowledged_at"))


@query("alert_log", "SELECT id AS alert_id, CASE id % 6 WHEN 0 THEN 'acknowledged' ELSE 'unacknowledged' END AS action, id % 9 AS user_id FROM alert WHERE id % 6 < 2")
def alert_log(spark, sf_dir):
    """The log rows of that batch."""
    _, logs = AL.acknowledge(views.alert(spark, sf_dir), _updates(spark, sf_dir), NOW)
    return logs.select("alert_id", "action", "user_id")


@query("alert_create", """SELECT o_orderkey AS id, o_orderkey % (2 * (SELECT count(*) FROM events)) AS ioc_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS severity, false AS acknowledged
FROM orders WHERE o_orderkey % (2 * (SELECT count(*) FROM events)) IN (SELECT id FROM ioc)""")
def alert_create(spark, sf_dir):
    """Alerts asked for, many of unknown indicators; a missing or
    empty severity is 'medium'."""
    k, n = F.col("o_orderkey"), table(spark, sf_dir, "events").select(F.count(F.lit(1))).scalar()
    asked = table(spark, sf_dir, "orders").select(k.alias("id"), (k % (n * 2)).alias("ioc_id"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "").alias("severity"))
    out, _ = AL.create_alerts(asked, views.ioc(spark, sf_dir), NOW)
    return out.select("id", "ioc_id", "severity", "acknowledged")


def _asked(spark, sf_dir, key):
    m = views.mapping(spark, sf_dir).where(F.col(key).isNotNull())
    return m.select(F.when(F.col("id") % 4 == 0, F.col("account_id") + 1).otherwise(F.col("account_id")).alias("account_id"), key).distinct()


_ASKED_SQL = """SELECT DISTINCT CASE WHEN id % 4 = 0 THEN account_id + 1 ELSE account_id END AS account_id, {0} FROM mapping WHERE {0} IS NOT NULL"""
_ASSIGN_SQL = "SELECT * FROM (" + _ASKED_SQL + ") q WHERE NOT EXISTS (SELECT 1 FROM mapping m WHERE m.account_id = q.account_id AND m.{0} = q.{0})"


@query("assign_inputs", _ASSIGN_SQL.format("threat_input_id"))
def assign_inputs(spark, sf_dir):
    """Threat inputs assigned to accounts where not yet assigned."""
    return A.assign(views.mapping(spark, sf_dir), _asked(spark, sf_dir, "threat_input_id"), "threat_input_id")


@query("assign_iocs", _ASSIGN_SQL.format("ioc_id"))
def assign_iocs(spark, sf_dir):
    """Indicators assigned to accounts where not yet assigned."""
    return A.assign(views.mapping(spark, sf_dir), _asked(spark, sf_dir, "ioc_id"), "ioc_id")


@query("unassign_iocs", """SELECT * FROM mapping m WHERE NOT EXISTS (SELECT 1 FROM (
  """ + _ASKED_SQL.format("ioc_id") + """) q WHERE q.account_id = m.account_id AND q.ioc_id = m.ioc_id)""")
def unassign_iocs(spark, sf_dir):
    """The mapping without the asked pairs; mappings of inputs stay."""
    m = views.mapping(spark, sf_dir)
    return A.unassign(m, _asked(spark, sf_dir, "ioc_id"), "ioc_id").select(*m.columns)


@query("account_iocs_scoped", """SELECT id, type, value FROM ioc
WHERE id IN (SELECT ioc_id FROM mapping WHERE account_id = (SELECT max(account_id) FROM mapping WHERE ioc_id IS NOT NULL))""")
def account_iocs_scoped(spark, sf_dir):
    """The indicators in one account's scope (that of largest id)."""
    m = views.mapping(spark, sf_dir)
    who = m.where("ioc_id IS NOT NULL").select(F.max("account_id")).scalar()
    return A.scoped(views.ioc(spark, sf_dir), m, who).select("id", "type", "value")


@query("default_account", """SELECT id, name FROM account UNION ALL
SELECT (SELECT max(id) FROM account) + 1, 'Default' WHERE NOT EXISTS (SELECT 1 FROM account WHERE name = 'Default')""")
def default_account(spark, sf_dir):
    """The accounts with a default one."""
    return A.default_account(views.account(spark, sf_dir))


def _wanted(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    kind = F.when(k % 5 == 0, "ip").when(k % 5 == 1, "domain").when(k % 5 == 2, "url").when(k % 5 == 3, "hash").otherwise("network")
    return c.select(k.alias("id"), kind.alias("type"), F.concat(F.lit("v"), F.when(k % 2 == 0, F.floor(k / 20) * 10 + k % 5).otherwise(k % 5000).cast("string")).alias("value"))


_WANTED_SQL = """w AS (SELECT type, value, min(id) AS id FROM (SELECT c_custkey AS id,
    CASE c_custkey % 5 WHEN 0 THEN 'ip' WHEN 1 THEN 'domain' WHEN 2 THEN 'url' WHEN 3 THEN 'hash' ELSE 'network' END AS type,
    concat('v', CASE WHEN c_custkey % 2 = 0 THEN (c_custkey // 20) * 10 + c_custkey % 5 ELSE c_custkey % 5000 END) AS value FROM customer) x GROUP BY type, value)"""


@query("ioc_create", f"""WITH {_WANTED_SQL}
SELECT id, type, value, CASE WHEN EXISTS (SELECT 1 FROM ioc i WHERE i.type = w.type AND i.value = w.value) THEN 'duplicate' END AS reject_reason FROM w""")
def ioc_create(spark, sf_dir):
    """A create batch with repeats (the smallest id stays) and keys that
    exist: created rows, and the refused with their reason."""
    made, refused = I.create_iocs(_wanted(spark, sf_dir), views.ioc(spark, sf_dir))
    cols = ["id", "type", "value", "reject_reason"]
    return made.withColumn("reject_reason", F.lit(None).cast("string")).select(*cols).unionByName(refused.select(*cols))


@query("prediction_delete", """SELECT id, ioc_id, model_name FROM prediction WHERE ioc_id NOT IN (SELECT id FROM ioc WHERE type = 'hash')""")
def prediction_delete(spark, sf_dir):
    """The predictions left when those of all hash indicators go."""
    ids = views.ioc(spark, sf_dir).where("type = 'hash'").select(F.col("id").alias("ioc_id"))
    left, _ = I.delete_predictions(views.prediction(spark, sf_dir), ids, by="ioc_id")
    return left.select("id", "ioc_id", "model_name")


@query("prediction_delete_count", "SELECT count(*) AS deleted FROM prediction WHERE ioc_id IN (SELECT id FROM ioc WHERE type = 'hash')")
def prediction_delete_count(spark, sf_dir):
    """How many that are."""
    ids = views.ioc(spark, sf_dir).where("type = 'hash'").select(F.col("id").alias("ioc_id"))
    return I.delete_predictions(views.prediction(spark, sf_dir), ids, by="ioc_id")[1]


# ------------------------------------------------------------------ feeds
def _land(df, name, head, tail):
    """Each partition's ``json`` rows as one JSON document, streamed out."""
    spark = df.sparkSession
    path = scratch_path(spark, name)

    def write(parts):
        first = True
        yield pd.DataFrame({"value": [head]})
        for part in parts:
            if len(part):
                lines = [("" if first and k == 0 else ",") + j for k, j in enumerate(part["json"])]
                first = False
                yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": [tail]})
    df.select("json").mapInPandas(write, "value string").write.text(path)
    return path


_FEED_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"
_FEED_SQL = f"""f AS (
  SELECT 1 AS feed, CASE origin WHEN 'page_url' THEN 'url' WHEN 'page_host' THEN 'domain' ELSE 'hash' END AS hint, value,
         TIMESTAMP '2024-01-01' + to_days(cast(ref_id % 20 AS integer)) AS first_seen, TIMESTAMP '2024-01-21' + to_days(cast(ref_id % 9 AS integer)) AS last_seen
  FROM raw_inputs WHERE origin <> 'doc_quad'
  UNION ALL SELECT 2, 'ip', value, NULL, TIMESTAMP '2024-01-25' + to_days(cast(ref_id % 4 AS integer)) FROM raw_inputs WHERE origin = 'doc_quad'
  UNION ALL SELECT 2, 'ip', '2001:db8::' || printf('%x', page_id % 50 + 1), NULL, TIMESTAMP '2024-01-25' FROM pages
)"""


@query("feed_ingest", f"""WITH {_FEED_SQL},
norm AS ({S.normalized_raw_inputs("f", "feed, first_seen, last_seen", "hint")}),
b AS (SELECT type, value, arg_min(feed, (feed, coalesce(first_seen, TIMESTAMP '2000-01-01'), last_seen)) AS feed,
        arg_min(coalesce(first_seen, TIMESTAMP '2000-01-01'), (feed, coalesce(first_seen, TIMESTAMP '2000-01-01'), last_seen)) AS fs,
        arg_min(last_seen, (feed, coalesce(first_seen, TIMESTAMP '2000-01-01'), last_seen)) AS last_seen
      FROM norm WHERE reject_reason IS NULL GROUP BY type, value)
SELECT type, value, CASE feed WHEN 1 THEN 'AlienVault OTX' ELSE 'AbuseIPDB' END AS source,
  CASE WHEN feed = 1 THEN fs END AS first_seen, last_seen, {FALLBACK_SQL('type', 'value')} AS risk_score
FROM b WHERE NOT EXISTS (SELECT 1 FROM ioc i WHERE i.type = b.type AND i.value = b.value)
""")
def feed_ingest(spark, sf_dir):
    """Two feeds landed as large JSON documents, read
    in parallel, normalised, the first of each indicator kept (pulses first,
    then the earliest), those already known left out."""
    raw = views.raw_inputs(spark, sf_dir)
    day = lambda d, n: F.date_format(F.date_add(F.lit(d).cast("date"), (F.col("ref_id") % n).cast("int")), _FEED_TIME)
    kind = F.when(F.col("origin") == "page_url", "URL").when(F.col("origin") == "page_host", "hostname").otherwise("FileHash-MD5")
    pulse = F.struct(day("2024-01-01", 20).alias("created"), day("2024-01-21", 9).alias("modified"), F.lit('a "quoted" name {[').alias("name"),
                     F.array(F.struct(kind.alias("type"), F.col("value").alias("indicator")), F.struct(F.lit(None).cast("string").alias("type"), F.lit("no type").alias("indicator"))).alias("indicators"))
    pulses = _land(raw.where("origin <> 'doc_quad'").select(F.to_json(pulse).alias("json")), "pulses", '{"count": 2, "results": [', "]}")
    v6 = table(spark, sf_dir, "pages").select(F.concat(F.lit("2001:0DB8::"), F.hex(F.col("page_id") % 50 + 1)).alias("value"), F.lit(0).alias("ref_id"))
    listed = raw.where("origin = 'doc_quad'").select("value", "ref_id").unionByName(v6)
    entry = F.struct(F.col("value").alias("ipAddress"), day("2024-01-25", 4).alias("lastReportedAt"))
    blacklist = _land(listed.select(F.to_json(entry).alias("json")), "blacklist", '{"meta": {}, "data": [', "]}")
    feeds = read_feeds(spark, pulses + "/*.txt", blacklist + "/*.txt")
    good, _ = I.split_batch(feeds, "value", "type")
    rank = F.when(F.col("source") == "AlienVault OTX", 1).otherwise(2)
    first = F.min(F.struct(rank.alias("rank"), "first_seen", "last_seen", "source"))
    found = good.groupBy("type", "value").agg(first.alias("m"))
    new = new_keys(found, views.ioc(spark, sf_dir), ["type", "value"])
    return new.select("type", "value", "m.source", F.col("m.first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("m.last_seen").cast("timestamp_ntz").alias("last_seen"),
                      fallback_score("type", "value").alias("risk_score"))


# --------------------------------------------------------------- datasets
_LABELLED = {"domain": "length(value) % 2", "ip": "length(value) % 2", "url": "CASE WHEN length(value) % 3 = 0 THEN 1 ELSE 0 END",
             "hash": "CASE WHEN value < '8' THEN 1 ELSE 0 END"}


@query("dataset_class_counts", f"WITH {NORM},\n" + "d AS (" + "\nUNION ALL ".join(
    f"SELECT '{k}' AS kind, {e} AS is_malicious FROM (SELECT DISTINCT value FROM norm WHERE type = '{k}' AND reject_reason IS NULL)" for k, e in _LABELLED.items())
    + "\nUNION ALL SELECT 'network', is_anomalous FROM flow)\nSELECT kind, cast(is_malicious AS integer) AS is_malicious, count(*) AS count FROM d GROUP BY 1, 2")
def dataset_class_counts(spark, sf_dir):
    """The five labelled datasets as CSV, their columns in
    another order and among others, scanned, checked, deduplicated on their
    keys and counted by class."""
    parts = []
    norm = accepted(spark, sf_dir).select("type", "value")
    for kind, label in _LABELLED.items():
        rows = norm.where(F.col("type") == kind)
        cols = [F.lit("extra").alias("note"), F.expr(label).cast("int").alias("status" if kind == "url" else "is_malicious"), F.col("value").alias(kind)]
        cols += [F.lit("seen").alias("source"), F.lit(0.5).alias("risk_score")] if kind in ("domain", "ip") else []
        parts.append((kind, rows.select(*cols)))
    parts.append(("network", views.flow(spark, sf_dir).drop("l_orderkey", "l_linenumber")))
    out = []
    for kind, rows in parts:
        path = scratch_path(spark, f"dataset-{kind}")
        sinks.write_csv(rows, path)
        own = read_dataset(spark, kind, path)
        out.append(own.groupBy("is_malicious").agg(F.count(F.lit(1)).alias("count")).select(F.lit(kind).alias("kind"), "is_malicious", "count"))
    return reduce(lambda a, b: a.unionByName(b), out)
