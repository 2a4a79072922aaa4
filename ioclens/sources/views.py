"""Engine tables derived from the driver tables.

Each builder returns the engine-shaped table (``ioc`` sightings, ``alert``,
``lifecycle``, ``account``, ``mapping``, ``relationship``, ``flow``,
``prediction``, ``raw_inputs``) as a lazy DataFrame.  ``SQL`` holds the same
definitions as ANSI SQL for the DuckDB oracle; ``with_views`` prefixes an
oracle query with the CTEs it references.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Extraction patterns for raw inputs found in free text.
QUAD_RE = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
HEX_RE = r"[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32}"
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)"


def ioc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings log: one indicator observation per event."""
    return ioc_from_events(table(spark, sf_dir, "events"))


def ioc_from_events(e: DataFrame) -> DataFrame:
    """The sightings projection of an events DataFrame (batch or stream)."""
    u = F.col("user_id")
    return e.select(
        F.col("event_id").alias("id"),
        F.when(u % 5 == 0, "ip").when(u % 5 == 1, "domain").when(u % 5 == 2, "url")
         .when(u % 5 == 3, "hash").otherwise("network").alias("type"),
        F.concat(F.lit("v"), u.cast("string")).alias("value"),
        F.concat(F.lit("src"), (u % 7).cast("string")).alias("source"),
        F.expr("cast(((event_id * 7919) % 101) / 100.0 AS decimal(3,2))").alias("risk_score"),
        F.col("ts").alias("created_at"),
    )


def alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_from_events(table(spark, sf_dir, "events"))


def alert_from_events(e: DataFrame) -> DataFrame:
    e = e.where(F.col("event_type") == "error")
    i = F.col("event_id")
    return e.select(
        i.alias("id"), i.alias("ioc_id"),
        F.when(i % 4 == 0, "low").when(i % 4 == 1, "medium").when(i % 4 == 2, "high")
         .otherwise("critical").alias("severity"),
        (i % 3 == 0).alias("acknowledged"),
        F.col("ts").alias("created_at"),
    )


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle_from_events(table(spark, sf_dir, "events"))


def lifecycle_from_events(e: DataFrame) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        i.alias("id"), u.alias("threat_input_id"),
        F.when(i % 4 == 0, F.lit(None).cast("bigint")).otherwise(u * 10 + i % 3).alias("ioc_id"),
        F.when(i % 5 == 0, "new").when(i % 5 == 1, "under_analysis")
         .when(i % 5 == 2, "confirmed_malicious").when(i % 5 == 3, "false_positive")
         .otherwise("mitigated").alias("state"),
        F.col("ts"),
    )


def account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def _n_events(spark: SparkSession, sf_dir: str):
    # Scalar subquery: one aggregate row, planned by Catalyst, never collected.
    return table(spark, sf_dir, "events").select(F.count(F.lit(1))).scalar()


def _last_event(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "events").select(F.max("ts")).scalar()


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    n = _n_events(spark, sf_dir)
    return o.select(
        k.alias("id"), F.col("o_custkey").alias("account_id"),
        F.when(k % 3 != 0, k % n).alias("ioc_id"),
        F.when(k % 3 == 0, k).alias("threat_input_id"),
        F.col("o_orderdate").alias("assigned_at"),
    )


def relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored relations, written in the 45 days before the last event."""
    li = table(spark, sf_dir, "lineitem")
    n, last = _n_events(spark, sf_dir), _last_event(spark, sf_dir)
    days = ((F.col("l_partkey") * 13 + F.col("l_suppkey") * 7) % 45).cast("int")
    return (li.select(F.col("l_partkey").alias("ioc1_id"),
                      ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % n).alias("ioc2_id"),
                      F.col("l_discount"), days.alias("days"))
            .groupBy("ioc1_id", "ioc2_id")
            .agg(F.max("l_discount").alias("confidence"), F.min("days").alias("days"))
            .select("ioc1_id", "ioc2_id", F.lit("related").alias("relationship_type"), "confidence",
                    (last - F.make_dt_interval("days")).alias("created_at")))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.floor("l_quantity").cast("bigint").alias("packet_count"),
        F.floor("l_extendedprice").cast("bigint").alias("bytes_transferred"),
        (F.col("l_tax") * 100).alias("duration_seconds"),
        F.col("l_linenumber").alias("connection_count"),
        (F.floor(F.col("l_discount") * 100 + 0.5).cast("bigint") % 3).alias("failed_connections"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_anomalous"),
    )


def prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three model verdicts per labelled document.  The three model ids are
    generated per row with ``explode`` (a fixed fan-out of 3), not a join."""
    lb = table(spark, sf_dir, "labels")
    m = F.col("m")
    return (lb.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("m"))
            .select((F.col("doc_id") * 3 + m).alias("id"),
                    F.col("doc_id").alias("ioc_id"),
                    F.concat(F.lit("model_"), m.cast("string")).alias("model_name"),
                    F.when((F.col("toxic") + F.col("quality") + m) % 2 == 1, "malicious")
                     .otherwise("benign").alias("prediction"),
                    (0.5 + ((F.col("doc_id") * 31 + m * 17) % 50) / 100.0).cast("double").alias("confidence")))


def raw_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw indicator strings: page URLs, their hosts, and dotted quads and
    hex digests found anywhere in document texts (whole texts).  Each table
    is scanned once: every row yields an array of (origin, pos, value)
    structs that ``inline`` expands."""
    pages = table(spark, sf_dir, "pages")
    docs = table(spark, sf_dir, "documents")

    def item(origin, pos, value):
        return F.struct(F.lit(origin).alias("origin"), pos.cast("int").alias("pos"), value.alias("value"))

    host = F.lower(F.regexp_extract("url", HOST_RE, 1))
    page_items = F.array(item("page_url", F.lit(0), F.col("url")), item("page_host", F.lit(0), host))
    found = lambda origin, pattern: F.transform(
        F.regexp_extract_all("text", F.lit(pattern), 0), lambda x, i: item(origin, i, x))
    doc_items = F.concat(found("doc_quad", QUAD_RE), found("doc_hash", HEX_RE))
    p = pages.select(F.col("page_id").alias("ref_id"), F.inline(page_items))
    d = docs.select(F.col("doc_id").alias("ref_id"), F.inline(doc_items))
    return p.unionByName(d).select("origin", "ref_id", "pos", "value")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw inputs as users send them, in two batches: bracketed dots and
    blanks, empty and malformed values, IPv6 and unknown types given, some
    with an account; a third of the first batch comes again in the second."""
    r = raw_inputs(spark, sf_dir)
    k = (F.col("ref_id") * 31 + F.col("pos")) % 20
    page = F.col("origin").startswith("page")
    value = F.when(k == 0, F.concat(F.lit(" "), F.replace("value", F.lit("."), F.lit("[.]")), F.lit("\t"))).when(k == 1, F.lit("")) \
        .when(k == 2, F.lit("not an indicator!")).when(k == 3, F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("ref_id") % 65535 + 1)))).otherwise(F.col("value"))
    again = F.when(page & (F.col("ref_id") % 3 == 0), F.array(F.lit(1), F.lit(2))).when(page, F.array(F.lit(1))).otherwise(F.array(F.lit(2)))
    rows = r.select(F.explode(again).alias("batch"), "origin", "ref_id", "pos", F.when(k == 3, "ip").when(k == 4, "email").alias("type"), value.alias("value"),
                    F.when(F.col("ref_id") % 5 == 0, F.col("ref_id") % 7 + 1).alias("account_id"))
    return rows.select(F.concat_ws(":", "origin", "ref_id", "pos", "batch").alias("input_id"), "batch", "type", "value", "account_id")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("username"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit log: an entry per event, some by users that are gone."""
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 11 != 0, u).alias("user_id"), F.col("event_type").alias("action"),
        F.when(u % 2 == 0, "ioc").otherwise("alert").alias("resource"), (F.col("event_id") % 97).alias("resource_id"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("10.1."), (u % 5).cast("string"), F.lit("."), (F.col("event_id") % 250).cast("string")).alias("ip_address"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk ingestion jobs: one per order, its customer the user."""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 2 == 0, "csv").otherwise("json").alias("file_type"),
        F.when(s == "F", "completed").when(s == "O", "pending").otherwise("processing").alias("status"),
        F.col("o_orderdate").alias("created_at"))


# Country codes assigned to derived geolocation payloads (fixture rule).
GEO_CODES = ["US", "DE", "RU", "CN", "FR", "IR", "BR", "KP", "JP", "GB"]


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed enrichment payloads derived from events (``props`` JSON):
    reputation stats for ip/domain/hash sightings, geolocation for ip,
    resolved address for domain.  ``data`` is JSON text
    (a plain string for resolved_ip)."""
    return enrichment_from_events(table(spark, sf_dir, "events"))


def enrichment_from_events(e: DataFrame) -> DataFrame:
    """The enrichment projection of an events DataFrame (batch or stream):
    each event yields its payload rows in one pass (an array of structs,
    NULLs filtered, expanded with ``inline``)."""
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.col("user_id") % 5
    s = lambda c: c.cast("string")

    def item(offset, kind, data):
        return F.struct((F.col("event_id") * 3 + offset).alias("id"), F.col("event_id").alias("ioc_id"),
                        F.lit(kind).alias("enrichment_type"), data.alias("data"), F.col("ts").alias("created_at"))
    vt = F.concat(F.lit('{"reputation": '), s(k - 50), F.lit(', "last_analysis_stats": {"malicious": '), s(k % 7),
                  F.lit(', "suspicious": '), s(k % 3), F.lit(', "harmless": '), s(60 - k % 7),
                  F.lit(', "undetected": '), s(k % 11), F.lit("}}"))
    codes = F.array(*[F.lit(c) for c in GEO_CODES])
    cc = F.element_at(codes, ((F.col("user_id") + k) % len(GEO_CODES) + 1).cast("int"))
    lat = F.when(k % 10 == 0, F.lit("")).otherwise(F.concat(F.lit(', "lat": '), s((k * 7) % 180 - 90)))
    geo = F.concat(F.lit('{"country_code": "'), cc, F.lit('", "country": "'), cc, F.lit('", "city": "c'), s(k % 13), F.lit('"'),
                   lat, F.lit(', "lon": '), s((k * 13) % 360 - 180), F.lit("}"))
    rip = F.concat(F.lit("10.0."), s(k % 4), F.lit("."), s(F.col("user_id") % 3))
    items = F.array(F.when(t.isin(0, 1, 3), item(0, "virustotal", vt)),
                    F.when(t == 0, item(1, "geolocation", geo)),
                    F.when(t == 1, item(2, "resolved_ip", rip)))
    return e.select(F.inline(F.filter(items, lambda x: x.isNotNull())))


BUILDERS = {
    "ioc": ioc, "alert": alert, "lifecycle": lifecycle, "account": account, "mapping": mapping,
    "relationship": relationship, "flow": flow, "prediction": prediction, "raw_inputs": raw_inputs,
    "enrichment": enrichment, "requests": requests, "users": users, "audit": audit, "jobs": jobs,
}

# ------------------------------------------------------------------ oracle SQL
SQL = {
    "ioc": """SELECT event_id AS id,
       CASE user_id % 5 WHEN 0 THEN 'ip' WHEN 1 THEN 'domain' WHEN 2 THEN 'url'
                        WHEN 3 THEN 'hash' ELSE 'network' END AS type,
       concat('v', cast(user_id AS varchar)) AS value,
       concat('src', cast(user_id % 7 AS varchar)) AS source,
       cast(((event_id * 7919) % 101) / 100.0 AS decimal(3,2)) AS risk_score,
       ts AS created_at
FROM events""",
    "alert": """SELECT event_id AS id, event_id AS ioc_id,
       CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium'
                         WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
       event_id % 3 = 0 AS acknowledged, ts AS created_at
FROM events WHERE event_type = 'error'""",
    "lifecycle": """SELECT event_id AS id, user_id AS threat_input_id,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id * 10 + event_id % 3 END AS ioc_id,
       CASE event_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'under_analysis'
            WHEN 2 THEN 'confirmed_malicious' WHEN 3 THEN 'false_positive'
            ELSE 'mitigated' END AS state, ts
FROM events""",
    "account": "SELECT c_custkey AS id, c_name AS name FROM customer",
    "mapping": """SELECT o_orderkey AS id, o_custkey AS account_id,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % (SELECT count(*) FROM events) END AS ioc_id,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS threat_input_id,
       o_orderdate AS assigned_at FROM orders""",
    "relationship": """SELECT l_partkey AS ioc1_id, (l_partkey * 31 + l_suppkey * 17) % (SELECT count(*) FROM events) AS ioc2_id,
       'related' AS relationship_type, max(l_discount) AS confidence,
       (SELECT max(ts) FROM events) - to_days(cast(min((l_partkey * 13 + l_suppkey * 7) % 45) AS integer)) AS created_at
FROM lineitem GROUP BY 1, 2""",
    "flow": """SELECT l_orderkey, l_linenumber, cast(floor(l_quantity) AS bigint) AS packet_count,
       cast(floor(l_extendedprice) AS bigint) AS bytes_transferred, l_tax * 100 AS duration_seconds,
       l_linenumber AS connection_count, cast(floor(l_discount * 100 + 0.5) AS bigint) % 3 AS failed_connections,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_anomalous FROM lineitem""",
    "prediction": """SELECT doc_id * 3 + m AS id, doc_id AS ioc_id, concat('model_', cast(m AS varchar)) AS model_name,
       CASE WHEN (toxic + quality + m) % 2 = 1 THEN 'malicious' ELSE 'benign' END AS prediction,
       cast(0.5 + ((doc_id * 31 + m * 17) % 50) / 100.0 AS double) AS confidence
FROM labels CROSS JOIN (SELECT 0 AS m UNION ALL SELECT 1 UNION ALL SELECT 2) AS models""",
    "raw_inputs": f"""SELECT 'page_url' AS origin, page_id AS ref_id, 0 AS pos, url AS value FROM pages
UNION ALL
SELECT 'page_host', page_id, 0, lower(regexp_extract(url, '{HOST_RE}', 1)) FROM pages
UNION ALL
SELECT 'doc_quad', doc_id, cast(generate_subscripts(m, 1) - 1 AS integer), unnest(m)
FROM (SELECT doc_id, regexp_extract_all(text, '{QUAD_RE}') AS m FROM documents) AS q
UNION ALL
SELECT 'doc_hash', doc_id, cast(generate_subscripts(m, 1) - 1 AS integer), unnest(m)
FROM (SELECT doc_id, regexp_extract_all(text, '{HEX_RE}') AS m FROM documents) AS h""",
    "users": "SELECT s_suppkey AS id, s_name AS username FROM supplier",
    "audit": """SELECT event_id AS id, CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id, event_type AS action,
       CASE WHEN user_id % 2 = 0 THEN 'ioc' ELSE 'alert' END AS resource, event_id % 97 AS resource_id, ts AS timestamp,
       concat('10.1.', user_id % 5, '.', event_id % 250) AS ip_address FROM events""",
    "jobs": """SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'csv' ELSE 'json' END AS file_type,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status, o_orderdate AS created_at FROM orders""",
    "requests": """SELECT concat_ws(':', origin, ref_id, pos, batch) AS input_id, batch,
       CASE k WHEN 3 THEN 'ip' WHEN 4 THEN 'email' END AS hint,
       CASE k WHEN 0 THEN ' ' || replace(value, '.', '[.]') || chr(9) WHEN 1 THEN '' WHEN 2 THEN 'not an indicator!'
              WHEN 3 THEN '2001:db8::' || printf('%x', ref_id % 65535 + 1) ELSE value END AS value,
       CASE WHEN ref_id % 5 = 0 THEN ref_id % 7 + 1 END AS account_id
FROM (SELECT *, (ref_id * 31 + pos) % 20 AS k, unnest(CASE WHEN origin NOT LIKE 'page%' THEN [2] WHEN ref_id % 3 = 0 THEN [1, 2] ELSE [1] END) AS batch FROM raw_inputs) x""",
    "enrichment": """SELECT event_id * 3 AS id, event_id AS ioc_id, 'virustotal' AS enrichment_type,
  '{"reputation": ' || cast(k - 50 AS varchar) || ', "last_analysis_stats": {"malicious": ' || cast(k % 7 AS varchar)
  || ', "suspicious": ' || cast(k % 3 AS varchar) || ', "harmless": ' || cast(60 - k % 7 AS varchar)
  || ', "undetected": ' || cast(k % 11 AS varchar) || '}}' AS data, ts AS created_at
FROM (SELECT *, cast(json_extract_string(props, '$.k') AS integer) AS k FROM events) e WHERE user_id % 5 IN (0, 1, 3)
UNION ALL
SELECT event_id * 3 + 1, event_id, 'geolocation',
  '{"country_code": "' || cc || '", "country": "' || cc || '", "city": "c' || cast(k % 13 AS varchar) || '"'
  || CASE WHEN k % 10 = 0 THEN '' ELSE ', "lat": ' || cast((k * 7) % 180 - 90 AS varchar) END
  || ', "lon": ' || cast((k * 13) % 360 - 180 AS varchar) || '}', ts
FROM (SELECT *, cast(json_extract_string(props, '$.k') AS integer) AS k,
        ['US', 'DE', 'RU', 'CN', 'FR', 'IR', 'BR', 'KP', 'JP', 'GB'][(user_id + cast(json_extract_string(props, '$.k') AS integer)) % 10 + 1] AS cc
      FROM events) e WHERE user_id % 5 = 0
UNION ALL
SELECT event_id * 3 + 2, event_id, 'resolved_ip', '10.0.' || cast(k % 4 AS varchar) || '.' || cast(user_id % 3 AS varchar), ts
FROM (SELECT *, cast(json_extract_string(props, '$.k') AS integer) AS k FROM events) e WHERE user_id % 5 = 1""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every derived view it mentions.  A
    query that starts with its own ``WITH`` keeps its CTEs after the views."""
    body = sql.strip()
    names = [n for n in SQL if re.search(rf"\b{n}\b", body)]
    if "requests" in names and "raw_inputs" not in names:  # a view over another, which goes first
        names.insert(0, "raw_inputs")
    ctes = [f"{n} AS (\n{SQL[n]}\n)" for n in names]
    if not ctes:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[14:].lstrip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
