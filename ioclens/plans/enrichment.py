"""Enrichment-based queries over the derived ``enrichment`` view."""

from __future__ import annotations

from ..operators import enrich as EN
from ..operators import graph as G
from ..sources import views
from .common import r6
from .graph import EDGES_SQL
from .ingest import FALLBACK_SQL
from .registry import query

CONTRIB_SQL = """contrib AS (
  SELECT ioc_id, enrichment_type,
    CASE WHEN enrichment_type = 'virustotal' AND list_sum(map_values(vt.last_analysis_stats)) > 0
         THEN coalesce(vt.last_analysis_stats['malicious'], 0) / list_sum(map_values(vt.last_analysis_stats)) * 0.8 ELSE 0.0 END AS detection,
    CASE WHEN enrichment_type = 'virustotal' AND coalesce(vt.reputation, 0) < 0 THEN least(abs(vt.reputation) / 100.0, 0.5) ELSE 0.0 END AS reputation,
    CASE WHEN enrichment_type = 'geolocation' AND json_extract_string(data, '$.country_code') IN ('RU', 'CN', 'IR', 'KP') THEN 0.2 ELSE 0.0 END AS geo
  FROM (SELECT *, CASE WHEN enrichment_type = 'virustotal' THEN
          json_transform(data, '{"reputation": "INTEGER", "last_analysis_stats": "MAP(VARCHAR, INTEGER)"}') END AS vt
        FROM enrichment) e)"""


@query("enrichment_payloads", """SELECT id, ioc_id, enrichment_type, data FROM enrichment""")
def enrichment_payloads(spark, sf_dir):
    """A26/XG9: enrichment payload rows routed by IOC type (ip, domain, hash)."""
    return views.enrichment(spark, sf_dir).select("id", "ioc_id", "enrichment_type", "data")


@query("enrichment_risk", f"""WITH {CONTRIB_SQL}
SELECT ioc_id, count(*) AS n_enrichments, round(sum(detection), 6) AS detection, round(sum(reputation), 6) AS reputation,
  round(sum(geo), 6) AS geo, round(least(sum(detection) + sum(reputation) + sum(geo), 1.0), 6) AS score
FROM contrib GROUP BY ioc_id""")
def enrichment_risk(spark, sf_dir):
    """Enrichment risk score per enriched IOC."""
    s = EN.enrichment_scores(views.enrichment(spark, sf_dir))
    return s.select("ioc_id", "n_enrichments", *[r6(c).alias(c) for c in ("detection", "reputation", "geo", "score")])


@query("dynamic_risk", f"""WITH {CONTRIB_SQL},
c AS (SELECT ioc_id, sum(detection) AS det, sum(reputation) AS rep FROM contrib GROUP BY 1),
j AS (SELECT i.*, least(coalesce(cast(i.risk_score AS double), 0.0) + coalesce(c.det, 0.0) + coalesce(c.rep, 0.0), 1.0) AS r4
      FROM ioc i LEFT JOIN c ON i.id = c.ioc_id)
SELECT id, type, value, cast(risk_score AS double) AS old_score, round(r4, 6) AS dynamic_score,
  cast(round(cast(round(CASE WHEN r4 < 0.1 THEN cast({FALLBACK_SQL('type', 'value')} AS double) ELSE r4 END, 6) AS decimal(12,6)), 2) AS decimal(3,2)) AS final_score
FROM j""")
def dynamic_risk(spark, sf_dir):
    """Dynamic score with text fallback, as stored."""
    d = EN.dynamic_scores(views.ioc(spark, sf_dir), views.enrichment(spark, sf_dir))
    return d.withColumn("dynamic_score", r6("dynamic_score"))


@query("risk_rescore", f"""WITH {CONTRIB_SQL},
s AS (SELECT ioc_id, least(sum(detection) + sum(reputation) + sum(geo), 1.0) AS new_score FROM contrib GROUP BY 1)
SELECT i.id, i.type, cast(i.risk_score AS double) AS old_score, round(s.new_score, 6) AS new_score,
  cast(round(cast(round(s.new_score, 6) AS decimal(12,6)), 2) AS decimal(3,2)) AS stored_score, s.new_score > cast(i.risk_score AS double) AS realert
FROM ioc i JOIN s ON i.id = s.ioc_id WHERE abs(s.new_score - cast(i.risk_score AS double)) > 0.01""")
def risk_rescore(spark, sf_dir):
    """Batch re-score of enriched IOCs with re-alert flags."""
    r = EN.rescore(views.ioc(spark, sf_dir), views.enrichment(spark, sf_dir))
    return r.select("id", "type", "old_score", r6("new_score").alias("new_score"), "stored_score", "realert")


@query("geo_map", """SELECT i.id, i.type, i.value, cast(i.risk_score AS double) AS risk_score,
  cast(json_extract(e.data, '$.lat') AS double) AS lat, cast(json_extract(e.data, '$.lon') AS double) AS lon,
  json_extract_string(e.data, '$.country') AS country, json_extract_string(e.data, '$.city') AS city
FROM enrichment e JOIN ioc i ON e.ioc_id = i.id
WHERE e.enrichment_type = 'geolocation' AND json_extract(e.data, '$.lat') IS NOT NULL AND json_extract(e.data, '$.lon') IS NOT NULL""")
def geo_map(spark, sf_dir):
    """J12/XG7/G29: geolocated IOCs for the map."""
    return EN.geo_points(views.ioc(spark, sf_dir), views.enrichment(spark, sf_dir))


@query("related_iocs", """WITH rip AS (SELECT DISTINCT ioc_id, data AS addr FROM enrichment WHERE enrichment_type = 'resolved_ip'),
c1 AS (SELECT a.ioc_id, b.ioc_id AS related_id, 0 AS pri, b.ioc_id AS ord, 'resolved_ip' AS relation
       FROM rip a JOIN rip b ON a.addr = b.addr AND a.ioc_id <> b.ioc_id),
c2 AS (SELECT x.id AS ioc_id, y.id AS related_id, 1 AS pri, y.id AS ord, 'same_source' AS relation
       FROM ioc x, LATERAL (SELECT id FROM ioc y WHERE y.source = x.source AND y.id <> x.id ORDER BY id LIMIT 5) y),
u AS (SELECT ioc_id, related_id, arg_min(relation, (pri, ord)) AS relation, min((pri, ord)) AS k FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2) t GROUP BY 1, 2)
SELECT ioc_id, related_id, relation, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY ioc_id ORDER BY k) AS rank FROM u) r WHERE rank <= 10""")
def related_iocs(spark, sf_dir):
    """Up to 10 related IOCs per IOC."""
    return EN.related_iocs(views.ioc(spark, sf_dir), views.enrichment(spark, sf_dir))


@query("shared_enrichment_edges", f"""WITH {EDGES_SQL},
m AS (SELECT DISTINCT ioc_id AS id, enrichment_type || ':' || data AS grp FROM enrichment
      WHERE enrichment_type IN ('resolved_ip', 'asn', 'country')),
h AS (SELECT grp, min(id) AS hub FROM m GROUP BY 1)
SELECT DISTINCT h.hub AS src, m.id AS dst, 'shared_enrichment' AS relationship_type, 0.7 AS confidence
FROM m JOIN h ON m.grp = h.grp WHERE m.id <> h.hub
  AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = h.hub AND e.dst = m.id)""")
def shared_enrichment_edges(spark, sf_dir):
    """Shared-enrichment edges (star form)."""
    existing = G.explicit_edges(views.relationship(spark, sf_dir), views.ioc(spark, sf_dir))
    return EN.shared_enrichment_edges(views.enrichment(spark, sf_dir), existing)

