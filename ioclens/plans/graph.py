"""Graph queries: explicit edges, implicit star edges, components, profiles,
members and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import LOOK_BACK_DAYS
from ..operators import graph as G
from ..session import small_tasks
from ..sources import views
from .common import r6
from .registry import query

EDGES_SQL = """edges AS (
  SELECT src, dst, arg_max(relationship_type, (created_at, ioc1_id)) AS relationship_type, arg_max(confidence, (created_at, ioc1_id)) AS confidence
  FROM (SELECT least(ioc1_id, ioc2_id) AS src, greatest(ioc1_id, ioc2_id) AS dst, ioc1_id, relationship_type, confidence, created_at
        FROM relationship) r
  WHERE src <> dst AND src IN (SELECT id FROM ioc) AND dst IN (SELECT id FROM ioc)
  GROUP BY src, dst)"""


def comp_sql(days: float) -> str:
    """Components of the graph of the last ``days``: each source and payload
    is a hub of its own here, where Spark takes a group's smallest member."""
    cut = f"(SELECT max(created_at) FROM ioc) - to_seconds({days * 86400:.6f})"
    return f"""node AS (SELECT * FROM ioc WHERE created_at >= {cut}),
pairs AS (SELECT cast(ioc1_id AS varchar) AS a, cast(ioc2_id AS varchar) AS b FROM relationship
          WHERE created_at >= {cut} AND ioc1_id <> ioc2_id AND ioc1_id IN (SELECT id FROM node) AND ioc2_id IN (SELECT id FROM node)
  UNION SELECT cast(id AS varchar), 's' || source FROM node WHERE source <> ''
  UNION SELECT cast(ioc_id AS varchar), 'e' || enrichment_type || ':' || data FROM enrichment
        WHERE enrichment_type IN ('resolved_ip', 'asn', 'country') AND ioc_id IN (SELECT id FROM node)),
adj AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
start AS (SELECT u, coalesce(try_cast(u AS bigint), 9223372036854775807) AS c FROM (SELECT DISTINCT u FROM adj)),
hub(u, component) USING KEY (u) AS (SELECT u, c FROM start
  UNION SELECT a.u, min(h.component) FROM hub h JOIN adj a ON a.v = h.u JOIN recurring.hub r ON r.u = a.u
        WHERE h.component < r.component GROUP BY a.u),
members AS (SELECT cast(u AS bigint) AS id, component FROM hub WHERE try_cast(u AS bigint) IS NOT NULL),
comp AS (SELECT * FROM members WHERE component IN (SELECT component FROM members GROUP BY 1 HAVING count(*) > 1))"""


#: The reference's look-back, and a short one.
RECENT_DAYS = 2 / 24


def _nodes(spark, sf_dir):
    return views.ioc(spark, sf_dir)


def _explicit(spark, sf_dir):
    return G.explicit_edges(views.relationship(spark, sf_dir), _nodes(spark, sf_dir))


def _components(spark, sf_dir, days=LOOK_BACK_DAYS):
    """Component labels of the graph of the look-back (explicit, same-source
    and shared-enrichment edges), computed once per dataset."""
    from ..operators.models import materialized

    def build():
        nodes = _nodes(spark, sf_dir)
        as_of = nodes.select(F.max("created_at")).scalar()
        # edges: a few a node, from its source, its payloads and its relations
        with small_tasks(spark, 4 * nodes.count()):
            return G.connected_components(G.dated_graph(nodes, views.relationship(spark, sf_dir), views.enrichment(spark, sf_dir), as_of, days)[1])
    return materialized(spark, (sf_dir, "components", days), build)


@query("graph_edges", f"WITH {EDGES_SQL} SELECT src, dst, relationship_type, round(confidence, 6) AS confidence FROM edges")
def graph_edges(spark, sf_dir):
    """Explicit edges, canonical, both ends known, one per pair."""
    return _explicit(spark, sf_dir).withColumn("confidence", r6("confidence"))


PROFILE_SQL = """
SELECT c.component AS component_id, count(*) AS size, string_agg(DISTINCT i.type, ',' ORDER BY i.type) AS ioc_types,
       round(avg(coalesce(cast(i.risk_score AS double), 0.0)), 6) AS avg_risk_score,
       count(DISTINCT i.type) > 1 AND avg(coalesce(cast(i.risk_score AS double), 0.0)) > 0.6 AS is_campaign
FROM comp c LEFT JOIN ioc i ON c.id = i.id GROUP BY 1 HAVING count(*) >= 3"""
MEMBERS_SQL = """
SELECT c.component AS component_id, c.id, i.type, i.value, cast(i.risk_score AS double) AS risk_score
FROM comp c LEFT JOIN ioc i ON c.id = i.id
WHERE c.component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= 3)"""


def _profiles(spark, sf_dir, days):
    return G.component_profiles(_components(spark, sf_dir, days), _nodes(spark, sf_dir)).withColumn("avg_risk_score", r6("avg_risk_score"))


def _members(spark, sf_dir, days):
    nodes, m = _nodes(spark, sf_dir), _components(spark, sf_dir, days)
    big = m.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("component")
    m = m.join(big, "component", "left_semi")
    return m.join(nodes.select("id", "type", "value", F.col("risk_score").cast("double").alias("risk_score")), "id", "left") \
        .select(F.col("component").alias("component_id"), "id", "type", "value", "risk_score")


@query("components", f"WITH RECURSIVE {comp_sql(LOOK_BACK_DAYS)}{PROFILE_SQL}")
def components(spark, sf_dir):
    """Components (>= 3 nodes) of the last 30 days' graph with
    their profiles."""
    return _profiles(spark, sf_dir, LOOK_BACK_DAYS)


@query("component_members", f"WITH RECURSIVE {comp_sql(LOOK_BACK_DAYS)}{MEMBERS_SQL}")
def component_members(spark, sf_dir):
    """Members of every component with >= 3 nodes, as rows (no lists)."""
    return _members(spark, sf_dir, LOOK_BACK_DAYS)


@query("recent_components", f"WITH RECURSIVE {comp_sql(RECENT_DAYS)}{PROFILE_SQL}")
def recent_components(spark, sf_dir):
    """P1/P3/G14 with a look-back of two hours: many small components."""
    return _profiles(spark, sf_dir, RECENT_DAYS)


@query("recent_component_members", f"WITH RECURSIVE {comp_sql(RECENT_DAYS)}{MEMBERS_SQL}")
def recent_component_members(spark, sf_dir):
    """P6 with a look-back of two hours."""
    return _members(spark, sf_dir, RECENT_DAYS)


@query("graph_memberships", """WITH m AS (
  SELECT 'same_source' AS kind, source AS grp, id, 0.6 AS confidence FROM ioc WHERE source <> ''
  UNION ALL SELECT DISTINCT 'shared_enrichment', enrichment_type || ':' || data, ioc_id, 0.7 FROM enrichment
    WHERE enrichment_type IN ('resolved_ip', 'asn', 'country') AND ioc_id IN (SELECT id FROM ioc)
  UNION ALL SELECT 'ai_correlated', 'malicious', ioc_id, max(confidence) FROM prediction
    WHERE prediction = 'malicious' AND confidence > 0.8 AND ioc_id IN (SELECT id FROM ioc) GROUP BY ioc_id)
SELECT kind, grp, id, round(cast(confidence AS double), 6) AS confidence FROM m
WHERE (kind, grp) IN (SELECT (kind, grp) FROM m GROUP BY kind, grp HAVING count(*) > 1)""")
def graph_memberships(spark, sf_dir):
    """Groups whose members are all related, one row a member."""
    m = G.memberships(_nodes(spark, sf_dir), views.enrichment(spark, sf_dir), views.prediction(spark, sf_dir))
    return m.withColumn("confidence", r6("confidence"))


@query("same_source_edges", f"""WITH {EDGES_SQL},
day AS (SELECT id, source FROM ioc WHERE source IS NOT NULL),
hub AS (SELECT source, min(id) AS hub FROM day GROUP BY 1)
SELECT h.hub AS src, d.id AS dst, 'same_source' AS relationship_type, 0.6 AS confidence
FROM day d JOIN hub h ON d.source = h.source
WHERE d.id <> h.hub AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = h.hub AND e.dst = d.id)""")
def same_source_edges(spark, sf_dir):
    """J16 over all sightings (star form)."""
    return G.same_source_edges(_nodes(spark, sf_dir), _explicit(spark, sf_dir))


@query("ai_correlated_edges", f"""WITH {EDGES_SQL},
p AS (SELECT ioc_id, max(confidence) AS best FROM prediction WHERE prediction = 'malicious' AND confidence > 0.8 GROUP BY 1),
h AS (SELECT min(ioc_id) AS hid, arg_min(best, ioc_id) AS hbest FROM p)
SELECT least(p.ioc_id, h.hid) AS src, greatest(p.ioc_id, h.hid) AS dst, 'ai_correlated' AS relationship_type,
       round(least(p.best, h.hbest), 6) AS confidence
FROM p, h WHERE p.ioc_id <> h.hid
  AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = least(p.ioc_id, h.hid) AND e.dst = greatest(p.ioc_id, h.hid))""")
def ai_correlated_edges(spark, sf_dir):
    """AI-correlated IOC relations (star form, canonical pairs)."""
    e = G.ai_correlated_edges(views.prediction(spark, sf_dir), _explicit(spark, sf_dir))
    return e.withColumn("confidence", r6("confidence"))


@query("ioc_neighbours", f"""WITH {EDGES_SQL},
both_dirs AS (SELECT src AS ioc_id, dst AS other_id, relationship_type, confidence FROM edges
              UNION ALL SELECT dst, src, relationship_type, confidence FROM edges)
SELECT b.ioc_id, b.other_id, b.relationship_type, round(b.confidence, 6) AS confidence, i.type AS other_type,
       i.value AS other_value, cast(i.risk_score AS double) AS other_risk_score
FROM both_dirs b JOIN ioc i ON b.other_id = i.id""")
def ioc_neighbours(spark, sf_dir):
    """Every node's neighbours with edge attributes and details."""
    n = G.neighbours(_explicit(spark, sf_dir), _nodes(spark, sf_dir))
    return n.select("ioc_id", "other_id", "relationship_type", r6("confidence").alias("confidence"), "other_type",
                    "other_value", F.col("other_risk_score").cast("double").alias("other_risk_score"))
