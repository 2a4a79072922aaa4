"""Components run over explicit and implicit edges."""

from collections import defaultdict

from pyspark.sql import functions as F

import __spark_entry__ as entry
from ioclens.operators import graph as G
from ioclens.sources import views
from tests.conftest import SMALL

NODES = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (6, None), (7, "c"), (8, None), (9, None), (10, "a"), (11, ""), (12, "")]
EXPLICIT = [(1, 2, "related", 0.9), (8, 9, "related", 0.1)]
ENRICH = [(2, "resolved_ip", "10.0.0.1"), (3, "resolved_ip", "10.0.0.1"), (1, "asn", "x"), (2, "asn", "x"), (1, "asn", "y"), (10, "asn", "y"),
          (4, "country", "x"), (5, "country", "x"), (6, "virustotal", "x"), (4, "virustotal", "x"), (6, "asn", "q"), (77, "asn", "q")]


def test_edges_by_precedence_and_components(spark):
    nodes = spark.createDataFrame(NODES, "id long, source string")
    explicit = spark.createDataFrame(EXPLICIT, "src long, dst long, relationship_type string, confidence double")
    enr = spark.createDataFrame(ENRICH, "ioc_id long, enrichment_type string, data string")
    e = G.graph_edges(explicit, nodes, enr)
    assert sorted(tuple(r) for r in e.collect()) == [
        (1, 2, "related", 0.9), (1, 10, "same_source", 0.6), (2, 3, "shared_enrichment", 0.7),
        (4, 5, "shared_enrichment", 0.7), (8, 9, "related", 0.1)]
    got = {r.id: r.component for r in G.connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 4: 4, 5: 4, 8: 8, 9: 8}


def test_queries_join_sources_and_payloads(spark):
    parent = {r.id: r.id for r in views.ioc(spark, SMALL).select("id").collect()}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    groups = defaultdict(list)
    for r in views.ioc(spark, SMALL).where("source <> ''").select("id", "source").collect():
        groups["source", r.source].append(r.id)
    for r in views.enrichment(spark, SMALL).where(F.col("enrichment_type").isin("resolved_ip", "asn", "country")).collect():
        groups[r.enrichment_type, r.data].append(r.ioc_id)
    pairs = [(a, b) for ids in groups.values() for a, b in zip(ids, ids[1:])]
    pairs += [(r.ioc1_id, r.ioc2_id) for r in views.relationship(spark, SMALL).collect() if r.ioc1_id in parent and r.ioc2_id in parent]
    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = defaultdict(set)
    for x in parent:
        want[root(x)].add(x)
    want = {k: v for k, v in want.items() if len(v) >= 3}
    sizes = dict(entry.queries()["components"](spark, SMALL).select("component_id", "size").collect())
    assert sizes == {k: len(v) for k, v in want.items()}
    got = defaultdict(set)
    for r in entry.queries()["component_members"](spark, SMALL).collect():
        got[r.component_id].add(r.id)
    assert got == want
