"""Relationship graph operators.

The graph is two DataFrames: nodes (IOC rows) and canonical undirected edges
(``src < dst``).  Group-induced edges (same source, AI-correlated) are built
as star edges -- every member linked to the group's smallest id -- which
gives the same connected components as all pairs at linear size.
Components come from iterative min-label propagation with pointer jumping;
every round is written to the shared checkpoint folder so lineage
stays short and a lost executor only replays one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (AI_PAIR_CONFIDENCE, COMPONENT_CAMPAIGN_RISK, COMPONENT_MIN_SIZE, EDGE_SAME_SOURCE, EDGE_SHARED_ENRICHMENT,
                         LOOK_BACK_DAYS, SHARED_ENRICHMENT_KINDS)
from ..session import scratch_path, small_tasks


def canonical(edges: DataFrame, a: str = "ioc1_id", b: str = "ioc2_id") -> DataFrame:
    """(least, greatest) endpoints; self loops dropped."""
    return (edges.withColumn("src", F.least(a, b)).withColumn("dst", F.greatest(a, b))
                 .where(F.col("src") != F.col("dst")))


def explicit_edges(rel: DataFrame, nodes: DataFrame) -> DataFrame:
    """Explicit edges with both ends present as nodes; one edge per
    unordered pair, the last one written (by creation, then ioc1_id)."""
    e = canonical(rel)
    ids = nodes.select(F.col("id"))
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi") \
         .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    best = F.max_by(F.struct("relationship_type", "confidence"), F.struct("created_at", "ioc1_id"))
    return e.groupBy("src", "dst").agg(best.alias("_e")).select(
        "src", "dst", F.col("_e.relationship_type").alias("relationship_type"), F.col("_e.confidence").alias("confidence"))


def since(df: DataFrame, as_of, days: float | None) -> DataFrame:
    """Rows created in the ``days`` before ``as_of``, both ends included
    (None: all rows).  A plain filter, so it reaches the scan."""
    if days is None:
        return df
    return df.where(F.col("created_at") >= as_of - F.expr(f"make_dt_interval(0, 0, 0, {days * 86400:.6f})"))


def dated_graph(iocs: DataFrame, rel: DataFrame, enr: DataFrame, as_of, days: float | None = LOOK_BACK_DAYS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph at ``as_of``: indicators and stored
    relations of the look-back, and the implied edges among these nodes."""
    nodes = since(iocs, as_of, days)
    return nodes, graph_edges(explicit_edges(since(rel, as_of, days), nodes), nodes, enr)


def memberships(nodes: DataFrame, enr: DataFrame, predictions: DataFrame) -> DataFrame:
    """J16-J18 without loss at linear size: (kind, grp, id, confidence), one
    row for each member of a group of two or more.  Any two members of a group
    are related, by the smaller of their confidences: fixed for a source or a
    payload, an indicator's best malicious verdict in the one group of those."""
    ids = nodes.select("id")
    source = nodes.where("source <> ''").select(F.lit(EDGE_SAME_SOURCE[0]).alias("kind"), F.col("source").alias("grp"), "id", F.lit(float(EDGE_SAME_SOURCE[1])).alias("confidence"))
    shared = enr.where(F.col("enrichment_type").isin(*SHARED_ENRICHMENT_KINDS)).select(
        F.lit(EDGE_SHARED_ENRICHMENT[0]).alias("kind"), F.concat_ws(":", "enrichment_type", "data").alias("grp"), F.col("ioc_id").alias("id"),
        F.lit(float(EDGE_SHARED_ENRICHMENT[1])).alias("confidence")).join(ids, "id", "left_semi").distinct().select("kind", "grp", "id", "confidence")
    sure = predictions.where((F.col("prediction") == "malicious") & (F.col("confidence") > AI_PAIR_CONFIDENCE)) \
        .groupBy(F.col("ioc_id").alias("id")).agg(F.max("confidence").alias("confidence")).join(ids, "id", "left_semi")
    ai = sure.select(F.lit("ai_correlated").alias("kind"), F.lit("malicious").alias("grp"), "id", "confidence")
    rows = source.unionByName(shared).unionByName(ai)
    # at most as many groups as sources and payloads; sizes combine map-side
    size = rows.groupBy("kind", "grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(size, ["kind", "grp"], "left_semi")


def star_edges(members: DataFrame, group: str, kind: str, confidence) -> DataFrame:
    """Star form of "all pairs within a group": member -> group minimum."""
    hub = members.groupBy(group).agg(F.min("id").alias("_hub"))
    m = members.join(hub, group).where(F.col("id") != F.col("_hub"))
    conf = confidence if not isinstance(confidence, (int, float)) else F.lit(float(confidence))
    return m.select(F.col("_hub").alias("src"), F.col("id").alias("dst"), F.lit(kind).alias("relationship_type"),
                    conf.alias("confidence"))


def same_source_edges(iocs: DataFrame, existing: DataFrame) -> DataFrame:
    """Same-source edges (star form), skipped where an edge exists."""
    kind, conf = EDGE_SAME_SOURCE
    st = star_edges(iocs.where(F.col("source").isNotNull()).select("id", "source"), "source", kind, conf)
    return st.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def graph_edges(explicit: DataFrame, nodes: DataFrame, enr: DataFrame) -> DataFrame:
    """The whole graph as one edge table -- explicit edges, then
    same-source, then shared-enrichment star edges, each kind only where no
    earlier one has the pair.  An empty source is none; payloads of unknown
    IOCs are left out."""
    from .enrich import shared_enrichment_edges
    known = enr.join(nodes.select(F.col("id").alias("ioc_id")), "ioc_id", "left_semi")
    cols = ["src", "dst", "relationship_type", "confidence"]
    first = [e.withColumn("confidence", F.col("confidence").cast("double")).select(*cols)
             for e in (explicit, same_source_edges(nodes.where("source <> ''"), explicit))]
    edges = first[0].unionByName(first[1])
    return edges.unionByName(shared_enrichment_edges(known, edges).select(*cols))


def ai_correlated_edges(predictions: DataFrame, existing: DataFrame) -> DataFrame:
    """IOCs with a malicious verdict of confidence > 0.8 are all
    related; star form, pair confidence = min of the two IOCs' best
    confidences (= max over prediction pairs of the min), no self pairs."""
    hi = predictions.where((F.col("prediction") == "malicious") & (F.col("confidence") > AI_PAIR_CONFIDENCE))
    per_ioc = hi.groupBy("ioc_id").agg(F.max("confidence").alias("best"))
    # the hub (smallest IOC id) and its best confidence: one aggregate row,
    # attached as scalar subqueries
    hub = per_ioc.agg(F.min("ioc_id").alias("hid"), F.min_by("best", "ioc_id").alias("hbest"))
    hub_id, hb = hub.select("hid").scalar(), hub.select("hbest").scalar()
    e = per_ioc.where(F.col("ioc_id") != hub_id).select(
        F.least(F.col("ioc_id"), hub_id).alias("src"), F.greatest(F.col("ioc_id"), hub_id).alias("dst"),
        F.lit("ai_correlated").alias("relationship_type"), F.least(F.col("best"), hb).alias("confidence"))
    return e.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node's neighbours with edge attributes and the other
    end's details -- edges unioned in both directions (no OR join)."""
    both = edges.select(F.col("src").alias("ioc_id"), F.col("dst").alias("other_id"), "relationship_type", "confidence") \
        .unionByName(edges.select(F.col("dst").alias("ioc_id"), F.col("src").alias("other_id"), "relationship_type", "confidence"))
    n = nodes.select(F.col("id").alias("other_id"), F.col("type").alias("other_type"), F.col("value").alias("other_value"),
                     F.col("risk_score").alias("other_risk_score"))
    return both.join(n, "other_id", "inner")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node touching an edge; the component
    id is the smallest node id in it.

    Each round lets every edge propose the smaller endpoint label both to
    the other endpoint and to the node that other label names (hooking, so
    whole trees merge), then follows labels one hop (pointer jumping).  The
    number of changed labels is counted on the written result of the round;
    the loop ends when nothing changed.  Every round is written once to the
    shared folder, so lineage never spans a round and a lost executor
    replays at most one round.  At the end most rows carry one label: the
    tasks of a round are sized by rows, and hot labels split."""
    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(df.sparkSession, name)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a != b").distinct()
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    adj = kept(e.select(F.inline(both)), "component-edges")
    with small_tasks(edges.sparkSession, adj.count()):
        return _labels(adj, kept)


def _labels(adj: DataFrame, kept) -> DataFrame:
    """The rounds of ``connected_components`` on (u, v) in both directions."""
    # start: each node labelled with the smallest id among itself and its neighbours
    labels = adj.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("label")).withColumnRenamed("u", "id")
    labels = kept(labels, "component-labels")
    rounds = 0
    while True:
        rounds += 1
        # every edge (u, v) proposes L(v) to u (propagation) and to the
        # node named by L(u) (hooking: a whole tree moves in one round)
        lv = labels.select(F.col("id").alias("v"), F.col("label").alias("lv"))
        lu = labels.select(F.col("id").alias("u"), F.col("label").alias("lu"))
        e2 = adj.join(lv, "v").join(lu, "u").where(F.col("lv") < F.col("lu"))
        props = e2.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.col("lv").alias("m")),
                                           F.struct(F.col("lu").alias("id"), F.col("lv").alias("m")))))
        prop = props.groupBy("id").agg(F.min("m").alias("m"))
        step = labels.join(prop, "id", "left") \
            .select("id", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("label"))
        # pointer jumping: follow the label to the label its node had
        hop = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        jump = kept(step.join(hop, "label", "left")
                    .select("id", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "component-labels")
        changed = jump.where(F.col("label") != F.col("was")).count()
        labels = jump.select("id", "label")
        connected_components.rounds = rounds
        if changed == 0:
            return labels.withColumnRenamed("label", "component")


def component_profiles(members: DataFrame, nodes: DataFrame, min_size: int = COMPONENT_MIN_SIZE) -> DataFrame:
    """Size, types, average risk (NULL as 0) and campaign flag of each
    component with at least ``min_size`` nodes."""
    n = nodes.select("id", "type", "risk_score")
    j = members.join(n, "id", "left")
    g = j.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"),
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("ioc_types"),
        F.size(F.collect_set("type")).alias("_nt"),
        F.avg(F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0))).alias("avg_risk_score"))
    g = g.where(F.col("size") >= min_size)
    return g.select(F.col("component").alias("component_id"), "size", "ioc_types", "avg_risk_score",
                    ((F.col("_nt") > 1) & (F.col("avg_risk_score") > COMPONENT_CAMPAIGN_RISK)).alias("is_campaign"))


