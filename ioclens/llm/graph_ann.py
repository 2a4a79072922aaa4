"""Approximate nearest neighbours over robust-pruned directed graphs.

Distinct vectors are dealt by hash to shards of about SHARD; each shard
builds one graph in one task.  Points are inserted in batches: a greedy beam
search on the graph so far proposes neighbours, and relaxed distance pruning
keeps a proposed neighbour only if no nearer kept one is ALPHA times closer to
it than the point itself, so kept edges point in different directions; kept
edges also get their reverse, pruned the same way where a node has too many.
Last, nodes that no path from the start leads to (among crowds of near copies
most edges are pruned) get an edge from a near node that one does.
Queries are written once, and each shard's task reads them in blocks beside
its graph, so the index is shuffled once however many queries there are.  All
nodes of a query's beam are scored again in double precision before the
nearest are taken.

Vectors that differ by a power of two have exactly the same cosines, so they
are one node (of the vector scaled to a largest component in [1, 2)) holding
its smallest ids: thousands of copies neither crowd a graph nor make ties
uncertain, as among equal scores only the smallest ids can be asked for.

Every row is indexed.  Recall against brute force is measured by the tests and
stated in the README.

Defined results: vectors null, zero, or with a null or non-finite component,
and rows without id, take no part; vectors of other lengths are never compared
with each other; rows equal in id and vector count once; a query with fewer
candidates gives all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, shared_file, stored
from .mph import mix

SHARD = 8192
QUERIES = 2048
DEGREE = 32
BUILD_BEAM = 64
BEAM = 192
ALPHA = 1.2
BATCH = 512
SPARE = 8  # edges a node may take on for nodes that no other edge leads to
STEP = 4  # nodes a query opens at once


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of each query's beam, nearest first; -1 pads.
    A search ends when every node of its beam has been opened."""
    n, q = len(points), len(queries)
    beam = min(beam, n)
    nodes = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -np.inf, np.float32)
    opened = np.ones((q, beam), bool)
    seen = np.zeros((q, n), bool)
    nodes[:, 0], opened[:, 0], seen[:, start] = start, False, True
    sims[:, 0] = queries @ points[start]
    active = np.arange(q)
    while len(active):
        width = min(STEP, beam)
        value = np.where(opened[active], -np.inf, sims[active])
        pick = np.argpartition(-value, width - 1, axis=1)[:, :width] if width < beam else np.tile(np.arange(beam), (len(active), 1))
        chosen = np.take_along_axis(nodes[active], pick, 1)
        fresh = np.isfinite(np.take_along_axis(value, pick, 1))
        live = fresh.any(1)
        active, pick, chosen, fresh = active[live], pick[live], chosen[live], fresh[live]
        if not len(active):
            break
        opened[active[:, None], pick] |= fresh
        near = np.where(fresh[:, :, None], edges[np.where(fresh, chosen, 0)], -1).reshape(len(active), -1)
        near.sort(axis=1)
        ok = near >= 0
        ok[:, 1:] &= near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(ok)
        ids = near[row, col]
        new = ~seen[active[row], ids]
        row, col, ids = row[new], col[new], ids[new]
        seen[active[row], ids] = True
        got = np.full(near.shape, -np.inf, np.float32)
        got[row, col] = np.einsum("ij,ij->i", points[ids], queries[active[row]])
        all_sims = np.concatenate([sims[active], got], axis=1)
        all_nodes = np.concatenate([nodes[active], near], axis=1)
        all_open = np.concatenate([opened[active], np.zeros(near.shape, bool)], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[active] = np.take_along_axis(all_sims, best, 1)
        opened[active] = np.take_along_axis(all_open, best, 1) | ~np.isfinite(sims[active])
        nodes[active] = np.where(np.isfinite(sims[active]), np.take_along_axis(all_nodes, best, 1), -1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)


def robust_prune(points: np.ndarray, own: np.ndarray, found: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours of each point of ``own`` among its candidates ``found``
    (-1 pads), padded with -1."""
    found = np.where(found == own[:, None], -1, found)
    vectors = points[np.maximum(found, 0)].astype(np.float64)  # near copies lie within single precision of each other
    to_own = np.where(found >= 0, 2 - 2 * np.einsum("bcd,bd->bc", vectors, points[own].astype(np.float64)), np.inf)
    between = 2 - 2 * (vectors @ vectors.transpose(0, 2, 1))
    left, out = to_own.copy(), np.full((len(own), degree), -1, np.int64)
    rows = np.arange(len(own))
    for k in range(degree):
        best = left.argmin(axis=1)
        ok = np.isfinite(left[rows, best])
        if not ok.any():
            break
        out[:, k] = np.where(ok, found[rows, best], -1)
        covered = ALPHA * ALPHA * between[rows, best] <= to_own
        covered[rows, best] = True
        left[covered & ok[:, None]] = np.inf
    return out


def build(points: np.ndarray) -> tuple[np.ndarray, int]:
    """(edges padded with -1, start) of the graph over unit vectors."""
    n = len(points)
    rng = np.random.default_rng(n)
    degree = min(DEGREE, max(1, n - 1))
    start = int((points @ points.mean(axis=0)).argmax())
    edges = rng.integers(0, n, (n, degree))  # random until a point's turn comes
    edges[edges == np.arange(n)[:, None]] = start
    order = rng.permutation(n)
    for at in range(0, n, BATCH):
        own = order[at:at + BATCH]
        found, _ = beam_search(points, edges, start, points[own], BUILD_BEAM)
        edges[own] = robust_prune(points, own, np.concatenate([found, edges[own]], axis=1), degree) if at else robust_prune(points, own, found, degree)
        back = np.column_stack([edges[own].ravel(), np.repeat(own, degree)])
        back = back[back[:, 0] >= 0]
        if not len(back):  # one point alone
            continue
        back = back[np.argsort(back[:, 0], kind="stable")]
        heads, first, counts = np.unique(back[:, 0], return_index=True, return_counts=True)
        place = np.arange(len(back)) - np.repeat(first, counts)
        more = np.full((len(heads), counts.max()), -1, np.int64)
        more[np.repeat(np.arange(len(heads)), counts), place] = back[:, 1]
        for k in range(0, len(heads), BATCH):
            h = heads[k:k + BATCH]
            both = np.concatenate([edges[h], more[k:k + BATCH]], axis=1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            edges[h] = robust_prune(points, h, both, degree)
    return reach_all(points, edges, start), start


def reached(edges: np.ndarray, start: int) -> np.ndarray:
    seen = np.zeros(len(edges), bool)
    seen[start] = True
    new = np.array([start])
    while len(new):
        onward = edges[new].ravel()
        onward = np.unique(onward[onward >= 0])
        new = onward[~seen[onward]]
        seen[new] = True
    return seen


def reach_all(points: np.ndarray, edges: np.ndarray, start: int) -> np.ndarray:
    """The edges with up to SPARE more a node, so that paths from the start
    lead to every node that finds a near node with room."""
    edges = np.concatenate([edges, np.full((len(edges), SPARE), -1, edges.dtype)], axis=1)
    room = np.full(len(edges), SPARE)
    while not (seen := reached(edges, start)).all():
        left = np.flatnonzero(~seen)
        before = room.sum()
        for at in range(0, len(left), BATCH):
            own = left[at:at + BATCH]
            found, _ = beam_search(points, edges, start, points[own], BUILD_BEAM)
            for u, near in zip(own.tolist(), found, strict=True):
                if seen[u]:
                    continue
                near = near[near >= 0]
                near = near[room[near] > 0]
                if len(near):
                    edges[near[0], edges.shape[1] - room[near[0]]] = u
                    room[near[0]] -= 1
                    seen[u] = True
        if room.sum() == before:
            break
    width = edges.shape[1] - SPARE
    return edges[:, :width + SPARE - int(room.min())]


# Spark -----------------------------------------------------------------------

INDEX = "dim int, shard int, node int, ids array<long>, vector binary, edges binary, start int"
FOUND = "query_id long, vec_id long, score double"


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part; v in double precision."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def smallest_ids(rows: DataFrame, keep: int) -> DataFrame:
    """(key, v, ids): distinct directions (vectors up to a power of two) with
    their ``keep`` smallest ids.  The ranking limits rows in each task before
    its shuffle, so a vector that many rows share stays small."""
    largest = F.array_max(F.transform("v", F.abs))
    power = F.floor(F.log2(largest)).cast("double")
    left = largest / F.pow(F.lit(2.0), power)  # the logarithm may be off by one at a power of two
    power = F.when(left >= 2, power + 1).when(left < 1, power - 1).otherwise(power)
    # scaled in two steps, as the power itself may be out of range
    half = F.floor(power / 2)
    rows = rows.withColumn("_a", F.pow(F.lit(2.0), half)).withColumn("_b", F.pow(F.lit(2.0), power - half))
    rows = rows.withColumn("v", F.transform("v", lambda x: x / F.col("_a") / F.col("_b") + F.lit(0.0))).drop("_a", "_b")
    rows = rows.withColumn("key", F.xxhash64("v"))
    once = rows.groupBy("key", "v", "vec_id").agg(F.lit(1).alias("one")).drop("one")
    salted = once.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for part in (["key", "v", "salt"], ["key", "v"]):
        salted = salted.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy("vec_id"))).where(F.col("place") <= keep).drop("place")
    return salted.groupBy("key", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _build(group: pa.Table) -> pa.Table:
    group = group.sort_by([("key", "ascending")])
    vectors = _vectors(group["v"])
    edges, start = build(unit(vectors))
    n = len(vectors)
    return pa.table({"dim": pa.array([vectors.shape[1]] * n, pa.int32()), "shard": group["shard"], "node": pa.array(range(n), pa.int32()), "ids": group["ids"],
                     "vector": pa.array([v.tobytes() for v in vectors], pa.binary()), "edges": pa.array([e.tobytes() for e in edges.astype(np.int32)], pa.binary()),
                     "start": pa.array([start] * n, pa.int32())})


def index(rows: DataFrame, keep: int) -> DataFrame:
    """The graphs of rows of ``usable``, stored: INDEX."""
    nodes = stored(smallest_ids(rows, keep), "ann-vectors")
    shards = max(1, round(nodes.count() / SHARD))
    nodes = nodes.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return stored(nodes.groupBy("dim", "shard").applyInArrow(_build, INDEX), "ann-graphs")


def _blocks(path: str, dim: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """(ids, vectors) of the written queries of one length, QUERIES at a time."""
    system, folder = shared_file(path)
    from pyarrow import dataset
    asked = dataset.dataset(folder, filesystem=system, format="parquet")
    for batch in asked.to_batches(filter=dataset.field("dim") == dim, columns=["query_id", "v"], batch_size=QUERIES):
        if len(batch):
            yield batch["query_id"].to_pylist(), _vectors(batch["v"])


def search(graphs: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """FOUND: each query's k best of each shard, itself left out."""
    asked = queries.select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"))
    path = scratch_path(queries.sparkSession, "ann-queries")
    asked.write.parquet(path)
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(graph: pa.Table) -> pa.Table:
        graph = graph.sort_by([("node", "ascending")])
        vectors = np.stack([np.frombuffer(x, np.float64) for x in graph["vector"].to_pylist()])
        edges = np.stack([np.frombuffer(x, np.int32) for x in graph["edges"].to_pylist()]).astype(np.int64)
        ids, start = graph["ids"].to_pylist(), graph["start"][0].as_py()
        points, length = unit(vectors), np.sqrt((vectors * vectors).sum(1))
        out = [kinds.empty_table()]
        for own, q in _blocks(path, vectors.shape[1]):
            for at in range(0, len(q), 512):
                part = q[at:at + 512]
                nodes, _ = beam_search(points, edges, start, unit(part), max(beam, 2 * k))
                rows: list[tuple] = []
                for i, query_id in enumerate(own[at:at + 512]):
                    best = nodes[i][nodes[i] >= 0]
                    scores = (vectors[best] @ part[i]) / (length[best] * np.sqrt(part[i] @ part[i]))
                    # nodes as good as the (k + 1)th hold all of the k nearest, the query's own node aside
                    enough = scores >= (np.partition(scores, -(k + 1))[-(k + 1)] if len(scores) > k + 1 else -2)
                    near = sorted((-s, v) for s, b in zip(scores[enough].tolist(), best[enough].tolist(), strict=True) for v in ids[b] if v != query_id)
                    rows += [(query_id, v, -s) for s, v in near[:k]]
                out.append(pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds) if rows else kinds.empty_table())
        return pa.concat_tables(out)

    return graphs.groupBy("dim", "shard").applyInArrow(run, FOUND)


def nearest(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    rows = usable(embeddings)
    asked = stored(rows.where(F.col("vec_id") % every == 0).dropDuplicates(), "ann-queries")
    return nearest(search(index(rows, k + 1), asked, k), k)
