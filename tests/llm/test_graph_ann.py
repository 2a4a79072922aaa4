import math

import numpy as np
import pytest

from ioclens.llm import graph_ann as G

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, k=5, every=50):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q, a in ok:
        if q % every:
            continue
        a = np.array(a, np.float64)
        near = sorted((-float(np.dot(a, b) / math.sqrt(np.dot(a, a)) / math.sqrt(np.dot(b, b))), i) for i, b in ((i, np.array(b, np.float64)) for i, b in ok if i != q and len(b) == len(a)))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def found(spark, rows, **kw):
    return sorted(tuple(r) for r in G.query(spark.createDataFrame(rows, VECTORS), **kw).collect())


def f32(x):
    return [float(v) for v in np.asarray(x, np.float32)]


def same(got, want):
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    assert [g[2] for g in got] == [w[2] for w in want]


def test_small_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f32(rng.normal(size=8))) for i in range(60)]
    rows += [(100, None), (101, [0.0] * 8), (102, [float("nan")] + [1.0] * 7), (103, [float("inf")] * 8), (104, [None] + [1.0] * 7), (None, f32(rng.normal(size=8))),
             (150, f32(rng.normal(size=3))), (151, f32(rng.normal(size=3))), (200, f32(rng.normal(size=5))), (50, rows[50][1]), (250, []), (300, rows[7][1]), (301, rows[7][1])]
    same(found(spark, rows), brute(rows))


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(2)
    one = f32(rng.normal(size=16))
    rows = [(i, one) for i in range(0, 700)] + [(1000 + i, f32(rng.normal(size=16))) for i in range(200)]
    same(found(spark, rows), brute(rows))


def test_scaled_copies_tie(spark):
    """Multiples by powers of two have equal cosines: ids decide, beyond any beam."""
    rng = np.random.default_rng(3)
    one = rng.normal(size=8)
    rows = [(i, f32(one * 2.0 ** (i % 60 - 30))) for i in range(400)] + [(1000 + i, f32(rng.normal(size=8))) for i in range(200)]
    got = found(spark, rows)
    same(got, brute(rows))
    assert [g[2] for g in got if g[0] == 0] == [1, 2, 3, 4, 5]


def test_slightly_perturbed_copies(spark):
    """More vectors than k within single precision of each other."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=8)
    rows = [(i, f32(one * (1 + 1e-4 * rng.normal(size=8)))) for i in range(100)] + [(1000 + i, f32(rng.normal(size=8))) for i in range(200)]
    got, want = found(spark, rows), brute(rows)
    assert np.mean([g[2] == w[2] for g, w in zip(got, want, strict=True)]) >= 0.95


def test_clashing_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f32(rng.normal(size=4)), "x", 1, 2.0) for i in range(60)]
    df = spark.createDataFrame(rows, VECTORS + ", ids string, dim int, score double")
    same(sorted(tuple(r) for r in G.query(df).collect()), brute([r[:2] for r in rows]))


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0]), (50, None)]) == []
    assert found(spark, [(50, [1.0])]) == []


@pytest.mark.parametrize("n, dim, clusters", [(3000, 64, 10), (3000, 24, 3000)])
def test_recall_over_shards_and_blocks(spark, monkeypatch, n, dim, clusters):
    monkeypatch.setattr(G, "SHARD", 1000)
    monkeypatch.setattr(G, "QUERIES", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(clusters, dim))
    rows = [(i, f32(centres[i % clusters] + rng.normal(size=dim))) for i in range(n)]
    got, want = found(spark, rows, every=30), brute(rows, every=30)
    assert len(got) == len(want)
    assert len({g[0::2][:2] for g in got} & {w[0::2][:2] for w in want}) >= 0.95 * len(want)
    score = {(w[0], w[2]): w[3] for w in want}
    assert all(abs(g[3] - score[g[0], g[2]]) < 1e-12 for g in got if (g[0], g[2]) in score)


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got, want = found(spark, rows), brute(rows)
    assert len({(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in want}) >= 0.9 * len(want)


def test_pruning_keeps_diverse_edges():
    points = G.unit(np.random.default_rng(4).normal(size=(400, 16)))
    edges, start = G.build(points)
    assert 0 <= start < 400 and edges.shape == (400, G.DEGREE)
    for i in range(0, 400, 37):
        own = [j for j in edges[i] if j >= 0]
        assert i not in own and len(set(own)) == len(own)
    nodes, sims = G.beam_search(points, edges, start, points[:50], 64)
    assert (nodes[:, 0] == np.arange(50)).all() and (np.diff(sims, axis=1) <= 0).all()
