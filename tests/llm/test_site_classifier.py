import numpy as np
import pyarrow as pa

from ioclens.llm import site_classifier as S

from .helpers import WIDE

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    train = S.training_rows(docs, labels.where("doc_id % 4 <> 0"))
    model = S.fit(train)
    rows = S.scored(docs, model, S._parts(docs, "source", "lang") + [docs.doc_id]).select("doc.*", "logit")
    sites, mean = S.posteriors(rows)
    out = S.decided(rows, sites, mean).where("doc_id % 4 = 0").join(labels, "doc_id").collect()
    good = [r.kept for r in out if r.quality == 1 and not r.toxic]
    bad = [r.kept for r in out if r.quality == 0]
    toxic = [r.kept for r in out if r.toxic]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.05 and np.mean(toxic) <= 0.35


def test_posteriors_shrink_sparse_sites(spark):
    rng = np.random.default_rng(1)
    rows = []
    for h in range(12):
        for p in range(4):
            bad = 0.8 if h < 3 else 0.2
            n = 2 if p == 3 else 200
            rows += [(f"h{h}", f"p{p}", float(-4 if rng.random() < bad else 4)) for _ in range(n)]
    rows += [("tiny", "p", -4.0)]
    sites, mean = S.posteriors(spark.createDataFrame(rows, "host string, path string, logit double"))
    got = {(r.host, r.path): r for r in sites.collect()}
    p = 1 / (1 + np.exp(-np.array([x[2] for x in rows])))
    assert abs(mean - p.mean()) < 1e-9
    assert got["h0", "p0"].host_mean < 0.35 < 0.65 < got["h9", "p0"].host_mean
    assert abs(got["tiny", "p"].path_mean - mean) < abs(1 / (1 + np.exp(4)) - mean) * 0.8  # one bad document says little
    for h in range(12):
        r = got[f"h{h}", "p3"]
        assert abs(r.path_mean - r.host_mean) < 0.2


def test_decisions_match_brute_force(spark):
    """Log-odds by hand, each document left out of its site's sums."""
    rng = np.random.default_rng(6)
    rows = [(i, f"h{i % 5 % 3}", f"p{i % 4}", float(rng.normal(1, 3))) for i in range(400)] + [(1000, "alone", "p", -2.0), (1001, "alone", "q", 30.0)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, logit double")
    sites, mean = S.posteriors(df)
    k_host, k_path = sites.select("k_host", "k_path").first()
    p = {r[0]: 1 / (1 + np.exp(-r[3])) for r in rows}
    odds = lambda x: float(np.log(np.clip(x, 1e-6, 1 - 1e-6) / (1 - np.clip(x, 1e-6, 1 - 1e-6))))
    got = {r.doc_id: r for r in S.decided(df, sites, mean).collect()}
    assert abs(mean - np.mean(list(p.values()))) < 1e-9 and len(got) == len(rows)
    for i, host, path, logit in rows:
        of_host = [p[j] for j, h, _, _ in rows if h == host and j != i]
        of_path = [p[j] for j, h, q, _ in rows if (h, q) == (host, path) and j != i]
        host_mean = (sum(of_host) + k_host * mean) / (len(of_host) + k_host)
        site = (sum(of_path) + k_path * host_mean) / (len(of_path) + k_path)
        want = logit - odds(mean) + odds(site)
        assert abs(got[i].log_odds - want) < 1e-6 and got[i].kept == (want >= S.KEEP_FROM)


def test_prior_strength():
    # equal groups: no spread between them beyond chance gives a strong prior
    assert S.strength(10, 1000, 10 * 100**2, 9 * 0.25, 990 * 0.25) >= 1e5
    assert S.strength(10, 1000, 10 * 100**2, 200.0, 50.0) < 1


def test_scores_do_not_depend_on_the_batch():
    keys = np.sort(np.array([1, 5, 9], np.int64))
    rng = np.random.default_rng(2)
    texts = [b"", None, b"word", b"Some Words 123 !!", "né à ß".encode(), b"x" * 2_000_000] + [bytes(rng.integers(97, 110, 300, dtype=np.uint8)) for _ in range(40)]
    doc, key, _ = S._features([np.frombuffer(t or b"\n", np.uint8) for t in texts])
    keys = np.unique(key)[::7]
    n = len(S.DENSE)
    model = S.Model(keys, rng.normal(size=len(keys)), rng.normal(size=n), np.zeros(n), np.ones(n), 0.3)
    together = S.logits(model, pa.array(texts, pa.binary()))
    alone = np.concatenate([S.logits(model, pa.array([t], pa.binary())) for t in texts])
    assert np.allclose(together, alone)


def test_no_labels_one_class_nulls_clashes_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 1, 0.5), (None, None, None, None, None, None), (1, "some text", "en", "s", 1, 0.5)], WIDE + ", logit double")
    for labels in ([], [(1, 1, 0)], [(None, None, None), (1, None, 1)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        out = S.stage(docs, known)
        assert out.columns == docs.columns and out.count() == 3
        assert S.query(docs, known).count() == 3
        assert S.query(docs.limit(0), known).count() == 0
    assert S.stage(docs.select("doc_id", "text"), known).count() == 3


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3000)] + [(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert S.training_rows(docs, labels).count() == 3000
    assert 200 <= S.training_rows(docs, labels, most=300).count() <= 400
    copies = spark.createDataFrame([(7, "the same id")] * 500, "doc_id long, text string")
    assert S.training_rows(docs.unionByName(copies), labels).where("doc_id = 7").count() == 1
