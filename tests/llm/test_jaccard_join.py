import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ioclens.llm import jaccard_join as J
from ioclens.llm.shingles import text_sets

from .helpers import DOCS, SMALL, by_id

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                both = len(a & sets[j])
                if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs)}


def text_of(rng, n, words=4000):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return words


def family(rng):
    """Copies, near copies at and around the limit, chains and a passage that
    many unrelated documents share."""
    docs = []
    passage = text_of(rng, 60)
    for size in (5, 20, 60, 150, 400):
        base = text_of(rng, size)
        docs += [base] * 3 + [edited(rng, base, k) for k in (1, 1, 2, 3, 5, 8)] + [base[:-max(1, size // 8)], base + text_of(rng, size // 4)]
        link = base
        for _ in range(5):
            link = edited(rng, link, max(1, size // 60))
            docs.append(link)
    docs += [text_of(rng, rng.randrange(40, 120)) + passage for _ in range(60)]
    docs += [passage + text_of(rng, 6) for _ in range(10)]
    return [" ".join(d) for d in docs] + ["", None, "  \n ", "one", "One ", "a b c d", "A B C D", "a b c d e"]


@pytest.mark.parametrize("seed, block, group", [(1, 2048, 1 << 18), (2, 4, 64)])
def test_families_match_brute_force(spark, monkeypatch, seed, block, group):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "GROUP", group)
    rng = random.Random(seed)
    docs = list(zip(rng.sample(range(10_000), 400), family(rng), strict=False))
    rng.shuffle(docs)
    assert by_id(J.query(spark.createDataFrame(docs, DOCS).repartition(5))) == brute(docs)


def test_large_near_copy_group(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 32)
    rng = random.Random(9)
    base = text_of(rng, 120)
    docs = [(i, " ".join(edited(rng, base, rng.randrange(6)))) for i in range(300)] + [(1000 + i, " ".join(text_of(rng, 120))) for i in range(50)]
    assert by_id(J.query(spark.createDataFrame(docs, DOCS).repartition(7))) == brute(docs)


def test_whole_table_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert by_id(J.query(spark.createDataFrame(docs, DOCS))) == brute(docs)


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, None), (None, "x y"), (1, None)], DOCS)
    got = sorted((tuple(r) for r in J.query(docs).collect()), key=str)
    assert got == sorted([(3, 2, 3), (None, 2, 3), (3, 2, 3), (None, 0, None), (None, 1, None), (1, 0, 1)], key=str)
    assert J.query(docs.limit(0)).count() == 0
    assert J.query(spark.createDataFrame([(1, ""), (2, None)], DOCS)).count() == 2


def test_stage_keeps_one_of_each_group(spark):
    schema = "doc_id long, text string, node string, n int"
    docs = spark.createDataFrame([(2, "a b c d e f g", "x", 1), (1, "A b c d e f g", "y", 2), (3, "other words", "z", 3), (None, "a b c d e f g", None, None), (4, "", "e", 0)], schema)
    out = J.stage(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {1, 3, 4}


def test_stage_decides_by_row(spark):
    """Rows that share an id or have none: each text stays once."""
    a, b, c = "a b c d e f g", "some other words that stay", "three three three three three"
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (None, a), (7, c), (7, c), (None, "only here"), (None, "only here")], DOCS)
    assert sorted((tuple(r) for r in J.stage(docs).collect()), key=str) == sorted([(1, a), (2, b), (7, c), (None, "only here")], key=str)


def test_sets_of_long_and_odd_texts():
    texts = ["", " ", "a", "A a", "x " * 100_000, "w" * 300_000 + " b c d e f", "é É é", "a\tb\nc\rd\ve\ff\x1cg", None] + [" ".join(text_of(random.Random(4), 70_000))]
    made = list(text_sets(pa.array([t.encode() if t is not None else None for t in texts], pa.binary())))
    assert [len(s) for s in made] == [len(shingles(t)) for t in texts]
    assert all((np.diff(s.astype(np.int64)) > 0).all() for s in made)


def test_bound_is_never_too_low():
    rng = np.random.default_rng(3)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 2**62, 2500, dtype=np.uint64))
        a, b = (np.sort(rng.choice(pool, rng.integers(1, 2000), replace=False)) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert both <= J.bound(J.bitmap(a), J.bitmap(b), len(a), len(b))


def test_clashing_set_names(spark):
    """Names of five bits: most sets clash and are told apart by the rest."""
    rng = random.Random(5)
    docs = list(zip(rng.sample(range(10_000), 400), family(rng), strict=False))
    assert by_id(J.components(spark.createDataFrame(docs, DOCS).repartition(3), bits=5)) == brute(docs)


def test_words_built_to_collide(spark):
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    a, b = ("x" * 8 + "".join("ab"[k ^ swap] for k in bits) + "x" * 8 for swap in (0, 1))
    docs = [(1, f"{a} w x y z"), (2, f"{b} w x y z"), (3, f"{a} w x y z {b} w x y z")]
    assert by_id(J.query(spark.createDataFrame(docs, DOCS))) == brute(docs)


def list_rows(rng, n, groups, span):
    """Rows of ``list_pairs`` with random sizes and places."""
    size = rng.integers(span // 4, span, n)
    group = rng.integers(0, groups, n)
    pos = (rng.random(n) * np.array([J.prefix_size(int(s)) for s in size])).astype(np.int64)
    order = np.lexsort([pos, size, group])
    rows = np.column_stack([group, rng.integers(0, 2, n), np.arange(n), size, pos, rng.integers(0, n // 2, n), np.full(n, 10**6), np.full(n, span // 2), np.zeros(n, np.int64)])
    return rows[order]


def test_runs_are_skipped_by_their_headers_and_nothing_is_lost():
    rng = np.random.default_rng(8)
    for n, groups, span in ((1000, 3, 4000), (500, 100, 50), (3000, 1, 100), (5, 5, 30)):
        rows = list_rows(rng, n, groups, span)
        got, skipped = J.list_pairs(rows, np.column_stack([np.zeros(n), np.full(n, 2.0)]))
        want = set()
        for x in range(n):
            i = rows[x]
            y = rows[x + 1:]
            need = J.overlap_needed(i[3], y[:, 3])
            ok = (y[:, 0] == i[0]) & (75 * y[:, 3] <= 100 * i[3]) & (i[4] <= i[3] - need) & (y[:, 4] <= y[:, 3] - need) & (y[:, 5] != i[5])
            want |= {(min(i[2], v), max(i[2], v)) for v in y[ok, 2]}
        assert {tuple(r) for r in got.tolist()} >= want
        assert skipped > 0 or n < 1000


def test_answers_follow_from_the_leaders():
    """No linked pair is ruled out by what is known of its leader."""
    rng = np.random.default_rng(9)
    lost = kept = 0
    for _ in range(60):
        lead = set(rng.choice(4000, int(rng.integers(40, 200)), replace=False).tolist())
        sets = []
        for _ in range(20):
            own = {x for x in lead if rng.random() < rng.uniform(0.6, 1)} | set(rng.choice(4000, int(rng.integers(0, 40))).tolist())
            sets.append(own)
        sets.sort(key=len)
        sim = np.array([[100 * len(s & lead) >= 75 * len(s | lead), len(s & lead) / len(s | lead)] for s in sets], float)
        n = len(sets)
        rows = np.column_stack([np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), [len(s) for s in sets], np.zeros(n, np.int64), np.arange(n),
                                np.full(n, 77), np.full(n, len(lead)), np.zeros(n, np.int64)])
        got = {tuple(r) for r in J.list_pairs(rows, sim)[0].tolist()}
        linked = {(i, j) for i in range(n) for j in range(i + 1, n) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
        assert linked <= got
        lost += n * (n - 1) // 2 - len(got)
        kept += len(got)
    assert lost > 1000


def test_prefix_and_overlap():
    for n in range(1, 200):
        for m in range(1, 200):
            need = int(J.overlap_needed(np.array(n), np.array(m)))
            assert 100 * need >= 75 * (n + m - need) and 100 * (need - 1) < 75 * (n + m - need + 1)
            if need <= min(n, m):
                assert J.prefix_size(n) >= n - need + 1
