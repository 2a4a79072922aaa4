import random
import re
import zlib
from collections import Counter

import pytest

from ioclens.llm import spelling as S

from .helpers import DOCS, SMALL


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [] for w in n}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    for size, own in by_size.items():
        for a in own:
            near[a] += [b for k in (size - 1, size, size + 1) for b in by_size.get(k, ()) if one_edit(a, b)]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in S.query(df).collect())


def planted(rng):
    """Words and variants of them, chains of forms, hot halves, Latin-1."""
    letters = "abcdeéßÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(40)]
    pool = []
    for w in base:
        for k in range(6):
            v = list(w)
            at = rng.randrange(len(v))
            v[at:at + rng.choice((0, 1, 1))] = rng.choice(letters) * rng.randrange(2)
            pool += ["".join(v)] * rng.randrange(1, 30)
        pool += [w] * rng.randrange(3, 60)
    pool += ["shared" + "".join(rng.choice("abcd") for _ in range(4)) for _ in range(900)]
    pool += ["".join(rng.choice("ab") for _ in range(rng.randrange(5, 9))).title() for _ in range(1500)]
    for k in range(7):
        pool += ["chain" + "x" * k] * (3 * 2 ** k)
    rng.shuffle(pool)
    docs = []
    while pool:
        k = rng.randrange(1, 60)
        docs.append((len(docs), rng.choice((" ", "\n", "1", "_")).join(pool[:k])))
        pool = pool[k:]
    return docs


@pytest.mark.parametrize("seed, limit", [(1, 1 << 10), (2, 4)])
def test_planted_variants_match_brute_force(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(S, "PAIRS", limit)
    docs = planted(random.Random(seed)) + [(None, "nobody nobody nobody nobodys nobodys nobodys nobodys nobodys nobodys"), (5, None), (6, ""), (3, "again again again")]
    assert result(spark.createDataFrame(docs, DOCS).repartition(5)) == brute(docs)


def test_whole_table_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert result(spark.createDataFrame(docs, DOCS)) == brute(docs)


def test_ties_long_words_and_bounded_counts(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 2)
    long = "w" * 40_000
    docs = [(1, " ".join(["bread"] * 3 + ["tread"] * 6 + ["dread"] * 6 + [long] * 4 + [long + "x"] * 9)), (2, "no words here 12345")]
    want = brute(docs)
    assert {r[0]: r[1] for r in want}["bread"] == "dread"
    assert result(spark.createDataFrame(docs, DOCS)) == want


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "wording wording wording", 1, "x")], "doc_id long, text string, n int, word string")
    assert len(result(docs)) == 1
    assert result(docs.limit(0)) == []
