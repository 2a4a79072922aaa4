import hashlib

import numpy as np
import pytest

from ioclens.llm import line_dedup as L
from ioclens.llm.mph import Mph, pack, unpack

from .helpers import DOCS, SMALL, by_id

SPACE = " \t\n\v\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(docs):
    where = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                where.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(where.get(key(x), ())) < 2 or min(where[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_small_cases(spark):
    docs = [(5, "  Same LINE here\nother text one"), (2, "same line here\t\nown own own own"), (9, "Same line here"), (1, None), (3, ""), (4, "tiny\ntiny"), (6, "tiny"),
            (7, "ééééééééé"), (8, "ééééééééé"),
            (10, "é" * 10), (11, "É" * 10), (12, "é" * 10 + "\n" + "é" * 10), (13, "x" * 300_000 + "\nSame line here"), (14, "\n\n")]
    assert by_id(L.query(spark.createDataFrame(docs, DOCS))) == brute(docs)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = by_id(L.query(spark.createDataFrame(docs, DOCS)))
    assert got == brute(docs)
    assert any(d for _, d, _ in got.values())


def test_hot_line_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 8)
    docs = [(i, f"the very common line\nline of pair {i // 2} and more\nown line number {i}") for i in range(1500)]
    assert by_id(L.query(spark.createDataFrame(docs, DOCS))) == brute(docs)


def test_nulls_repeats_clashes_and_empty(spark):
    schema = "doc_id long, text string, hi string, n_chars long"
    docs = spark.createDataFrame([(1, "a line of ten or more", "h", 1), (1, "a line of ten or more", "h", 1), (None, "a line of ten or more\nsome more text", None, None), (None, None, "z", 0)], schema)
    out = L.stage(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "a line of ten or more", "h", 21), (1, "a line of ten or more", "h", 21), (None, "some more text", None, 14), (None, "", "z", 0)], key=str)
    assert L.query(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    mph = Mph.build(keys)
    at = mph.index(keys)
    assert sorted(at.tolist()) == list(range(len(keys)))
    order = np.argsort(at)
    again, prints = unpack(pack(mph.to_bytes(), keys[order]), "<u8")
    assert (prints[again.index(keys)] == keys).all() if n else again.n == 0
    others = np.random.default_rng(n + 1).integers(0, 2**64, 1000, dtype=np.uint64)
    found = again.index(others)
    assert ((found >= -1) & (found < max(1, len(keys)))).all()
    if n:
        assert not ((found >= 0) & (prints[found] == others)).any()
    with pytest.raises(ValueError):
        Mph.build(np.array([7, 7], np.uint64))
