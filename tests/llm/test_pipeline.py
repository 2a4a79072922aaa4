

import re

import __spark_entry__ as entry
import corpus_pipeline as P
from ioclens.llm import quality_rules as Q
from ioclens.llm import site_classifier as S

from .helpers import SMALL, VOCABULARY
from .test_jaccard_join import brute as components
from .test_line_dedup import key


def drop_lines(docs):
    where = {}
    for i, t in docs:
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                where.setdefault(key(line), set()).add(i)
    return [(i, "\n".join(x for x in t.split("\n") if len(where.get(key(x), ())) < 2 or min(where[key(x)]) == i)) for i, t in docs]


def test_pipeline_matches_brute_force(spark):
    """The stages replayed in Python on what the rules and the classifier keep."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = P.keep_by_classifier(spark, P.keep_by_rules(spark, docs, SMALL), SMALL)
    assert kept.columns == docs.columns
    by_rules = {r.doc_id for r in Q.query(docs).where("kept").collect()}
    ruled = docs.where(docs.doc_id.isin(list(by_rules)))
    by_model = {r.doc_id for r in S.query(ruled, labels).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert {i for i, _ in rows} == by_model <= by_rules
    lines = drop_lines(rows)
    groups = components(lines)
    last = {i: t for i, t in lines if groups[i][1] == i}
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(VOCABULARY)
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in last.items()}
    out = P.run(spark, SMALL).collect()
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    fill = {}
    for r in out:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_registered():
    names = list(entry.queries())
    assert [n.split("_")[0] for n in names if re.match(r"op\d+_", n)] == [f"op{k}" for k in range(1, 14)] and "pipeline" in names
    assert {"op2_quote_links", "op3_warc_normalizer", "op4_line_dedup", "op5_jaccard_join", "op7_quality_rules"} <= set(entry.oracle_sql())
    assert [n for n, _ in P.STAGES] == ["quality rules", "quality classifier", "line dedup", "n-gram Jaccard join", "best-fit packing"]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        columns, docs = docs.columns, stage(spark, docs, SMALL)
        assert docs.count() == 0
        if "text" in docs.columns:
            assert docs.columns == columns
