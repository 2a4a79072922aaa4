import re
from collections import Counter

from ioclens.llm import quality_rules as Q

from .helpers import DOCS, SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    full = [x for x in t.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_measures_match_brute_force(spark):
    words = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x x x x", "é ü ö", words, words + "\n" + words, "a b\n\na b\n a b", "# * $ %%% & | < >",
             "loop " * 20_000, " ".join(f"v{i % 9000}" for i in range(20_000))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "a")], DOCS)
    out = Q.query(got).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        text = texts[r.doc_id] if r.doc_id is not None else "no id"
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), r.doc_id


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in Q.query(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_policies_and_ablation(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ledger = Q.ledger(docs).cache()
    bits = [r.fail_bits for r in ledger.collect()]
    for version in Q.POLICIES:
        kept = Q.apply_policy(ledger, version).where("kept").count()
        mask = Q.policy_mask(version)
        assert kept == sum(not b & mask for b in bits)
        out = {r.rule: (r.n_failed, r.n_only) for r in Q.ablation(ledger, version).collect()}
        for rule in Q.RULES:
            if rule.name in Q.POLICIES[version]:
                bit = 1 << rule.bit
                assert out[rule.name] == (sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits))


def test_stage_keeps_columns_even_if_they_clash(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "x", 7), (2, "short", "y", 8)], "doc_id long, text string, fail_bits string, n_words int")
    out = Q.stage(docs)
    assert out.columns == docs.columns
    assert [tuple(r) for r in out.collect()] == [(1, text, "x", 7)]
    assert Q.stage(docs.limit(0)).count() == 0
    assert Q.query(docs.limit(0)).count() == 0


def test_main_path_is_native(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = Q.stage(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
