import random

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from ioclens.llm import byte_bpe as B
from ioclens.llm import token_counts as T

from .helpers import DOCS, SMALL, by_id

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = ["", " ", "  a", "a  b ", "it's we'll I'D", "a b c\u0085d\x1ce", "<|endoftext|>", "x <|endoftext|><|endoftext|> \n y", "<|endoftext|", "日本語のテキスト 한국어", "naïve Ünïcode ÿ",
             "𝒳𝒴 \U0001F600\U0001F468‍\U0001F469", "՘࢏ ₏1", "1234567890 ½ ٣٤", "tab\t\tnew\n\n\nline\r\n", "a" * 5000, "0" * 3000, " " * 4000 + "x", "ab!?" * 900, "é ́", "\x00\x01 z"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark, library):
    rng = random.Random(5)
    texts = ODD_TEXTS + ["".join(rng.choice(" \n\tabcXYZ019.,;'-éßжλ字😀<|>") for _ in range(rng.randrange(300))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000, None), (None, "null id"), (1000, "again")]
    got = sorted((tuple(r) for r in T.query(spark.createDataFrame(rows, DOCS), PATH).collect()), key=str)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted([(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, want, strict=True)], key=str)


def test_whole_table_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = by_id(T.query(docs, PATH))
    for r in docs.collect():
        assert got[r.doc_id][1] == len(library.encode(r.text or "", add_special_tokens=False).ids)


def test_proof_and_shortcut(library):
    whole = B.proven(PATH)
    entries = {t: i for t, i in list(whole.items())[::97]}
    assert all(library.encode(t, add_special_tokens=False).ids == [i] for t, i in entries.items() if T.counter(PATH).bpe.words(t) == [t])
    assert len(whole) > 45_000 and len(whole) < 50_256
    direct, merged = T.counter(PATH).shares("The quick brown fox jumps over the lazy dog; zxqvkw.")
    assert merged == 1 and direct == 11


def test_stable_characters_are_cut_alike(library):
    """Every character of the classes cut here, in several surroundings."""
    pattern, cut = B.PATTERN, library.pre_tokenizer
    stable = regex.compile(f"[{B.STABLE}]")
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and stable.match(chr(c))]
    for k in range(0, len(points), 1000):
        text = "".join(f"a{c}1{c} {c}!{c}{c}b " for c in points[k:k + 1000])
        assert pattern.findall(text) == [text[i:j] for _, (i, j) in cut.pre_tokenize_str(text)]


def test_bounded_table(monkeypatch):
    monkeypatch.setattr(B, "KEPT", 3)
    known = B.Known({"a": 1}, len)
    assert [known[w] for w in ("a", "bb", "ccc", "dddd", "eeeee", "bb")] == [1, 2, 3, 4, 5, 2] and len(known) <= 4
    assert known["x" * 100] == 100 and "x" * 100 not in known


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text", 5, "x")], "doc_id long, text string, n_tokens int, n_bytes string")
    assert by_id(T.query(docs, PATH)) == {1: (9, 2, False)}
    assert T.query(docs.limit(0), PATH).count() == 0
