import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ioclens.llm import token_align as A
from ioclens.llm.tokens import symbols

from .helpers import DOCS, SMALL

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Brute:
    """The contract in plain Python over the libraries' own ids."""

    def __init__(self):
        self.lib = Tokenizer.from_file(PATH_A)
        self.lib.encode_special_tokens = True
        self.sp = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
        self.byte = {s: b for b, s in enumerate(symbols())}

    def a(self, i):
        return bytes([self.byte[c] for c in self.lib.id_to_token(i)])

    def b(self, i):
        name = self.sp.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if name.startswith("<0x") and len(name) == 6 else name.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        raw = (" " + text).encode()
        sides = []
        for ids, of in ((self.lib.encode(" " + text, add_special_tokens=False).ids, self.a), (self.sp.encode(text), self.b)):
            at, out = 0, []
            for i in ids:
                at += len(of(i))
                out.append((i, at))
            if b"".join(of(i) for i in ids) != raw:
                return []
            sides.append(out)
        cuts = sorted({e for _, e in sides[0]} & {e for _, e in sides[1]})
        where = {c: k for k, c in enumerate(cuts)}
        out = [([], []) for _ in cuts]
        for k, side in enumerate(sides):
            at = 0
            for i, e in side:
                out[at][k].append(i)
                at = where.get(e, at - 1) + 1
        return out

    def table(self, docs):
        made = [self.groups(t) for _, t in docs]
        pairs = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for g in made]
        count = Counter(p for own in pairs for p in own)
        top = {}
        for (a, _), n in count.items():
            top[a] = max(top.get(a, 0), n)
        out = []
        for (i, _), g, own in zip(docs, made, pairs, strict=True):
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()), sum(n for p, n in own.items() if count[p] == top[p[0]]),
                        sum(n * count[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
        return sorted(out, key=str)


@pytest.fixture(scope="module")
def brute():
    return Brute()


def result(df):
    return sorted((tuple(r) for r in A.query(df, PATH_A, PATH_B).collect()), key=str)


TEXTS = ["", None, " ", "a", "  two  spaces ", "line\nbreak\tand tab", "▁ is not a space", "a▁b", "日本語 한국어 😀", "naïve façade", "aaaaaaaaaaaaaaaaaaaaaaaa" * 40, "<s> </s> <unk> <|endoftext|> <0x0A>",
         "the same text", "the same text", " nbsp　wide", "x" * 3, "0123456789" * 30, "\x00nul", "é combining ﬁ ligature Ａ", "trailing   "]


@pytest.mark.parametrize("heavy", [1 << 17, 4])
def test_contract_matches_brute_force(spark, brute, monkeypatch, heavy):
    monkeypatch.setattr(A, "HEAVY", heavy)
    rng = random.Random(2)
    letters = " \nabcdeXYZ019.,;'-éßжλ字😀▁<>"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(80)]
    docs = list(enumerate(texts)) + [(None, "null id"), (3, "a repeated id")]
    assert result(spark.createDataFrame(docs, DOCS).repartition(4)) == brute.table(docs)


def test_whole_table_matches_brute_force(spark, brute):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert result(spark.createDataFrame(docs, DOCS)) == brute.table(docs)


def test_long_text(brute):
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abcdefgh ") for _ in range(9)) for _ in range(20_000)) + "a" * 50_000
    got = A.aligner(PATH_A, PATH_B).align([None, text, "", "b"])
    g = brute.groups(text)
    assert got[1][:4] == (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(len(x) * len(y) for x, y in g))
    assert got[0][:5] == got[2][:5] == (0, 0, 0, 0, "") and got[3][0] == 1


def test_labels_by_pointer_jumping():
    """Random cuts of one line; a chain without common ends; single tokens."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        size = int(rng.integers(1, 200))
        a, b = (np.unique(np.r_[rng.integers(1, size + 1, rng.integers(1, 80)), size]) for _ in range(2))
        common = np.intersect1d(a, b)
        ga, gb = A.labels(a, b)
        assert (ga == np.searchsorted(common, a)).all() and (gb == np.searchsorted(common, b)).all()
    chain = np.arange(1, 40_001)
    ga, gb = A.labels(np.r_[2 * chain, 80_001], np.r_[2 * chain - 1, 80_001])
    assert not ga.any() and not gb.any()


def test_wide_groups_expand_in_slices(monkeypatch):
    monkeypatch.setattr(A, "EXPAND", 7)
    rng = np.random.default_rng(1)
    ga, gb = np.sort(np.r_[np.arange(9), rng.integers(0, 9, 60)]), np.sort(np.r_[np.arange(9), rng.integers(0, 9, 60)])
    a, b = rng.integers(0, 5, len(ga)), rng.integers(0, 5, len(gb))
    want = Counter((g, x, y) for g, x in zip(ga, a, strict=True) for h, y in zip(gb, b, strict=True) if g == h)
    got = Counter()
    for part in A.links(ga, a, gb, b):
        for g, x, y, t in zip(*part, strict=True):
            got[g, x, y] += int(t)
    assert got == want


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text", 5, "x")], "doc_id long, text string, row int, pairs string")
    assert len(result(docs)) == 1
    assert result(docs.limit(0)) == []


def flat(rows):
    return [(*r[:5], list(map(int, r[5])), list(map(int, r[6]))) for r in rows]


def test_repeated_chunks_are_encoded_once(monkeypatch):
    """Both libraries see a word once a worker, not once an occurrence."""
    own, seen = A.Aligner(PATH_A, PATH_B), []
    for side in (own.a, own.b):
        monkeypatch.setattr(side, "ids", lambda text, ids=side.ids: seen.append(len(text)) or ids(text))
    words = [f"word{k}x" for k in range(50)]
    first = flat(own.align([" ".join(words * 40)] * 3))
    assert sum(seen) < 4 * len(" ".join(words))
    before = len(seen)
    assert flat(own.align([" ".join(words * 40)])) == first[:1] and len(seen) == before


@pytest.mark.parametrize(("most", "chars"), [(1 << 18, 1 << 22), (8, 1 << 22), (1 << 18, 40)])
def test_cuts_change_no_result(brute, monkeypatch, most, chars):
    """Texts in chunks, with tables of chunks that overflow, against whole
    texts and the libraries; white space of all kinds around the spaces."""
    monkeypatch.setattr(A, "CHUNKS", most)
    monkeypatch.setattr(A, "CHARS", chars)
    rng = random.Random(5)
    parts = ["a", "the", "don't", "it's,", "été", "12", "...", "▁", "日本", "字", "\x00", "\U0001f600", "<|endoftext|>", "<0x0A>", "ß", " ", " ", " ", " ", "  ", "\n", "\t", "\r\n",
             "\x1c", "\x85", "\xa0", "　", " ", "᠎", "​", "﻿"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    cut, whole = A.Aligner(PATH_A, PATH_B), A.Aligner(PATH_A, PATH_B)
    monkeypatch.setattr(whole.b, "apart", False)
    assert whole.cut("a b") == ["a b"] and cut.cut("a b") == ["a", "b"]
    for k in range(0, len(texts), 70):
        got = flat(cut.align(texts[k:k + 70]))
        assert got == flat(whole.align(texts[k:k + 70]))
        for text, row in zip(texts[k:k + 70], got, strict=True):
            spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in brute.groups(text))
            assert row[4] == (hashlib.sha256(spelt.encode()).hexdigest() if spelt else "")
        assert len(cut.chunks) <= most and cut.chunks.chars <= chars
        assert len(cut.chunks) == cut.chunks.counts.n == len(cut.chunks.spelt)


def test_no_piece_crosses_a_cut(brute):
    assert A.aligner(PATH_A, PATH_B).b.apart
    assert not any("▁" in brute.sp.id_to_piece(i).lstrip("▁") for i in range(brute.sp.get_piece_size()))
