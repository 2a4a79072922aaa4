"""Token operators: encoder, store, packing, streaming transducer."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ioclens.llm import bpe_stream, packing, token_store, tokens
from ioclens.llm.tokens import chunks, encoder

from .helpers import DOCS, SMALL, VOCABULARY

TEXTS = [None, "", "  \n", "Hello, World! it's 1234 ½", "ÉtÉ é ǅ İ ΟΣ ΟΣ.", "tab\tand\x1cunit\x1fsep\x00nul", "a b c　d\u0085e",
         "<|endoftext|>", "X<|endoftext|>y <|startoftext|>Z <|ENDOFTEXT|> <|", "\U0001f600‍\U0001f525 日本語 한국어", "don't 'S 'RE x''ll", "ᴬＡK",
         "a" * 5000, "abc" * 3000 + "!" * 3000, "é" * 2000, "0123456789" * 300]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def corpus(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_is_the_library(library, spark):
    enc = encoder(VOCABULARY)
    texts = TEXTS + [t for _, t in corpus(spark)]
    for _ in range(2):
        assert [x.tolist() for x in enc.encode_all(texts)] == [expected(library, t) for t in texts]
    assert list(enc.encode_all([])) == []


def test_chunk_table_fills_merges_and_starts_anew(library, spark, monkeypatch):
    monkeypatch.setattr(tokens, "RECENT", 50)
    enc = tokens.ChunkEncoder(VOCABULARY)
    table = tokens.ChunkTable(enc.ids, enc.kind, most=700)
    texts = [t for _, t in corpus(spark)]
    for _ in range(2):
        for at in range(0, len(texts), 7):
            assert [x.tolist() for x in table.texts(texts[at:at + 7])] == [expected(library, t) for t in texts[at:at + 7]]
            assert len(table.keys) <= 700


def test_transducer_is_the_library(library):
    rng = random.Random(5)
    t, coder = bpe_stream.Transducer(VOCABULARY), bpe_stream.coder(VOCABULARY)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "inthareo", "ab", "éü日a", "!?.,"):
        for size in (1, 2, 5, 30, 70, 600, 3000):
            word = "".join(rng.choice(alphabet) for _ in range(size))
            want = expected(library, word)
            assert [i for c in chunks(word) for i in coder.ids(c)] == want
            parts = coder.parts(word.encode())
            for buffer in (1, 17):
                assert [i for w in parts for i in t.encode([*w[:-1], w[-1] + t.suffix], buffer)] == want


def test_transducer_holds_bounded_memory():
    t, word = bpe_stream.Transducer(VOCABULARY), "thereinanonerthest" * 5000
    taken = 0

    def symbols():
        nonlocal taken
        for taken, c in enumerate(word, 1):
            yield c

    out = t.encode(symbols(), buffer=64)
    sizes = {i: len(s) for s, i in t.vocab.items()}
    given = 0
    for k, i in enumerate(out):
        given += sizes[i]
        assert taken - given <= 64 + t.lookahead + 20 or taken == len(word)
        if k > 2000:
            break


@pytest.mark.parametrize("text, want", [
    ("Café naïve \U0001f600", "café naïve \U0001f600 "), ("plain words here", "plain words here "), ("a<|endoftext|>b", "a <|endoftext|>b "), ("", "")])
def test_decoder_is_incremental(library, text, want):
    d = bpe_stream.Decoder(bpe_stream.Transducer(VOCABULARY))
    assert "".join(d.feed([i]) for i in expected(library, text)) + d.end() == want


def test_decoder_holds_unfinished_characters():
    t = bpe_stream.Transducer(VOCABULARY)
    d, ids = bpe_stream.Decoder(t), [t.vocab[s] for s in ("Ã", "©</w>", "Ã")]
    assert [d.feed([i]) for i in ids] + [d.end()] == ["", "é ", "", "\ufffd"]


def test_digests_of_texts(spark, library):
    docs = list(enumerate(TEXTS)) + [(1000 + i, t) for i, t in corpus(spark)] + [(None, "no id"), (3, TEXTS[3])]
    out = bpe_stream.query(spark.createDataFrame(docs, DOCS), VOCABULARY).collect()
    assert len(out) == len(docs)
    text = dict(docs)
    for r in out:
        ids = expected(library, text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_store_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_KEYS", 64)
    docs = [(100 + i, t) for i, t in enumerate(TEXTS)] + [(1000 + i, t) for i, t in corpus(spark)]
    random.Random(1).shuffle(docs)
    out = {r.doc_id: r for r in token_store.query(spark.createDataFrame(docs, DOCS), VOCABULARY).collect()}
    start = 0
    for doc_id, text in sorted(docs):
        ids = expected(library, text) + [2]
        assert (out[doc_id].start, out[doc_id].n_tokens, out[doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(out) == len(docs)


def test_store_unknown_keys_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b c"), (None, "d"), (2, None)], "doc_id long, text string")
    store = token_store.write(docs, VOCABULARY, 2)
    assert token_store.read(store, store.entries).count() == 4
    asked = spark.createDataFrame([(i, 0) for i in range(3, 500)] + [(2, 0)], "doc_id long, copy long")
    assert [r.doc_id for r in token_store.locate(store, asked).collect()] == [2]
    assert token_store.query(docs.limit(0), VOCABULARY).count() == 0


def pieces_of(library, docs, capacity):
    out = {}
    for doc_id, text in docs:
        ids = expected(library, text) + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at:at + capacity]
            out[doc_id, k] = (at, len(own), crc(own))
    return out


@pytest.mark.parametrize("capacity, block", [(2048, 1 << 15), (300, 40)])
def test_packing_holds_every_piece_once(spark, library, monkeypatch, capacity, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    docs = [(100 + i, t) for i, t in enumerate(TEXTS)] + [(1000 + i, t) for i, t in corpus(spark)]
    out = packing.query(spark.createDataFrame(docs, DOCS), VOCABULARY, capacity).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == pieces_of(library, docs, capacity)
    assert len(out) == len(pieces_of(library, docs, capacity))
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    need = -(-sum(r.length for r in out) // capacity)
    assert len(sequences) <= need * 1.02 + 2


def test_packing_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], DOCS)
    assert packing.query(docs, VOCABULARY).count() == 3
    assert packing.query(docs.limit(0), VOCABULARY).count() == 0


def test_local_search_empties_bins():
    # best fit decreasing needs three bins; moving and exchanging needs two
    size = [6, 5, 3, 3, 2, 1]
    bins = packing.local_search([[0, 4], [1, 2], [3, 5]], size, 10)
    assert sorted(i for b in bins for i in b) == list(range(6)) and len(bins) == 2
    rng = random.Random(2)
    for _ in range(40):
        size = sorted((rng.randint(1, 60) for _ in range(80)), reverse=True)
        before = packing.best_fit(size, 100)
        after = packing.local_search([list(b) for b in before], size, 100)
        assert sorted(i for b in after for i in b) == list(range(80)) and len(after) <= len(before)
        assert all(packing.capacity_of(b, size) <= 100 for b in after)


def test_one_for_one_exchange():
    size = [7, 6, 5, 4, 4, 3]
    bins = packing.local_search([[0, 5], [1, 4], [2, 3]], size, 10)
    assert sorted(i for b in bins for i in b) == list(range(6))


def thue_morse(swap):
    """Two texts whose polynomial hashes modulo 2**64 agree, ends included."""
    word = [bin(i).count("1") & 1 for i in range(2048)]
    return "x" * 8 + "".join("ab"[b ^ swap] for b in word) + "x" * 8


def test_chunks_built_to_collide(spark, library):
    docs = [(0, thue_morse(0)), (1, thue_morse(1)), (2, thue_morse(0) + " " + thue_morse(1))]
    df = spark.createDataFrame(docs, DOCS).coalesce(1)
    want = {i: expected(library, t) for i, t in docs}
    assert want[0] != want[1]
    for r in bpe_stream.query(df, VOCABULARY).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest()
    for r in packing.query(df, VOCABULARY).where("piece = 0").collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*want[r.doc_id], 0][:2048], "<u4").tobytes())
    for r in token_store.query(df, VOCABULARY).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*want[r.doc_id], 2], "<u4").tobytes())


def test_spaced_decoder_goes_piece_by_piece(library):
    t = bpe_stream.Transducer(VOCABULARY)
    ids = expected(library, "some text, 123 été <|endoftext|>")
    d = bpe_stream.Decoder(t, spaced=True)
    assert t.spaced and d.feed([]) == "" and "".join(d.feed([i]) for i in ids) + d.feed([]) + d.end() == library.decode(ids, skip_special_tokens=False)


def test_many_equal_rows_without_ids_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 16)
    out = packing.query(spark.createDataFrame([(None, "one two three")] * 3000, DOCS).repartition(2), VOCABULARY, 64).collect()
    fill = {}
    for r in out:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(out) == 3000
    for parts in fill.values():
        assert sorted(o for o, _ in parts) == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text", 5, "x", 7)], DOCS + ", row int, piece string, length int")
    for q in (bpe_stream.query, packing.query, token_store.query):
        assert q(docs, VOCABULARY).count() == 1
