"""Fixtures shared by the corpus operator tests."""

import public_tokenizers

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"
WIDE = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return [tuple(r) for r in df.collect()]


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}
