"""Token counts by the whole-token shortcut.

Which vocabulary entries encode alone as one token is proven once a worker
from the vocabulary alone (``ByteBpe.whole_tokens``): the entry's bytes are
merged, and the proof holds if they end as that one entry.  A text is cut
into pre-tokens; one that spells a proven entry counts 1 without merging, and
only the rest is merged, once per distinct short pre-token a worker.  Special
tokens spelt in a text count 1 each, as the library takes them by default.

One narrow pass: no shuffle, no state between documents but the bounded table
of merged pre-tokens.

Defined results: a null or empty text has no bytes and no tokens; every input
row gives a row, whatever its id; an empty table gives an empty result; only
``doc_id`` and ``text`` are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Known, byte_bpe, proven

LIMIT = 1024
COUNTED = "doc_id long, n_bytes long, n_tokens long"


class Counter:
    """``count``: tokens of a text; ``direct`` and ``merged`` say how many
    pre-tokens were settled by the proof and how many by merging."""

    def __init__(self, path: str):
        self.bpe, self.whole = byte_bpe(path, True), proven(path)
        self.cost = Known(dict.fromkeys(self.whole, 1), lambda w: len(self.bpe.merged(w)))

    def count(self, text: str | None) -> int:
        words, specials = self.bpe.parts(text or "")
        return sum(map(self.cost.__getitem__, words)) + specials

    def shares(self, text: str) -> tuple[int, int]:
        """(pre-tokens counted directly, pre-tokens merged)."""
        words, _ = self.bpe.parts(text)
        direct = sum(w in self.whole for w in words)
        return direct, len(words) - direct


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            tokens = pa.array([count(t.as_py()) for t in batch["text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], tokens], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size, "text").mapInArrow(run, COUNTED)


def query(docs: DataFrame, path: str) -> DataFrame:
    return count_tokens(docs, path).withColumn("over_limit", F.col("n_tokens") > LIMIT)
