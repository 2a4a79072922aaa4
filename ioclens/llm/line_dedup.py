"""Line dedup: a sharded minimal perfect hash over the distinct hashes of
repeated lines indexes fingerprint, count and first-document arrays.  The
documents send their line hashes to the shards and probe the arrays; lines
are never joined.

A line's key is the line stripped of white space at both ends with A-Z
lower-cased.  Keys of at least ``MIN_POINTS`` code points found in at least
two documents lose all their lines except in the smallest doc_id holding
them.

Plan: (1) 128-bit key hashes, distinct within each document, are counted by
hash with map-side combining, so a line that a third of all documents share
costs one row a task.  (2) Repeated keys are spread over shards by hash; each
shard builds its hash and arrays (about SHARD_KEYS keys).  (3) Hashes of all
lines go to their shard, SHARD_PROBES at most on average, and are answered
there.  The few lines that each hold 1/HEAVY of all repeated occurrences (so
at most HEAVY of them) are probed from a small index in every task instead,
so no shard is hot.  (4) Answers return to the documents by doc_id.

Defined results: a null or empty text is one empty line, never dropped; rows
that share a doc_id count as one document; a null doc_id stands for an id
above 2**62 made from the text's hash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .mph import Mph, pack, unpack

MIN_POINTS = 10
SHARD_KEYS = 1 << 17
SHARD_PROBES = 1 << 19
HEAVY = 256
SPACE = b" \t\n\v\f\r"
NO_ID = 2**62


def line_digests(text: bytes) -> list[bytes | None]:
    """The 128-bit key hash of each line; None for short keys."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):
        key = line.strip(SPACE)
        long_enough = len(key) >= 4 * MIN_POINTS or len(key) >= MIN_POINTS and len(key.decode("utf-8", "replace")) >= MIN_POINTS
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
    return both[:, 0], both[:, 1]


def _line_rows(batches: Iterator[pa.RecordBatch], skip: frozenset[bytes] = frozenset()) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests: list[bytes] = []
        sizes = []
        for text in batch["text"].to_pylist():
            own = {d for d in line_digests(text) if d is not None and d not in skip}
            digests += own
            sizes.append(len(own))
        hi, lo = _halves(digests)
        ids = np.repeat(batch["doc_id"].to_numpy(zero_copy_only=False), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(ids.astype(np.int64))], names=["hi", "lo", "doc_id"])


def _key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID).bitwiseOR(F.shiftrightunsigned(F.xxhash64(text), 2)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(_key(F.col("doc_id"), F.col("text")).alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


KEY_SCHEMA = "hi long, lo long, doc_id long"


def repeated_keys(texts: DataFrame) -> tuple[DataFrame, int]:
    """(hi, lo, first_doc, n_docs) of keys in two or more documents, stored;
    the number of keys counted once a document.  Keys of one document fold
    into a row without a name, which carries their number."""
    keys = texts.mapInArrow(_line_rows, KEY_SCHEMA).groupBy("hi", "lo").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("n_docs"))
    name = [F.when(F.col("first_doc") < F.col("last_doc"), F.col(c)).alias(c) for c in ("hi", "lo")]
    folded = keys.select(*name, "first_doc", "n_docs").groupBy("hi", "lo").agg(F.min("first_doc").alias("first_doc"), F.sum("n_docs").alias("n_docs"))
    folded = stored(folded, "line-keys")
    total = folded.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    return folded.where("hi IS NOT NULL"), total


def _shard_index(group: pa.Table) -> pa.Table:
    hi = group["hi"].to_numpy().view(np.uint64)
    mph = Mph.build(hi)
    order = np.argsort(mph.index(hi))
    arrays = [group[c].to_numpy()[order] for c in ("lo", "n_docs", "first_doc")]
    return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "arrays": pa.array([pack(mph.to_bytes(), *arrays)], pa.binary())})


def _probe(probes: pa.Table, index: pa.Table) -> pa.Table:
    if not probes.num_rows or not index.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "lo": pa.array([], pa.int64())})
    mph, prints, _, first = unpack(index["arrays"][0].as_py(), "<i8", "<i8", "<i8")
    lo, ids = probes["lo"].to_numpy(), probes["doc_id"].to_numpy()
    at = mph.index(probes["hi"].to_numpy().view(np.uint64))
    drop = (at >= 0) & (prints[at] == lo) & (first[at] != ids)
    return pa.table({"doc_id": ids[drop], "lo": lo[drop]})


def _digest(hi: int, lo: int) -> bytes:
    return np.array([hi, lo], ">i8").tobytes()


def dedup(docs: DataFrame) -> DataFrame:
    """(doc, text, n_lines, n_dropped): the input row as a struct, its kept
    text, its lines before dropping and how many were dropped."""
    texts = _texts(docs)
    keys, n_probes = repeated_keys(texts)
    sums = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    n_keys, n_found = sums
    # at most HEAVY lines can each hold that share, so this list is bounded
    heavy = {_digest(r.hi, r.lo): r.first_doc for r in keys.where(F.col("n_docs") > max(1000, n_found // HEAVY)).collect()}
    shards = max(1, -(-n_keys // SHARD_KEYS), -(-n_probes // SHARD_PROBES))
    shard = F.pmod(F.col("hi"), F.lit(shards)).cast("int").alias("shard")
    index = stored(keys.select(shard, "hi", "lo", "n_docs", "first_doc").groupBy("shard").applyInArrow(_shard_index, "shard int, arrays binary"), "line-index")
    skip = frozenset(heavy)
    probes = texts.mapInArrow(lambda b: _line_rows(b, skip), KEY_SCHEMA).select(shard, "hi", "lo", "doc_id")
    answers = probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, "doc_id long, lo long")
    answers = answers.groupBy("doc_id").agg(F.collect_set("lo").alias("drop"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.withColumn("doc_id", _key(F.col("doc")["doc_id"], F.col("doc")["text"]))
    rows = rows.join(answers, "doc_id", "left").withColumn("text", F.coalesce(F.col("doc")["text"], F.lit("")).cast("binary"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, dropped = [], [], []
            for doc_id, text, drop in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["drop"].to_pylist(), strict=True):
                own = text.split(b"\n")
                n = len(own)
                if drop or heavy:
                    gone = set(drop or ())
                    out = []
                    for line, d in zip(own, line_digests(text), strict=True):
                        if d is None or not (heavy.get(d, doc_id) != doc_id or gone and int.from_bytes(d[8:], "big", signed=True) in gone):
                            out.append(line)
                    own = out
                kept.append(b"\n".join(own) if len(own) < n else text)
                lines.append(n)
                dropped.append(n - len(own))
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(kept, pa.binary()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                                             names=["doc", "text", "n_lines", "n_dropped"])

    kind = rows.schema["doc"].dataType.simpleString()
    done = rows.select("doc", "doc_id", "text", "drop").mapInArrow(keep, f"doc {kind}, text binary, n_lines long, n_dropped long")
    return done.withColumn("text", F.col("text").cast("string"))


def query(docs: DataFrame) -> DataFrame:
    d = dedup(docs.select("doc_id", "text"))
    return d.select(F.col("doc")["doc_id"].alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def stage(docs: DataFrame) -> DataFrame:
    """Documents with their kept text; n_chars follows it."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return dedup(docs).select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, coalesce(r.first_doc <> k.doc_id, false) AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
