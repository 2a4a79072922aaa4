"""Token ids as raw payload files with a minimal perfect hash index.

Format.  Payload files hold the ids of documents in ascending doc_id order,
end id included, as little-endian unsigned integers of two bytes (four if the
vocabulary needs them) and nothing else.  The manifest table has a row for
each file: its number, path, ids and the ids before it.  The index table has
a row for each index shard: a minimal perfect hash over its document keys and
arrays in its order (fingerprint, file number, offset, ids, start), so a key
is found in constant time without sorted ids or a search.

Plan: the texts are range-partitioned by doc_id once and encoded and written
where they arrive; a task's file has a name of its own, and only files whose
task succeeded enter the manifest, so a repeated task leaves an orphan at
worst.  What follows moves one short row a document.

A key is (doc_id, copy), copy counting rows of the same doc_id from 0.
Defined results: a null or empty text is its end id alone; null ids come
first; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, shared_file, stored
from .mph import Mph, pack, unpack
from .tokens import encoder

#: Ids of a payload file before the next one begins, and keys of an index shard.
FILE_IDS = 1 << 27
SHARD_KEYS = 1 << 16

ENTRY = "doc_id long, copy long, file long, path string, offset long, n_tokens long"
PLACE = "doc_id long, copy long, file long, offset long, n_tokens long, start long"


@dataclass(frozen=True)
class Store:
    """``entries``: (doc_id, copy) keys; ``manifest``: files; ``index``."""
    entries: DataFrame
    manifest: DataFrame
    index: DataFrame
    shards: int
    kind: str


def _write(path: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, part = encoder(path), TaskContext.get().partitionId()
        out, number, offset, name = None, -1, FILE_IDS, ""
        last: object = run
        copy = 0
        for batch in batches:
            rows = []
            texts = (x.as_py() for x in batch["text"])
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), enc.encode_all(texts), strict=True):
                if offset >= FILE_IDS:
                    if out is not None:
                        out.close()
                    number, offset, name = number + 1, 0, f"{folder}/ids-{part:06d}-{number + 1:03d}-{uuid.uuid4().hex[:8]}.bin"
                    fs, at = shared_file(name)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at)
                ids = np.append(ids, end_id).astype(enc.kind)
                out.write(ids.tobytes())
                copy = copy + 1 if doc_id == last else 0
                last = doc_id
                rows.append((doc_id, copy, part << 20 | number, name, offset, len(ids)))
                offset += len(ids)
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in ENTRY.split(", ")])
        if out is not None:
            out.close()

    return run


def _key() -> list[Column]:
    """Hash that the index is built over, and the fingerprint."""
    return [F.xxhash64("doc_id", "copy").alias("key"), F.xxhash64("copy", F.lit(7), "doc_id").alias("print")]


ARRAYS = ("print", "file", "offset", "n_tokens", "start")


def _index(group: pa.Table) -> pa.Table:
    key = group["key"].to_numpy().view(np.uint64)
    mph = Mph.build(key)
    order = np.argsort(mph.index(key))
    return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()),
                     "arrays": pa.array([pack(mph.to_bytes(), *[group[c].to_numpy()[order] for c in ARRAYS])], pa.binary())})


def write(docs: DataFrame, path: str, end_id: int) -> Store:
    """Encodes and writes all documents; see the module."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    entries = stored(dealt.mapInArrow(_write(path, folder, end_id), ENTRY), "token-entries")
    files = entries.groupBy("file", "path").agg(F.sum("n_tokens").alias("n_ids"))
    # one row a file, so this one ordered sum is over a few rows
    manifest = stored(files.withColumn("before", F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids")), "token-files")
    shards = max(1, -(-entries.count() // SHARD_KEYS))
    placed = entries.join(manifest.select("file", "before"), "file").withColumn("start", F.col("before") + F.col("offset"))
    placed = placed.select(*_key(), "file", "offset", "n_tokens", "start").withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    index = stored(placed.groupBy("shard").applyInArrow(_index, "shard int, arrays binary"), "token-index")
    return Store(entries.select("doc_id", "copy"), manifest, index, shards, encoder(path).kind.str)


def _find(keys: pa.Table, index: pa.Table) -> pa.Table:
    kinds = pa.schema([(x.split()[0], pa.int64()) for x in PLACE.split(", ")])
    if not keys.num_rows or not index.num_rows:
        return kinds.empty_table()
    mph, prints, *arrays = unpack(index["arrays"][0].as_py(), *["<i8"] * 5)
    at = mph.index(keys["key"].to_numpy().view(np.uint64))
    found = (at >= 0) & (prints[at] == keys["print"].to_numpy())
    own = keys.select(["doc_id", "copy"]).filter(pa.array(found))
    for name, a in zip(ARRAYS[1:], arrays, strict=True):
        own = own.append_column(name, pa.array(a[at[found]]))
    return own.cast(kinds)


def locate(store: Store, keys: DataFrame) -> DataFrame:
    """PLACE of each (doc_id, copy) that the index holds: one probe a key."""
    asked = keys.select("doc_id", "copy", *_key()).withColumn("shard", F.pmod("key", F.lit(store.shards)).cast("int"))
    return asked.groupBy("shard").cogroup(store.index.groupBy("shard")).applyInArrow(_find, PLACE)


def read(store: Store, keys: DataFrame) -> DataFrame:
    """PLACE and ``ids`` (the raw payload bytes) of each key found; each task
    reads a range of places in file order."""
    kind = np.dtype(store.kind)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, ids = batch.slice(at, 512), []
                for path, offset, n in zip(*(part[c].to_pylist() for c in ("path", "offset", "n_tokens")), strict=True):
                    if path != name:
                        fs, where = shared_file(path)
                        name, file = path, fs.open_input_file(where)
                    ids.append(file.read_at(n * kind.itemsize, offset * kind.itemsize))
                cols = [part[c] for c in ("doc_id", "copy", "file", "offset", "n_tokens", "start")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary())], names=[x.split()[0] for x in PLACE.split(", ")] + ["ids"])

    at = locate(store, keys).join(store.manifest.select("file", "path"), "file")
    at = at.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return at.select("doc_id", "copy", "file", "path", "offset", "n_tokens", "start").mapInArrow(fetch, PLACE + ", ids binary")


def digests(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows of ``read``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    store = write(docs, path, end_id)
    return digests(read(store, store.entries), store.kind)
