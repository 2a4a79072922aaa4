"""Quality classifier: document evidence combined with host and path
posteriors by hierarchical empirical Bayes.

Document model.  A logistic regression on whether a text has certain words or
word beginnings and on a few character shares, fitted to at most TRAIN_ROWS
labelled documents (chosen by a hash of the id).  Features are those whose
frequencies in good and bad documents differ by Z_LEAST standard errors, at
most FEATURES.  A document is good if its quality label is 1 and it is not
labelled toxic.

Sites.  Over all documents, the model's probabilities are summed by (host,
path) with map-side combining.  Beta priors are fitted to the sums by moments:
hosts around the global mean, paths around their host.  A host's posterior
mean is (its sum + k * global mean) / (its documents + k), a path's likewise
around its host, so a site of few documents stays near the prior above it.

A document's log-odds are its own evidence (model log-odds less those of the
global mean) plus those of its path's posterior, from which the document
itself is left out of both sums, so its evidence counts once; it is kept from
KEEP_FROM on, as losing a good document costs more than keeping a bad one.

Here the host of a document is its ``source`` and the path its ``lang``.

Defined results: a null text has no words; null hosts and paths are sites of
their own; labels that are null, or lack one class, teach nothing (then all
is kept); labels that repeat an id count once, as the worst; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .mph import mix
from .shingles import INVERSE, RADIX, STEP, VALUE, powers

TRAIN_ROWS = 10_000
FEATURES = 512
Z_LEAST = 5.0
DF_LEAST = 10
BEGIN = 6  # bytes of a word's beginning
SALTS = 16
KEEP_FROM = -1.0

_byte = np.arange(256)
_letter = (_byte >= 128) | ((_byte | 32) >= 97) & ((_byte | 32) <= 122)
_digit = (_byte >= 48) & (_byte <= 57)
_upper = (_byte >= 65) & (_byte <= 90)
_blank = np.isin(_byte, [32, 9, 10, 11, 12, 13])
_mark = ~(_letter | _digit | _blank)
_edge = ~_letter
_sign = np.isin(_byte, list(b"#*$%&|<>!"))
DENSE = ("upper", "digits", "marks", "signs", "repeats", "word_length", "lines")


@dataclass(frozen=True)
class Model:
    """``keys``: sorted feature hashes; ``weights``: theirs; ``dense``:
    weights of DENSE, over values less ``mean`` divided by ``spread``."""
    keys: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    bias: float


def _features(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature hash) of every word and word beginning, and the
    DENSE values of each text.  Words are runs of letters, A-Z lower-cased."""
    sep = np.array([10], np.uint8)
    data = np.concatenate([x for t in texts for x in (t, sep)])
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    edge = _edge[data]
    turn = np.flatnonzero(edge[1:] != edge[:-1]) + 1
    if not edge[0]:
        turn = np.r_[0, turn]
    first, end = turn[::2], turn[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * powers("up", RADIX, len(data)), out=total[1:])
    down = powers("down", INVERSE, len(data))[first]
    whole = mix((total[end] - total[first]) * down, 101) >> np.uint64(1)
    start = mix((total[np.minimum(end, first + BEGIN)] - total[first]) * down, 102) >> np.uint64(1)
    doc = np.searchsorted(begin, first, "right") - 1
    share = lambda table, n: np.add.reduceat(table[data].astype(np.int32), begin) / np.maximum(n, 1)
    full = np.add.reduceat((~_blank[data]).astype(np.int32), begin)
    words = np.bincount(doc, minlength=len(texts))
    # words that repeat the word before them mark loops
    again = np.bincount(doc[1:][(whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts))
    dense = np.column_stack([share(_upper, full), share(_digit, full), share(_mark, full), share(_sign, full), again / np.maximum(words, 1),
                             np.minimum(full / np.maximum(words, 1), 30) / 30, np.add.reduceat((data == 10).astype(np.int32), begin) / np.maximum(words, 1)])
    return np.r_[doc, doc], np.r_[whole, start].astype(np.int64), np.minimum(dense, 1.0)


def _blocks(column: pa.Array) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for value in column:
        held.append(np.frombuffer((value.as_buffer() if value.is_valid else b"") or b"\n", np.uint8))
        size += len(held[-1])
        if size >= STEP:
            yield held
            held, size = [], 0
    if held:
        yield held


def logits(model: Model, column: pa.Array) -> np.ndarray:
    """Log-odds that each text is good."""
    out = [np.zeros(0)]
    for texts in _blocks(column):
        doc, key, dense = _features(texts)
        score = model.bias + ((dense - model.mean) / model.spread) @ model.dense
        if len(model.keys):
            at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
            hit = model.keys[at] == key
            once = np.unique(doc[hit] * len(model.keys) + at[hit])
            score = score + np.bincount(once // len(model.keys), model.weights[once % len(model.keys)], minlength=len(texts))
        out.append(score)
    return np.concatenate(out)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, good) of at most about ``most`` labelled documents."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    known = known.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    n, scale = known.count(), 1 << 20
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * most / n))
    # about ``most`` rows of two values whatever the corpus, so broadcast is safe
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(known), "doc_id")
    # an id that many rows share teaches once, so what is fitted stays bounded
    return rows.groupBy("doc_id", "good").agg(F.min("text").alias("text")).select("doc_id", "text", "good")


def fit(rows: DataFrame) -> Model:
    """The model of (doc_id, text, good) rows.  Features are counted and
    chosen in Spark; the chosen ones and where they occur reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, values = [], []
                for texts in _blocks(part["text"]):
                    doc, key, dense = _features(texts)
                    values += dense.tolist()
                    order = np.argsort(doc, kind="stable")
                    keys += [np.unique(x) for x in np.split(key[order], np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1])]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["good"], pa.array(keys, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "good", "keys", "dense"])

    seen = stored(rows.mapInArrow(run, "doc_id long, good boolean, keys array<long>, dense array<double>"), "training-features")
    n1, n0 = seen.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    none, width = np.zeros(0), len(DENSE)
    if not n1 or not n0:
        return Model(none.astype(np.int64), none, np.zeros(width), np.zeros(width), np.ones(width), 0.0)
    counts = seen.select("good", F.explode("keys").alias("key")).groupBy("key").agg(F.count_if("good").alias("in1"), F.count(F.lit(1)).alias("n"))
    p = F.col("n") / (n1 + n0)
    z = F.abs(F.col("in1") / n1 - (F.col("n") - F.col("in1")) / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    best = counts.where(F.col("n") >= DF_LEAST).withColumn("z", z).where(F.col("z") >= Z_LEAST).orderBy(F.desc("z"), "key").limit(FEATURES)
    keys = np.sort(np.array([r.key for r in best.collect()], np.int64))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.searchsorted(keys, np.intersect1d(k, keys)).tolist() for k in batch["keys"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["good"], pa.array(own, pa.list_(pa.int32())), batch["dense"]], names=["doc_id", "good", "has", "dense"])

    got = seen.mapInArrow(pick, "doc_id long, good boolean, has array<int>, dense array<double>").orderBy("doc_id").toArrow()
    dense = np.array(got["dense"].to_pylist())
    mean, spread = dense.mean(0), np.maximum(dense.std(0), 1e-6)
    x = np.zeros((got.num_rows, len(keys) + width), np.float32)
    for k, own in enumerate(got["has"].to_pylist()):
        x[k, own] = 1
    x[:, len(keys):] = (dense - mean) / spread
    w, bias = regress(x, np.array(got["good"].to_pylist(), np.float32))
    return Model(keys, w[:len(keys)].astype(np.float64), w[len(keys):].astype(np.float64), mean, spread, float(bias))


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    penalty = np.full(x.shape[1], ridge, np.float32)
    penalty[-1] = 0
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        top = float(np.linalg.norm(v))
        v /= top
    rate = 1 / (top / 4 + ridge)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - rate * (x.T @ (p - y) + penalty * ahead)
        ahead, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def _site(name: str, docs: DataFrame) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) if name in docs.columns else F.lit("").alias(name)


def scored(docs: DataFrame, model: Model, carry: list[Column]) -> DataFrame:
    """``carry`` columns and ``logit`` of each row."""
    rows = docs.select(F.struct(*carry).alias("doc"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(logits(model, batch["text"]), pa.float64())], names=["doc", "logit"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, logit double")


def strength(groups: float, n: float, squares: float, between: float, within: float) -> float:
    """Documents that a prior counts for: (1 - r) / r for the intraclass
    correlation r by analysis of variance."""
    if groups < 2 or n <= groups:
        return 1e6
    msb, msw = between / (groups - 1), within / (n - groups)
    size = (n - squares / n) / (groups - 1)
    r = (msb - msw) / max(msb + (size - 1) * msw, 1e-12)
    return 1 / min(max(r, 1e-6), 1 - 1e-6) - 1


def posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, n, path_mean, host_mean), the sums (s, hn, hs) and weights
    of priors (k_host, k_path) behind them, and the global mean, from (host,
    path, logit) rows.  Two rows of sums reach the driver."""
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / (1 + F.exp(-F.col("logit")))).alias("s"))
    paths = stored(paths, "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    both = paths.join(hosts, "host")
    m = F.col("s") / F.col("n")
    sums = lambda df, n, s: df.agg(F.count(F.lit(1)), F.sum(n), F.sum(F.col(n).cast("double") * F.col(n)), F.sum(s), F.sum(F.col(s) * F.col(s) / F.col(n))).first()
    g, n, squares, total, square_means = sums(hosts, "hn", "hs")
    if not g:
        return both.withColumns({"path_mean": m, "host_mean": m, "k_host": F.lit(1.0), "k_path": F.lit(1.0)}), 0.5
    mean = min(max(total / n, 1e-6), 1 - 1e-6)
    k_host = strength(g, n, squares, square_means - total * total / n, total - square_means)
    pg, _, psquares, _, pmeans = sums(paths, "n", "s")
    k_path = strength(pg - g + 1, n, psquares, pmeans - square_means, total - pmeans)
    host_mean = (F.col("hs") + k_host * mean) / (F.col("hn") + k_host)
    both = both.withColumn("host_mean", host_mean).withColumn("path_mean", (F.col("s") + k_path * F.col("host_mean")) / (F.col("n") + k_path))
    return both.withColumns({"k_host": F.lit(float(k_host)), "k_path": F.lit(float(k_path))}), mean


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def decided(rows: DataFrame, sites: DataFrame, mean: float) -> DataFrame:
    """Adds site columns, ``log_odds`` and ``kept`` to (host, path, logit, ...)
    rows.  Salted, so a host with a third of all rows is spread out."""
    own = sites.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("logit"), F.lit(SALTS))).join(own, ["host", "path", "salt"])
    p = 1 / (1 + F.exp(-F.col("logit")))
    host = (F.col("hs") - p + F.col("k_host") * mean) / (F.col("hn") - 1 + F.col("k_host"))
    site = (F.col("s") - p + F.col("k_path") * host) / (F.col("n") - 1 + F.col("k_path"))
    log_odds = F.col("logit") - math.log(mean / (1 - mean)) + _odds(site)
    rows = rows.withColumn("log_odds", log_odds).withColumn("kept", F.col("log_odds") >= KEEP_FROM)
    return rows.drop("salt", "n", "s", "hn", "hs", "k_host", "k_path")


def _parts(docs: DataFrame, host: str, path: str) -> list[Column]:
    return [_site(host, docs).alias("host"), _site(path, docs).alias("path")]


def query(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    model = fit(training_rows(docs, labels))
    rows = stored(scored(docs, model, [F.col("doc_id").cast("long").alias("doc_id"), *_parts(docs, host, path)]).select("doc.*", "logit"), "doc-logits")
    sites, mean = posteriors(rows)
    return decided(rows, sites, mean).select("doc_id", "host", "path", "logit", "host_mean", "path_mean", "log_odds", "kept")


def stage(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The documents kept.  Texts are scored again beside the posteriors, so
    they are not shuffled while these are small."""
    model = fit(training_rows(docs, labels))
    rows = scored(docs, model, _parts(docs, host, path)).select("doc.*", "logit")
    sites, mean = posteriors(rows)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    again = scored(docs, model, [whole, *_parts(docs, host, path)]).select("doc.*", "logit")
    return decided(again, sites, mean).where("kept").select("row.*")
