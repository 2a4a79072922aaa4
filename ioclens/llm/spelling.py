"""Spelling variants grouped by asymmetric q-chunks.

Words are the runs of letters of whole texts, with their numbers.  Two words
are near if they differ by one inserted, deleted or replaced code point; a
word's form is its near word of largest number where that is at least twice
its own, and forms are followed to the root.

Near words.  The shorter word of a pair (or either of two as long) contributes
two disjoint chunks, its halves; the other contributes its positional grams of
the chunks' sizes.  One edit leaves one chunk whole, at the place it had or
moved by the difference in lengths, so of all positional grams only those
within shift one of a chunk's place can meet it: one for each chunk and each
of the two lengths the shorter word can have.  Chunks and grams are joined by
(length, chunk, text), and what meets is verified on the whole words.

Hot chunks.  A chunk that many words share is not paired out: where a chunk's
words times its grams pass PAIRS, these rows are split again in the same way,
on what the chunk left over, which must still differ by exactly one edit.  So
a pair then agrees in a chunk and in a half of the rest, and so on, until the
rest is one code point; no list grows with the square of its words, and none
is cut.

Plan: (1) each task counts words in a bounded table, then they are summed by
word; (2) rounds of split, size of each list, join of the small ones; only
rows of hot lists go on; (3) near words are counted and the best is taken by
aggregates; (4) forms are followed by pointer jumping, rows at their root
leave the rounds.

Defined results: a null text has no words; a null doc_id counts as an empty
one in the deletion rule; repeated rows count each; equal numbers go to the
smaller word in code-point order; an empty table gives an empty result; only
``doc_id`` and ``text`` are read, so further columns never clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ONE_IN = 97  # runs that lose a code point
LEAST_POINTS, LEAST_TIMES, RATIO = 5, 3, 2
#: Words a task holds before it passes its counts on.
HELD = 300_000
#: A list of more pairs than this is split again.
PAIRS = 1 << 10


def text_words(doc_id: int | None, text: str | None) -> Counter:
    """The runs of a text, lower-cased, some with a code point deleted by the
    rule of the crc of '<doc_id>:<run>', with their numbers."""
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, times in Counter(RUN.findall(text or "")).items():
        run = run.translate(LOWER)
        h = zlib.crc32(run.encode(), start)
        if h % ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += times
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        ids, texts = batch["doc_id"], batch["text"]
        for k in range(len(batch)):
            for word, times in text_words(ids[k].as_py(), texts[k].as_py()).items():
                if len(word) >= LEAST_POINTS:
                    held[word] += times
            if len(held) >= HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that take part, stored."""
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, "word string, n long")
    return stored(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES), "spelling-words")


def split(rows: DataFrame) -> DataFrame:
    """Each row's two chunks or grams.  ``rest``: what of the word no chunk
    has settled; ``size``: how long the rest of the chunked word of this list
    is (a gram row's own rest may be one longer); ``key``: the chunks so far."""
    half, shift = F.floor(F.col("size") / 2).cast("int"), F.length("rest") - F.col("size")
    cut = half + shift
    long = F.length("rest")
    left = F.struct(F.xxhash64("key", F.lit(0), F.substring("rest", F.lit(1), half)).alias("key"), (F.col("size") - half).alias("size"), F.substring("rest", half + 1, long).alias("rest"))
    right = F.struct(F.xxhash64("key", F.lit(1), F.substring("rest", cut + 1, long)).alias("key"), half.alias("size"), F.substring("rest", F.lit(1), cut).alias("rest"))
    return rows.select("grams", "word", "n", F.inline(F.array(left, right)))


def near_pairs(found: DataFrame) -> DataFrame:
    """(word, n, other, m): near words, each pair once."""
    size = F.length("word")
    lists = F.array(F.struct(F.lit(False).alias("grams"), size.alias("size")), F.struct(F.lit(True).alias("grams"), size.alias("size")),
                    F.struct(F.lit(True).alias("grams"), (size - 1).alias("size")))
    rows = found.select("word", "n", F.inline(lists)).where(F.col("size") >= LEAST_POINTS)
    rows = rows.select("grams", F.col("size").cast("long").alias("key"), "size", F.col("word").alias("rest"), "word", "n")
    parts = []
    while True:
        rows = stored(split(rows), "spelling-chunks")
        sizes = rows.groupBy("key").agg(F.count_if(~F.col("grams")).alias("a"), F.count_if("grams").alias("b"), F.max("size").alias("size"))
        hot = stored(sizes.where((F.col("a") * F.col("b") > PAIRS) & (F.col("size") > 1)).select("key"), "spelling-hot")
        done = hot.isEmpty()
        cold = rows if done else rows.join(hot, "key", "left_anti")
        x = cold.where("NOT grams").select("key", "word", "n")
        y = cold.where("grams").select("key", F.col("word").alias("other"), F.col("n").alias("m"))
        longer = (F.length("word") < F.length("other")) | (F.col("word") < F.col("other"))
        parts.append(stored(x.join(y, "key").where(longer & (F.levenshtein("word", "other", 1) == 1)).drop("key"), "spelling-pairs"))
        if done:
            break
        rows = rows.join(hot, "key", "left_semi")
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form, by pointer jumping."""
    at = live = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    finished = None
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(live.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNull().alias("done")), "spelling-roots")
        ended, live = (step.where(c).select("word", "root") for c in ("done", "NOT done"))
        finished = ended if finished is None else finished.unionByName(ended)
        if live.isEmpty():
            return finished
        at = finished.unionByName(live)


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n)."""
    found = words(docs)
    pairs = near_pairs(found)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    rows = found.join(best, "word", "left")
    has = -F.col("best.less") >= RATIO * F.col("n")
    rows = stored(rows.select("word", F.when(has, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                              F.when(has, -F.col("best.less")).alias("form_n")), "spelling-forms")
    end = roots(rows.where("form IS NOT NULL"))
    return rows.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    return variants(docs)


#: Near words by equal remains after one deletion; the crc by its table.
SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(cast(doc_id AS varchar), '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
h AS (SELECT run, k, xor(list_reduce([4294967295] || list_transform(range(len(x) // 2), lambda j: cast('0x' || x[2 * j + 1:2 * j + 2] AS bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM each, crc),
v AS (SELECT CASE WHEN h % 97 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, k FROM h),
w AS (SELECT word, cast(sum(k) AS bigint) AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS (SELECT word, i, concat(left(word, i), substr(word, i + 2)) AS rest FROM w, unnest(range(length(word))) AS u(i)),
p AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
f AS (SELECT p.word, count(*) AS n_near, arg_min(p.other, (-o.n, p.other)) AS best, max(o.n) AS m FROM p JOIN w o ON o.word = p.other GROUP BY p.word),
g AS (SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.m >= 2 * w.n THEN f.best END AS form, CASE WHEN f.m >= 2 * w.n THEN f.m END AS form_n
      FROM w LEFT JOIN f ON f.word = w.word),
r(word, top) AS (SELECT word, word FROM g UNION ALL SELECT r.word, g.form FROM r JOIN g ON g.word = r.top WHERE g.form IS NOT NULL)
SELECT g.word, g.form, r.top AS root, g.n, g.n_near, g.form_n FROM g JOIN r ON r.word = g.word JOIN g e ON e.word = r.top AND e.form IS NULL
"""
