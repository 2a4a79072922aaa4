"""Alignment of two tokenizers' tokens by pointer jumping.

A text with a space before it is encoded by a byte-level vocabulary (A), and
the text by a piece vocabulary (B) that adds the space itself; the tokens of
both cover the same bytes.  Byte offsets where both end cut them into groups.

Groups (``labels``).  Every token points to the token reaching farthest right
among those that overlap it, itself included; of an A and a B token that end
together it is the A token.  Doubling all pointers of a batch at once
(next = next[next]) leaves every token at the last A token of its group after
about log2 of the longest chain of overlaps, whatever the texts' lengths.

Links.  All A-B token pairs of a group are links.  They are kept as counts by
id pair: a group's tokens are reduced to distinct ids first, so a long group
of few ids stays small.

Chunks.  A space after a character that is no white space starts a token on
both sides: A's pattern takes a space only as a pre-token's first character
or after white space, and no piece of B holds a space after another character
(else texts stay whole).  So groups never reach across it, and a text's
tokens, groups and links are those of its chunks between such spaces, in
order.  A worker encodes and aligns a chunk once and keeps a bounded number of
them; a text with a chunk whose bytes differ is encoded again as a whole.

Plan: (1) one pass encodes, labels and hashes each document and writes one
row with its distinct id pairs and how often it links them; (2) documents are
counted by id pair, with map-side combining, and the best count of each A id
is found; (3) the counts return to the documents.  Of R rows (document, pair)
at most HEAVY pairs can be in more than R / HEAVY documents: these, nearly all
rows of a corpus, meet their counts in a broadcast of at most HEAVY rows; the
others are shuffled by pair and none of them is hot.

Defined results: texts null, empty, or whose joined token bytes in A or B
differ from space + text have no tokens (zeros and ''); each row is a document
of its own, whatever its id; an empty table gives an empty result; only
``doc_id`` and ``text`` are read, so further columns never clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ODD, Known, byte_bpe, proven
from .common import stored
from .tokens import symbols

HEAVY = 1 << 17
#: Bytes of text encoded, and group products expanded, at a time; groups with
#: more pairs than WIDE are reduced to distinct ids before they are expanded.
STEP = 1 << 18
EXPAND = 1 << 20
WIDE = 64
#: A worker's table of more chunks or characters than these goes back to its
#: first quarter, the chunks met first, which are mostly the frequent ones.
CHUNKS = 1 << 18
CHARS = 1 << 22

SPACE = "▁"
#: Spaces at which texts are cut; characters that some Unicode versions took
#: for white space count as such.  RUNS: spaces after white space, by whether a text is ASCII.
CUT = re.compile("(?<=[^\\s\u180e\u200b\ufeff]) (?!\\Z)")
BLANKS = frozenset(c for c in map(chr, range(1 << 16)) if c.isspace() or c in "\u180e\u200b\ufeff")
RUNS = {ascii: [c + " " for c in BLANKS if c.isascii() or not ascii] for ascii in (False, True)}
BYTE = re.compile("<0x([0-9A-F]{2})>")


class Pieces:
    """Ids of a piece vocabulary (B), which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            name = self.model.id_to_piece(i)
            byte = BYTE.fullmatch(name) if self.model.is_byte(i) else None
            plain = not (self.model.is_control(i) or self.model.is_unknown(i))
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else name.replace(SPACE, " ").encode() if plain else b"")
        self.apart = not any(re.search(b"[^ ] ", x) for x in self.bytes)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)

    def covers(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == raw


class Bytes:
    """Ids of a byte-level vocabulary (A); special tokens are plain text."""

    def __init__(self, path: str):
        self.bpe = byte_bpe(path, False)
        byte = {s: b for b, s in enumerate(symbols())}
        vocabulary = self.bpe.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes[i] = bytes([byte[s] for s in entry])
        self.known = Known({t: [i] for t, i in proven(path).items()}, self.bpe.merged)
        # merging keeps all bytes if each byte is an entry
        self.lossless = all(s in vocabulary for s in symbols())

    def ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.bpe.words(text))))

    def covers(self, ids: list[int], raw: bytes) -> bool:
        return self.lossless or b"".join(map(self.bytes.__getitem__, ids)) == raw


def labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and each B token, numbered from 0 in order, from
    the byte offsets where they end; both sides end at the same last byte."""
    n = len(ends_a)
    at_b = np.searchsorted(ends_b, ends_a - 1, side="right")  # the B token over an A token's last byte
    at_a = np.searchsorted(ends_a, ends_b - 1, side="right")
    head = np.concatenate([np.where(ends_b[at_b] > ends_a, n + at_b, np.arange(n)), at_a])
    while True:
        onward = head[head]
        if np.array_equal(onward, head):
            break
        head = onward
    last = np.zeros(n, np.int64)
    last[head[:n]] = 1
    group = (np.cumsum(last) - last)[head]
    return group[:n], group[n:]


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times), sorted by group."""
    key, times = np.unique(group << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, times


def links(ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(group, a, b, times) of the linked id pairs, in slices of about EXPAND
    rows; groups are 0..n-1 and sorted on both sides."""
    n = int(ga[-1]) + 1 if len(ga) else 0
    ta, tb = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    wide = np.bincount(ga, minlength=n) * np.bincount(gb, minlength=n) > WIDE
    if wide.any():
        sides = []
        for g, ids, times in ((ga, a, ta), (gb, b, tb)):
            far = wide[g]
            more = _distinct(g[far], ids[far])
            g, ids, times = (np.concatenate([x[~far], y]) for x, y in zip((g, ids, times), more, strict=True))
            by = np.argsort(g, kind="stable")
            sides.append((g[by], ids[by], times[by]))
        (ga, a, ta), (gb, b, tb) = sides
    first = np.searchsorted(gb, np.arange(n))
    count = np.bincount(gb, minlength=n)[ga] if n else np.zeros(0, np.int64)
    stop = np.cumsum(count)
    at = 0
    while at < len(a):
        done = stop[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(stop, done + EXPAND, side="right")))
        k = count[at:to]
        i = np.repeat(np.arange(at, to), k)
        j = np.repeat(first[ga[at:to]] - (stop[at:to] - k - done), k) + np.arange(len(i))
        yield ga[i], a[i], b[j], ta[i] * tb[j]
        at = to


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[start], np.add.reduceat(times[order], start)


class Rows:
    """An array that rows are added to; its room doubles as it fills."""

    def __init__(self, *width: int):
        self.room, self.n = np.zeros((1024, *width), np.int64), 0

    def add(self, new: np.ndarray) -> None:
        n = self.n + len(new)
        if n > len(self.room):
            self.room = np.concatenate([self.room[:self.n], new, np.zeros((n, *new.shape[1:]), np.int64)])
        self.room[self.n:n] = new
        self.n = n


class Chunks(dict):
    """Chunk -> its number; new ones wait to be aligned.  ``counts``: n_a,
    n_b, n_groups, n_links and where its pairs start and end; ``spelt``: its
    groups as text; ``pairs``: (pair, times)."""

    def __init__(self):
        self.new: list[str] = []
        self.counts, self.pairs, self.spelt, self.chars = Rows(6), Rows(2), [], 0

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self.chars += len(chunk)
        self[chunk] = n = len(self)
        return n

    def trim(self) -> None:
        if len(self) <= CHUNKS and self.chars <= CHARS:
            return
        first = list(islice(self, CHUNKS // 4))
        self.chars = sum(map(len, first))
        if self.chars > CHARS // 2:
            first, self.chars = [], 0
        self.clear()
        self.update(zip(first, range(len(first)), strict=True))
        del self.spelt[len(first):]
        self.counts.n = len(first)
        self.pairs.n = int(self.counts.room[len(first) - 1, 5]) if first else 0


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Bytes(path_a), Pieces(path_b)
        self.size = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        # an id's text after each separator: start, next group, other side, same side
        most = max(map(len, self.size))
        self.spelt = np.array([[mark + str(i) for i in range(most)] for mark in ("", ";", "|", ",")], object)
        self.chunks = Chunks()

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        if text:
            whole = " " + text
            raw = whole.encode()
            a, b = self.a.ids(whole), self.b.ids(text)
            if self.a.covers(a, raw) and self.b.covers(b, raw):
                return a, b
        return [], []

    def cut(self, text: str | None) -> list[str]:
        """The chunks of a text, each without the space that starts it."""
        if not text or not self.b.apart:
            return [text] if text else []
        whole = " " + text
        if whole[-1] != " " and not any(run in whole for run in RUNS[text.isascii()]):
            return text.split(" ")
        return CUT.split(text)

    def joins(self, chunk: str) -> bool:
        """Whether a chunk may be encoded in one text with others."""
        return self.b.apart and chunk[-1] not in BLANKS and SPACE not in chunk and (chunk.isascii() or not ODD.search(chunk))

    def encode(self, chunks: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """(ids, tokens of each chunk) of A and of B; neighbours that may be
        are encoded as one text and told apart by the bytes of their tokens."""
        ids, count = ([], []), ([], [])
        for joined, group in groupby(chunks, self.joins):
            run = list(group)
            if joined:
                both = self.tokens(" ".join(run))
                stop = np.cumsum([1 + (len(c) if c.isascii() else len(c.encode())) for c in run])
                ends = [np.r_[0, np.cumsum(size[np.array(x, np.int64)])] for size, x in zip(self.size, both, strict=True)]
                at = [np.searchsorted(x, stop, side="right") - 1 for x in ends]
                if all((x[i] == stop).all() for x, i in zip(ends, at, strict=True)):
                    for k in (0, 1):
                        ids[k].append(both[k])
                        count[k].append(np.diff(at[k], prepend=0))
                    continue
            for both in map(self.tokens, run):
                for k in (0, 1):
                    ids[k].append(both[k])
                    count[k].append([len(both[k])])
        return tuple((np.array(list(chain.from_iterable(x)), np.int64), np.concatenate(n).astype(np.int64)) for x, n in zip(ids, count, strict=True))

    def learn(self) -> None:
        """Align the new chunks and add them to the table."""
        known, texts = self.chunks, self.chunks.new
        known.new = []
        (a, na), (b, nb) = self.encode(texts)
        if not len(a):
            known.counts.add(np.zeros((len(texts), 6), np.int64))
            known.spelt += [""] * len(texts)
            return
        ga, gb = labels(np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b]))
        n = int(ga[-1]) + 1
        text_a = np.repeat(np.arange(len(texts)), na)
        text = np.zeros(n, np.int64)
        text[ga] = text_a
        per = np.bincount(ga, minlength=n) * np.bincount(gb, minlength=n)
        n_groups = np.bincount(text, minlength=len(texts))
        n_links = np.bincount(text, weights=per, minlength=len(texts)).astype(np.int64)
        # groups as text: A before B within a group, in order within a side
        new_a, new_b = np.r_[True, ga[1:] != ga[:-1]], np.r_[True, gb[1:] != gb[:-1]]
        start = np.r_[True, text_a[1:] != text_a[:-1]]
        mark = np.concatenate([np.where(start, 0, np.where(new_a, 1, 3)), np.where(new_b, 2, 3)])
        order = np.argsort(np.concatenate([ga * 2, gb * 2 + 1]), kind="stable")
        words = self.spelt[mark, np.concatenate([a, b])][order].tolist()
        cuts = np.concatenate([[0], np.cumsum(na + nb)]).tolist()
        known.spelt += ["".join(words[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        # distinct pairs of each chunk
        keys, times, (most_a, most_b) = np.zeros(0, np.int64), np.zeros(0, np.int64), map(len, self.size)
        for g, x, y, t in links(ga, a, gb, b):
            keys, times = _summed(np.concatenate([keys, (text[g] * most_a + x) * most_b + y]), np.concatenate([times, t]))
        of, pair = np.divmod(keys, most_a * most_b)
        ends = known.pairs.n + np.searchsorted(of, np.arange(len(texts) + 1))
        known.counts.add(np.stack([na, nb, n_groups, n_links, ends[:-1], ends[1:]], axis=1))
        known.pairs.add(np.stack([pair, times], axis=1))

    def numbers(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each chunk, text it is of)."""
        size = np.array([len(x) for x in cut], np.int64)
        codes = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(cut)), np.int64, int(size.sum()))
        if self.chunks.new:
            self.learn()
        return codes, np.repeat(np.arange(len(cut)), size)

    def align(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, sha256 of groups, pairs, times) of
        each text; a pair is a << 32 | b."""
        cut = [self.cut(t) for t in texts]
        codes, of = self.numbers(cut)
        known = self.chunks
        differ = np.unique(of[known.counts.room[codes, 0] == 0]).tolist()
        if differ:
            for k in differ:
                cut[k] = [texts[k]]
            codes, of = self.numbers(cut)
        n = len(texts)
        counts = known.counts.room[codes]
        upto = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[:, :4], axis=0)])
        ends = np.searchsorted(of, np.arange(n + 1))
        sums = (upto[ends[1:]] - upto[ends[:-1]]).tolist()
        spelt, cuts = [known.spelt[c] for c in codes.tolist()], ends.tolist()
        digests = [hashlib.sha256(";".join(spelt[i:j]).encode()).hexdigest() if s[0] else "" for i, j, s in zip(cuts, cuts[1:], sums, strict=False)]
        # distinct pairs of each text, from its distinct chunks
        held, often = np.unique(of * len(known) + codes, return_counts=True)
        of, codes = np.divmod(held, max(len(known), 1))
        first, stop = known.counts.room[codes, 4], known.counts.room[codes, 5]
        i = np.repeat(np.arange(len(codes)), stop - first)
        j = np.arange(len(i)) + np.repeat(stop - np.cumsum(stop - first), stop - first)
        most_a, most_b = map(len, self.size)
        keys, times = _summed(of[i] * (most_a * most_b) + known.pairs.room[j, 0], often[i] * known.pairs.room[j, 1])
        of, pair = np.divmod(keys, most_a * most_b)
        pair = pair // most_b << 32 | pair % most_b
        ends = np.searchsorted(of, np.arange(n + 1)).tolist()
        known.trim()
        return [(*sums[k], digests[k], pair[ends[k]:ends[k + 1]], times[ends[k]:ends[k + 1]]) for k in range(n)]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
LISTS = pa.list_(pa.int64())


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """ALIGNED and a row number, stored: one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            at, held, size = 0, [], 0
            texts = batch["text"]
            for k in range(len(batch)):
                held.append(texts[k].as_py())
                size += len(held[-1] or "")
                if size >= STEP or k + 1 == len(batch):
                    cols = list(zip(*own.align(held), strict=True))
                    kinds = [pa.int64()] * 4 + [pa.string(), LISTS, LISTS]
                    arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch["doc_id"][at:k + 1], *arrays], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                    at, held, size = k + 1, [], 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best), stored: documents that hold a linked id pair, and
    whether no pair of the same A id is in more."""
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    a = F.shiftright("pair", 32).alias("a")
    top = counts.groupBy(a).agg(F.max("n").alias("top"))
    return stored(counts.select("pair", "n", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best")), "pair-best")


def query(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    rows = aligned(docs, path_a, path_b)
    counts = pair_counts(rows)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * HEAVY > total  # true of fewer than HEAVY pairs
    held = rows.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    sums = [F.sum(F.when(F.col("best") == 1, F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    heavy = held.join(F.broadcast(counts.where(often)), "pair").groupBy("row").agg(*sums)
    parts = heavy
    rare = counts.where(~often)
    if not rare.isEmpty():
        light = held.join(F.broadcast(counts.where(often).select("pair")), "pair", "left_anti")
        parts = heavy.unionByName(light.join(rare, "pair").groupBy("row").agg(*sums))
    parts = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("pairs", "times").join(parts, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
