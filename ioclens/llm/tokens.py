"""Whole texts to token ids, once per distinct white-space chunk and word.

The vocabulary's pre-tokenizer never joins characters across white space
and its normaliser never composes across it, so a text's ids are the ids of
its chunks in order, and a chunk's those of its words.  Each worker keeps the
ids of a bounded number of chunks, in arrays, and lays out a batch's ids by
array operations.  Chunks of printable ASCII and Latin-1 letters are split
here by the pre-tokenizer's pattern; all others by the library's own
normaliser and pre-tokenizer.  Ids of words come from the library's model
(``ChunkEncoder``) or from any other function.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

from .mph import mix
from .shingles import LOWER, long_words, word_hashes

#: Entries of a worker's table of chunks, of its newest part, and of words;
#: words of more letters, and chunks of more ids, than LONG are never kept.
CACHE = 1_000_000
RECENT = 40_000
WORDS = 60_000
LONG = 48
#: Chunks that need no Unicode normalising, and their words in lower case
#: (the pre-tokenizer's pattern; fixed values).
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def chunks(text: str | None) -> list[bytes]:
    """Chunks between ASCII white space, as UTF-8 with A-Z lower-cased: the
    tokenizer lower-cases anyway.  Not lower-cased where the text might hold
    a special token, whose spelling counts."""
    raw = (text or "").encode()
    return (raw if b"<|" in raw else raw.lower()).split()


def batches(texts: Iterable[str | bytes | None], size: int = 1 << 19) -> Iterator[list[bytes]]:
    """Texts as UTF-8, in lists of about ``size`` bytes."""
    held, total = [], 0
    for text in texts:
        held.append(text.encode() if isinstance(text, str) else text or b"")
        total += len(held[-1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _ends(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second hash of words, from their first and last eight bytes and their
    length: exact with these for words of up to sixteen bytes."""
    padded = np.r_[np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)]
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    size = end - first
    short = (np.maximum(8 - size, 0) * 8).astype(np.uint64)
    head, tail = eight[first + 8] << short, eight[end] >> short
    return mix(mix(head, 11) ^ tail + size.astype(np.uint64), 12)


class ChunkTable:
    """Ids of chunks by two 64-bit hashes (of up to 16 bytes: exact; of longer
    ones: the halves of a 128-bit library hash): sorted arrays of ``most`` entries
    and a dictionary of the newest, merged into them as it fills.  A full
    table starts anew.  ``make`` gives the ids of a chunk."""

    def __init__(self, make: Callable[[bytes], list[int]], kind: np.dtype, most: int = CACHE):
        self.make, self.kind, self.most = make, kind, most
        self.clear()

    def clear(self) -> None:
        self.keys = self.checks = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint16)
        self.ids = np.zeros(0, self.kind)
        self.recent: dict[tuple[int, int], list[int]] = {}

    def _merge(self) -> None:
        if len(self.keys) + len(self.recent) > self.most:
            self.clear()
            return
        new = np.array(list(self.recent), np.uint64).reshape(-1, 2)
        size = np.array([len(x) for x in self.recent.values()], np.uint16)
        ids = np.array([i for x in self.recent.values() for i in x], self.kind)
        keys = np.concatenate([self.keys, new[:, 0]])
        order = np.argsort(keys, kind="stable")
        start = np.concatenate([self.start, (len(self.ids) + np.cumsum(size, dtype=np.int64) - size).astype(np.uint32)])
        self.keys, self.checks = keys[order], np.concatenate([self.checks, new[:, 1]])[order]
        self.start, self.size = start[order], np.concatenate([self.size, size])[order]
        self.ids, self.recent = np.concatenate([self.ids, ids]), {}

    def look_up(self, keys: np.ndarray, checks: np.ndarray, chunk: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of chunks given by their hashes; ``chunk(k)`` is
        the k-th itself."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = (self.keys[at] == keys) & (self.checks[at] == checks) if len(self.keys) else np.zeros(len(keys), bool)
        start, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if known.any():
            start[known], size[known] = self.start[at[known]], self.size[at[known]]
        ids, more = self.ids, []
        for k, key in zip(np.flatnonzero(~known).tolist(), zip(keys[~known].tolist(), checks[~known].tolist(), strict=True), strict=True):
            own = self.recent.get(key)
            if own is None:
                own = self.make(chunk(k))
                if len(own) <= LONG:
                    self.recent[key] = own
            start[k], size[k] = len(ids) + len(more), len(own)
            more += own
        out = np.concatenate([ids, np.array(more, self.kind)]) if more else ids
        if len(self.recent) >= RECENT:
            self._merge()
        return out, start, size

    def texts(self, texts: Iterable[str | bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text; a batch's distinct chunks are looked up once.
        Texts that may spell a special token go chunk by chunk."""
        for held in batches(texts):
            data = LOWER[np.frombuffer(b" ".join([*(b"" if b"<|" in t else t for t in held), b""]) + b" ", np.uint8)]
            first, end, keys = word_hashes(data)
            checks = _ends(data, first, end)
            at, digests = long_words(data, first, end)
            keys[at], checks[at] = digests[:, 0], digests[:, 1]
            codes, _ = pd.factorize(keys)
            n = codes.max() + 1 if len(codes) else 0
            some = np.zeros(n, np.int64)
            some[codes[::-1]] = np.arange(len(codes))[::-1]
            if not (checks == checks[some][codes]).all():  # a collision; tell the chunks apart by both
                codes, _ = pd.factorize(mix(keys, 1) ^ checks)
                some = np.zeros(codes.max() + 1, np.int64)
                some[codes[::-1]] = np.arange(len(codes))[::-1]
            raw, i, j = data.tobytes(), first[some].tolist(), end[some].tolist()
            ids, start, size = self.look_up(keys[some], checks[some], lambda k: raw[i[k]:j[k]])
            count = size[codes]
            stop = np.cumsum(count)
            out = ids[np.repeat(start[codes] - stop + count, count) + np.arange(stop[-1] if len(stop) else 0)]
            ends = np.cumsum([1 + (0 if b"<|" in t else len(t)) for t in held])
            cuts = np.r_[0, stop][np.searchsorted(first, ends)].tolist()
            for text, a, b in zip(held, [0, *cuts], cuts, strict=False):
                yield np.array([x for c in chunks(text.decode()) for x in self.make(c)], self.kind) if b"<|" in text else out[a:b]


@lru_cache(maxsize=1)
def symbols() -> list[str]:
    """The byte-level symbol of each byte: printable Latin-1 stands for
    itself, the other bytes for the code points from 256 on, in order."""
    plain = [b for b in range(256) if chr(b).isprintable() and b > 32]
    rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [rest.get(b) or chr(b) for b in range(256)]


class WordSplitter:
    """Chunks to words in byte-level symbols, as the tokenizer file has it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.normal, self.split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.symbol = symbols()

    def parts(self, chunk: bytes) -> list[str | int]:
        """The words of a chunk; a special token gives its id."""
        text = chunk.decode()
        if "<|" not in text:
            if text.isascii() and text.isprintable():
                return PLAIN_WORDS.findall(text.lower())
            if PLAIN.fullmatch(text):
                symbol = self.symbol
                return ["".join([symbol[b] for b in w.encode()]) for w in PLAIN_WORDS.findall(text.lower())]
        out: list[str | int] = []
        while text:
            at, name = min(((text.find(s), s) for s in self.special if s in text), default=(len(text), ""))
            if at:
                out += [w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text[:at]))]
            if name:
                out.append(self.special[name])
            text = text[at + len(name):]
        return out


class Words(dict):
    """A bounded table of words' ids that makes what it lacks."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, word: str | int) -> list[int]:
        if isinstance(word, int):
            return [word]
        ids = self.make(word)
        if len(word) <= LONG:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


class ChunkEncoder(WordSplitter):
    """``word_ids``: ids of a word in byte-level symbols, by default from the
    library's model.  ``kind``: little-endian unsigned type of all ids."""

    def __init__(self, path: str, word_ids: Callable[[str], list[int]] | None = None):
        super().__init__(path)
        tokenize = self.tokenizer.model.tokenize
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.words = Words(word_ids or (lambda w: [t.id for t in tokenize(w)]))
        self.encode_all = ChunkTable(self.ids, self.kind).texts

    def ids(self, chunk: bytes) -> list[int]:
        return [i for ids in map(self.words.__getitem__, self.parts(chunk)) for i in ids]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process; kept between tasks."""
    return ChunkEncoder(path)
