"""Hashed word shingles of whole texts, vectorised over a batch's UTF-8
buffer: no Python object is made for a word.

A word is a run of bytes outside space and U+0009 to U+000D, with A-Z
lower-cased.  The hash of a word of up to SHORT bytes is a polynomial over
random 64-bit values of its bytes; a polynomial fails on long words built for
it, so theirs is a library hash.  A shingle's hash mixes those of its words in
order.  All values are 62 bits wide, and only shingles of one text or of two
compared texts are ever told apart by them: a chance near 1e-18 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .mph import mix

WORDS = 5
#: Bytes of a word up to which its own bytes are hashed by the polynomial.
SHORT = 16
#: Bytes hashed at a time (longer single texts are hashed whole).
STEP = 1 << 19

_rng = np.random.default_rng(0x5DEECE66D)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)[LOWER]
RADIX = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(RADIX), -1, 2**64))
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)], dtype=np.uint64)


_tables: dict[str, np.ndarray] = {}


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        table = _powers(base, max(n, 2 * STEP))
        if n > 2 * STEP:
            return table
        _tables[name] = table
    return _tables[name][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, hash) of each word of a byte array that ends in white space."""
    blank = _space[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.r_[0, edge]
    first, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * powers("up", RADIX, len(data)), out=total[1:])
    return first, end, (total[end] - total[first]) * powers("down", INVERSE, len(data))[first] + (end - first).astype(np.uint64)


def long_words(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of words over SHORT bytes and their 128-bit hashes."""
    at = np.flatnonzero(end - first > SHORT)
    if not len(at):
        return at, np.zeros((0, 2), np.uint64)
    raw = LOWER[data].tobytes()
    digests = [xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip(first[at].tolist(), end[at].tolist(), strict=True)]
    return at, np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _block(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; text k ends before byte
    ends[k], which holds white space."""
    first, end, words = word_hashes(data)
    at, digests = long_words(data, first, end)
    words[at] = digests[:, 0]
    upto = np.searchsorted(first, ends)
    counts = np.diff(np.r_[0, upto])
    n = len(words)
    five = np.full(n, np.uint64(WORDS))
    for k in range(WORDS):
        five = mix(five * np.uint64(3) ^ np.r_[words[k:], np.zeros(min(k, n), np.uint64)][:n], k + 1)
    out, at = [], 0
    for c in counts.tolist():
        if c >= WORDS:
            own = np.sort(five[at:at + c - WORDS + 1] >> np.uint64(2))
            out.append(own if len(own) < 2 else own[np.r_[True, own[1:] != own[:-1]]])
        elif c:
            whole = np.array([c], np.uint64)
            for k in range(c):
                whole = mix(whole * np.uint64(3) ^ words[at + k], k + 1)
            out.append(whole >> np.uint64(2))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def text_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text of a binary Arrow column (null: empty)."""
    held, size = [], 0
    for value in column:
        text = value.as_buffer() if value.is_valid else b""
        held.append(np.frombuffer(text or b" ", np.uint8))
        size += len(held[-1]) + 1
        if size >= STEP:
            yield from _flush(held)
            held, size = [], 0
    if held:
        yield from _flush(held)


def _flush(texts: list[np.ndarray]) -> list[np.ndarray]:
    blank = np.array([32], np.uint8)
    data = np.concatenate([x for t in texts for x in (t, blank)])
    return _block(data, np.cumsum([len(t) + 1 for t in texts]) - 1)
