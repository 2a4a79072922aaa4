"""Minimal perfect hash over 64-bit keys, built and probed with numpy.

Levels of bit arrays: a key that is alone at its place of a level is settled
there; the others move to the next level.  A key's index is the rank of its
bit, so n keys take the indexes 0..n-1 in about four bits a key.  Probing a
key that was not built in gives -1 or some index, so callers store a
fingerprint next to each index and compare it.
"""

from __future__ import annotations

import struct

import numpy as np

GAMMA = 2
MAX_LEVELS = 48


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser (wrapping arithmetic) of keys under a seed."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Mph:
    """``sizes``: words of 64 bits of each level; ``words``: all levels'
    bits; ``before``: set bits before each word."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.n = int(self.before[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> Mph:
        """``keys``: distinct unsigned 64-bit values."""
        keys = np.ascontiguousarray(keys, np.uint64)
        sizes, parts = [], []
        while len(keys):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = max(1, -(-GAMMA * len(keys) // 64))
            at = mix(keys, len(sizes)) % np.uint64(size * 64)
            alone = np.bincount(at.astype(np.int64), minlength=size * 64) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~alone[at.astype(np.int64)]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = mix(keys[left], level) % np.uint64(size * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + base, at & np.uint64(63)
            held = self.words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            left, base = left[~hit], base + size
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<I{len(self.sizes)}I", len(self.sizes), *self.sizes)
        return head + self.words.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> Mph:
        (n,) = struct.unpack_from("<I", blob)
        sizes = list(struct.unpack_from(f"<{n}I", blob, 4))
        return cls(sizes, np.frombuffer(blob, "<u8", sum(sizes), 4 + 4 * n).astype(np.uint64))


def pack(blob: bytes, *arrays: np.ndarray) -> bytes:
    """The hash and arrays of 8-byte items in index order as one value."""
    head = struct.pack("<QQ", len(blob), len(arrays))
    return head + blob + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(value: bytes, *kinds: str) -> tuple:
    size, count = struct.unpack_from("<QQ", value)
    mph, at, out = Mph.from_bytes(value[16:16 + size]), 16 + size, []
    for kind in kinds[:count]:
        out.append(np.frombuffer(value, kind, mph.n, at))
        at += 8 * mph.n
    return mph, *out
