"""Pre-tokens of a byte-level BPE vocabulary and their token ids.

A pre-token is what the vocabulary's pattern cuts from a text; merges never
cross it, so a text's ids are those of its pre-tokens in order.  A pre-token
that spells a whole vocabulary entry need not be merged where that entry is
proven to encode alone as itself (``whole_tokens``); all others are merged
by the library's model, and the results of short ones are kept.

Texts whose characters all lie in STABLE are cut here; the classes of other
characters depend on the Unicode version, so the library cuts those texts.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import regex

from .tokens import symbols

#: The vocabulary's pattern (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose letter, number and white-space classes no Unicode version
#: in use disputes: up to the Greek and Cyrillic letters, general punctuation
#: and signs, CJK, kana and Hangul syllables.
STABLE = "\u0000-՗ -₎₠-₿←-⏾─-⯿ぁ-ゖ゙-ヿ一-龥가-힣！-ﾟ"
ODD = regex.compile(f"[^{STABLE}]")
#: Pre-tokens of more characters than LONG are merged anew each time; at most
#: KEPT results of others are held by a worker.
LONG = 64
KEPT = 300_000


class ByteBpe:
    """``special``: whether special tokens spelt in a text count as such."""

    def __init__(self, path: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.cut, self.model, self.symbol = self.tokenizer.pre_tokenizer, self.tokenizer.model, symbols()
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens must stand for their exact spelling")
        self.special = {t.content: i for i, t in added.items()} if special else {}
        names = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def spelt(self, word: str) -> str:
        return "".join([self.symbol[b] for b in word.encode()])

    def merged(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(self.spelt(word))]

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if text.isascii() or not ODD.search(text):
            return PATTERN.findall(text)
        return [text[i:j] for _, (i, j) in self.cut.pre_tokenize_str(text)]

    def parts(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, how many special tokens stand between them)."""
        if self.marks is None or not self.marks.search(text):
            return self.words(text), 0
        pieces = self.marks.split(text)
        return [w for p in pieces[::2] if p for w in self.words(p)], len(pieces) // 2

    def whole_tokens(self) -> dict[str, int]:
        """Text -> id of the vocabulary entries proven to encode alone as one
        token: the model merges the entry's own bytes back into it.  Entries
        that are not whole characters never equal a pre-token and are left
        out."""
        byte = {s: b for b, s in enumerate(self.symbol)}
        out = {}
        for entry, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            try:
                text = bytes([byte[s] for s in entry]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.merged(text) == [i]:
                out[text] = i
        return out


class Known(dict):
    """Pre-token -> a value: the whole tokens' from the start, those of others
    as they come, by merging."""

    def __init__(self, whole: dict, make: Callable):
        super().__init__(whole)
        self.whole, self.make = whole, make

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= LONG:
            if len(self) >= len(self.whole) + KEPT:
                self.clear()
                self.update(self.whole)
            self[word] = value
        return value


@lru_cache(maxsize=4)
def byte_bpe(path: str, special: bool) -> ByteBpe:
    """One a worker process; kept between tasks."""
    return ByteBpe(path, special)


@lru_cache(maxsize=2)
def proven(path: str) -> dict[str, int]:
    return byte_bpe(path, False).whole_tokens()
