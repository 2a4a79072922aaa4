"""BPE encoding and decoding as bounded-memory streaming transducers.

Encoder.  A merge of lower rank never waits for one of higher rank, so text
to the right changes a token boundary only through a chain of competing
merges: (v, w) taking v before (u, v), with (u, v) ranked after (v, w), frees
u for merges ranked later still, and so on.  ``lookahead`` is the longest
such chain of the merge list in symbols, found by one pass over the list.  A
boundary with that many symbols behind it is stable: its tokens go out and
the transducer goes on from there with at most BUFFER + lookahead symbols
held, however long the word.  A boundary that no merge crosses splits the
encoding into two independent ones, so the ids are those of the whole word.

Decoder.  ``Decoder.feed`` turns ids into text as they come.  In its byte
form, byte symbols pass an incremental UTF-8 machine that holds an unfinished
character, and the end-of-word mark gives a space.  A tokenizer file without a
decoder asks for the spaced form: token strings with one space between, for
which the machine holds whether a token went out before.  The vocabulary's file
is of that kind, so the query decodes in the spaced form, DECODED ids at a time.

Normalising and splitting into words follow the tokenizer file, through the
library's own normaliser and pre-tokenizer on one white-space chunk at a time
(neither reaches across white space).

Defined results: a null or empty text has no ids; special tokens written in
the text get their ids, as in the library; ids may be null or repeated.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ChunkEncoder, symbols

BUFFER = 256
DECODED = 1 << 14
NEVER = 1 << 30


def lookahead(merges: list[tuple[str, str]], size: dict[str, int]) -> int:
    """Longest chain of competing merges, in symbols.  ``reach[v]``: symbols
    to the right of the start of v that can decide, by merges seen so far,
    whether v stays free."""
    reach: dict[str, int] = {}
    most = 1
    for u, v in merges:
        chain = size[u] + max(size[v], reach.get(v, 0))
        reach[u] = max(reach.get(u, 0), chain)
        most = max(most, chain)
    return most


class Transducer:
    """``encode`` takes symbols one by one and gives ids once stable."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(merges)}
        size = {t: len(t.removesuffix(self.suffix)) or 1 for t in self.vocab}
        self.lookahead = lookahead(merges, size)
        self.strings = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.spaced = spec["decoder"] is None
        self.strings.update({i: t for t, i in self.special.items()})

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges of a finite run of symbols, lowest rank first and
        leftmost first among equals."""
        n, rank = len(symbols), self.rank
        if n < 2:
            return symbols
        if n <= 64:  # scanning the few ranks beats a heap
            parts = list(symbols)
            ranks = [rank.get(p, NEVER) for p in zip(parts, parts[1:], strict=False)]
            while ranks and (best := min(ranks)) != NEVER:
                i = ranks.index(best)
                parts[i] += parts[i + 1]
                del parts[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = rank.get((parts[i - 1], parts[i]), NEVER)
                if i < len(ranks):
                    ranks[i] = rank.get((parts[i], parts[i + 1]), NEVER)
            return parts
        parts, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, (u, v) = heapq.heappop(heap)
            j = after[i]
            if parts[i] != u or j >= n or parts[j] != v:
                continue
            parts[i], parts[j] = u + v, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (parts[a], parts[b])) in rank:
                    heapq.heappush(heap, (rank[p], a, p))
        return [p for p in parts if p]

    def encode(self, symbols: Iterable[str], buffer: int = BUFFER) -> Iterator[int]:
        """Ids of one word given as byte symbols, the last with the suffix."""
        held: list[str] = []
        for s in symbols:
            held.append(s)
            if len(held) >= buffer + self.lookahead:
                stable, done = len(held) - self.lookahead, 0
                for t in self.merge(held):
                    if done + len(t) > stable:
                        break
                    done += len(t)
                    yield self.vocab[t]
                held = held[done:]
        for t in self.merge(held):
            yield self.vocab[t]

    def word(self, text: str) -> list[int]:
        symbols = [*text[:-1], text[-1] + self.suffix]
        if len(symbols) <= BUFFER:  # ends before anything could go out
            return [self.vocab[t] for t in self.merge(symbols)]
        return list(self.encode(symbols))


class Decoder:
    """Ids to text, piece by piece; holds at most one unfinished character, or
    in the spaced form one flag."""

    def __init__(self, transducer: Transducer, spaced: bool = False):
        self.t, self.spaced, self.begun = transducer, spaced, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.byte = {s: b for b, s in enumerate(symbols())}

    def feed(self, ids: Iterable[int]) -> str:
        if self.spaced:
            tokens = list(map(self.t.strings.__getitem__, ids))
            lead = [""] if self.begun and tokens else []
            self.begun = self.begun or bool(tokens)
            return " ".join(lead + tokens)
        out = []
        for i in ids:
            token = self.t.strings[i]
            if token in self.t.special:
                out.append(self.utf8.decode(b"", True) + token)
                continue
            own = token.removesuffix(self.t.suffix)
            out.append(self.utf8.decode(bytes(self.byte[c] for c in own)))
            if own != token:
                out.append(self.utf8.decode(b" "))
        return "".join(out)

    def end(self) -> str:
        return self.utf8.decode(b"", True)


class TextCoder(ChunkEncoder):
    """Texts to ids and back; words through the transducer."""

    def __init__(self, path: str):
        self.t = Transducer(path)
        super().__init__(path, self.t.word)
        self.decimal = [str(i) for i in range(max(self.t.strings) + 1)]

    def decoded(self, ids: list[int]) -> Iterator[str]:
        machine = Decoder(self.t, self.t.spaced)
        for at in range(0, len(ids), DECODED):
            yield machine.feed(ids[at:at + DECODED])
        yield machine.end()

    def texts(self, texts: Iterable[str | None], digests: bool = False) -> Iterator[tuple[int, str, str]]:
        """(number of ids, decimal ids, decoded text) of each text, or the
        sha256 of the last two; a digest takes the decoder's pieces as they
        come."""
        for ids in self.encode_all(texts):
            own = ids.tolist()
            coded = " ".join(map(self.decimal.__getitem__, own))
            if not digests:
                yield len(own), coded, "".join(self.decoded(own))
                continue
            digest = hashlib.sha256()
            for piece in self.decoded(own):
                digest.update(piece.encode())
            yield len(own), hashlib.sha256(coded.encode()).hexdigest(), digest.hexdigest()


@lru_cache(maxsize=2)
def coder(path: str) -> TextCoder:
    return TextCoder(path)


def encode_texts(docs: DataFrame, path: str, ids_column: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as decimal numbers joined by one
    space, decoded as the library decodes them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for part in parts:
            rows = c.texts((x.as_py() for x in part["text"]), not ids_column)
            ids = part["doc_id"].to_pylist()
            while ids:
                n, coded, decoded = zip(*islice(rows, 128), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[:len(n)], pa.int64()), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                                                 names=["doc_id", "n_tokens", "ids", "decoded"])
                ids = ids[len(n):]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def query(docs: DataFrame, path: str) -> DataFrame:
    """Digests are taken where the ids are, so ids do not travel to the JVM."""
    d = encode_texts(docs, path, ids_column=False)
    return d.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
