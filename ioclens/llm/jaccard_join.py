"""N-gram Jaccard join with set-relation skipping, giving components.

A document's set is its distinct shingles (see ``shingles``); two documents
link when 100 * |intersection| >= 75 * |union|, and the result is each
document's component under links.

Plan.
(1) Equal sets become one node, named by a hash of the set, so exact copies
    never meet in a list.  The same pass counts shingles that many documents
    hold (exact over blocks of documents); these sort last in the one order
    all sets follow.  The order changes cost only, never results.
(2) Prefix index: sets that link share one of their first n - ceil(.75n) + 1
    shingles in that order, so only these are listed, as (shingle, node,
    size, position).  A frequent shingle's list is salted.
(3) Leaders: each list's first node is compared with the list's other nodes,
    one row a posting however long the list, and links make components.
(4) The rest of a list is ordered by size and position and cut into runs of
    RUN nodes with a header (least size, most size, least position); pairs of
    runs that no two sizes or no two positions allow to link are skipped by
    their headers, as are, one by one, nodes of one component and nodes whose
    answer follows from their leader's: where y holds c of the leader's
    shingles and z at most d, y and z share at most min(c, d) of these and
    the |y| - c that y has besides, so the leader's computed answers and the
    difference of two sets settle the pair.  Lists of one leader are joined
    together, so a pair that meets in many comes out once.  Lists longer than
    BLOCK are dealt to pairs of blocks by hash, and the lists of a leader of
    more than GROUP rows a block to parts by shingle, so that no task holds
    more than about 2 * GROUP rows of numbers.
(5) Candidates are cut by an upper bound from bitmaps of the sets, then
    counted exactly on the whole sets.

Nothing is sampled or capped; only fixed-size things reach the driver: a
bounded list of frequent shingles and a bitmap of FILTER_BITS.

Defined results: a null or empty text has the empty set and is its own
component; rows sharing a doc_id are one document each; a null doc_id never
names a component unless all of it are null; an empty table gives an empty
result.  Sets are named by 62 bits of a 128-bit hash; sets that share a name
but not the rest of the hash, about one pair among 10**9 sets, get names of
their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import stored
from .shingles import text_sets

LINK = 75  # per cent
#: A shingle is frequent from so many sets on, counted over blocks of
#: BLOCK_TOKENS shingles that hold it LOCAL times; of these, the order puts
#: the FREQUENT_MOST most frequent last.  A list has a salt for each
#: SALT_ROWS of its nodes.
FREQUENT = 32
LOCAL = 2
BLOCK_TOKENS = 6 << 20
FREQUENT_MOST = 1 << 18
SALT_ROWS = 1 << 13
LAST = 1 << 62  # added to frequent shingles
BLOCK = 2048
GROUP = 1 << 18
RUN = 64
EXPAND = 1 << 17
NAME_BITS = 62
FILTER_BITS = 1 << 23


def prefix_size(n: int) -> int:
    return n - -(-LINK * n // 100) + 1


def overlap_needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least intersection with 100 i >= LINK (n + m - i)."""
    return -(-LINK * (n + m) // (100 + LINK))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


#: (name, check) -> another name, for sets whose names clash.
Renames = dict[tuple[int, int], int]


def _name(own: np.ndarray, bits: int) -> tuple[int, int]:
    """A set's name and the rest of its hash."""
    digest = xxhash.xxh3_128_intdigest(own.tobytes())
    return digest & (1 << bits) - 1, digest >> 65


def _node(own: np.ndarray, bits: int, renames: Renames) -> int:
    name, check = _name(own, bits)
    return renames.get((name, check), name)


def _batch(schema: pa.Schema, *cols: np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _longs(names: str) -> tuple[str, pa.Schema]:
    return ", ".join(f"{n} long" for n in names.split()), pa.schema([(n, pa.int64()) for n in names.split()])


# (1) documents to nodes, and frequent shingles -------------------------------

FACTS = "doc_id long, n long, node long, check long, bits binary, shingle long, seen long"
FACTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("bits", pa.binary()), ("shingle", pa.int64()), ("seen", pa.int64())])


def _facts(name_bits: int) -> Callable:
    """A row for each document, and a row with (shingle, seen) for each
    shingle that is frequent in a block of different sets."""

    def frequent(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= LOCAL
        none = [None] * int(often.sum())
        return _batch(FACTS_ARROW, none, none, none, none, none, tokens[often].astype(np.int64), counts[often])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0
        for batch in batches:
            n, names, bits = [], [], []
            for own in text_sets(batch["text"]):
                n.append(len(own))
                bits.append(bitmap(own).tobytes() if len(own) else None)
                names.append(_name(own, name_bits) if len(own) else (None, None))
                if len(own) and names[-1] not in held:
                    held[names[-1]] = own
                    size += len(own)
                    if size >= BLOCK_TOKENS:
                        yield frequent(list(held.values()))
                        held, size = {}, 0
            none = [None] * len(n)
            yield _batch(FACTS_ARROW, batch["doc_id"].to_pylist(), n, [x for x, _ in names], [x for _, x in names], bits, none, none)
        if held:
            yield frequent(list(held.values()))

    return run


def _renames(clashes: DataFrame) -> Renames:
    """New names, beyond all hashed ones, for the sets of clashing names: as
    many as names of NAME_BITS clash, which no corpus makes many."""
    return {(r.node, r.check): (1 << NAME_BITS) + k for k, r in enumerate(clashes.select("node", "check").distinct().orderBy("node", "check").toLocalIterator())}


# (2) prefix index -------------------------------------------------------------

POSTING, POSTING_ARROW = _longs("shingle place node size pos")
#: ``place``: salt * RARE + how much of the set is not frequent, in 1 / RARE.
RARE = 1024


def _postings(often: np.ndarray, salts: np.ndarray, bits: int, renames: Renames) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            rows = 0
            for own in text_sets(batch["text"]):
                n = len(own)
                if not n or (node := _node(own, bits, renames)) in seen:
                    continue
                if len(seen) > 1 << 17:
                    seen.clear()
                seen.add(node)
                own = ordered(own, often)
                rare = int(np.searchsorted(own, LAST))
                own = own[:prefix_size(n)]
                place = np.full(len(own), rare * (RARE - 1) // n)
                if rare < len(own):
                    place[rare:] += node % salts[np.searchsorted(often, own[rare:] - LAST)] * RARE
                for c, v in zip(cols, (own, place, np.full(len(own), node), np.full(len(own), n), np.arange(len(own))), strict=True):
                    c.append(v)
                rows += len(own)
                if rows > 1 << 17:
                    yield _batch(POSTING_ARROW, *map(np.concatenate, cols))
                    cols, rows = [[], [], [], [], []], 0
            if rows:
                yield _batch(POSTING_ARROW, *map(np.concatenate, cols))

    return run


def ordered(own: np.ndarray, often: np.ndarray) -> np.ndarray:
    """A set in the order of all sets: frequent shingles last."""
    own = own.astype(np.int64)
    if not len(often):
        return own
    late = often[np.minimum(np.searchsorted(often, own), len(often) - 1)] == own
    return np.concatenate([own[~late], own[late] + LAST])


ENTRY, ENTRY_ARROW = _longs("shingle node size pos leader leader_size more")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (shingle, place, node): lists of two or more nodes
    with their first node as leader, that with the least rare shingles.  Frequent shingles keep lists of one,
    as other salts have more.  ``more``: the list has, or may have, nodes
    that were not compared by comparing each with the leader.  Holds a batch
    and one row at a time."""
    none = np.zeros((0, 5), np.int64)
    held, run = none, None  # a first row that may stay alone; or the open list (shingle, salt, leader, size, last node)
    for batch in filter(len, batches):
        rows = np.column_stack([batch[c].to_numpy() for c in ("shingle", "place", "node", "size", "pos")])
        rows[:, 1] //= RARE
        rows = np.concatenate([held, rows])
        if run is not None:
            rows = np.concatenate([np.array([[run[0], run[1], run[4], 0, 0]]), rows])  # the row before, to compare with
        again = np.r_[False, (rows[1:, :3] == rows[:-1, :3]).all(1)]
        rows = rows[~again]
        new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(rows)])
        first = np.repeat(start, size)
        leader, leader_size = rows[first, 2], rows[first, 3]
        keep = (np.repeat(size, size) > 1) | (rows[:, 0] >= LAST)
        more = (np.repeat(size, size) > 2) | (rows[:, 0] >= LAST)
        more[start[-1]:] = True  # the list may go on
        if run is not None:
            own = size[0]
            leader[:own], leader_size[:own] = run[2], run[3]
            keep[:own] = more[:own] = True
            keep[0] = False  # went out before
        end = rows[-1]
        if size[-1] == 1 and end[0] < LAST and not (run is not None and len(start) == 1):
            held, run = rows[-1:], None
        else:
            held, run = none, (end[0], end[1], leader[-1], leader_size[-1], end[2])
        if keep.any():
            yield _batch(ENTRY_ARROW, rows[keep, 0], rows[keep, 2], rows[keep, 3], rows[keep, 4], leader[keep], leader_size[keep], more[keep].astype(np.int64))


# (5) candidates to links --------------------------------------------------------

def bitmap(own: np.ndarray) -> np.ndarray:
    """Packed bits of the buckets that a set's top bits fall in, two to four
    times as many as its members (a power of two, so that one can be folded
    to a smaller one)."""
    buckets = max(64, 1 << (2 * len(own)).bit_length())
    bits = np.zeros(buckets, bool)
    bits[(own >> np.uint64(62 - (buckets.bit_length() - 1))).astype(np.int64)] = True
    return np.packbits(bits)


def bound(a: np.ndarray, b: np.ndarray, n: int, m: int) -> int:
    """At least the size of the intersection: a bucket that only one set has
    holds a member that the other lacks."""
    if len(a) != len(b):
        x, y = np.unpackbits(a), np.unpackbits(b)
        while len(x) > len(y):
            x = x.reshape(-1, 2).max(1)
        while len(y) > len(x):
            y = y.reshape(-1, 2).max(1)
        a, b = np.packbits(x), np.packbits(y)
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))


def _sets(wanted: np.ndarray, bits: int, renames: Renames) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, members = [], []
            for own in text_sets(batch["text"]):
                if not len(own):
                    continue
                node = _node(own, bits, renames)
                bit = node % FILTER_BITS
                if wanted[bit >> 3] >> (bit & 7) & 1 and node not in seen:
                    if len(seen) > 1 << 17:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    members.append(own.tobytes())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(members, pa.binary())], names=["node", "members"])

    return run


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """A bit for each node modulo FILTER_BITS: FILTER_BITS / 8 bytes however
    many nodes there are."""
    bit = F.pmod("node", F.lit(FILTER_BITS))
    rows = nodes.groupBy(F.floor(bit / 32768).alias("part")).agg(F.expr(f"bitmap_construct_agg(pmod(node, {FILTER_BITS}) % 32768)").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r["part"] * 4096:(r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


JUDGED = "a long, b long, top double, linked boolean"


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, m = batch["na"].to_pylist(), batch["nb"].to_pylist()
        top = []
        for x, y, a, b in zip(n, m, batch["ha"].to_pylist(), batch["hb"].to_pylist(), strict=True):
            i = bound(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), x, y)
            top.append(i / (x + y - i))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], batch["na"], batch["nb"], pa.array(top, pa.float64())], names=["a", "b", "na", "nb", "top"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        top, linked = [], []
        for a, b in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            i = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            top.append(i / (len(x) + len(y) - i))
            linked.append(100 * i >= LINK * (len(x) + len(y) - i))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(top, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "top", "linked"])


def judge(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, name: str, bits: int, renames: Renames) -> DataFrame:
    """(a, b, top, linked) of candidate pairs; ``top`` is the similarity, or
    an upper bound under the link limit.  ``nodes``: (node, n, bits).  Sets
    are made again from the texts, for the pairs that the bound leaves."""
    both = pairs.join(nodes.toDF("a", "na", "ha"), "a").join(nodes.toDF("b", "nb", "hb"), "b")
    tops = stored(both.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(_bounds, "a long, b long, na long, nb long, top double"), f"tops-{name}", narrow=True)
    limit = LINK / 100 - 1e-9
    near = tops.where(F.col("top") >= limit).select("a", "b")
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(texts.mapInArrow(_sets(_bitmap(ends), bits, renames), "node long, members binary").dropDuplicates(["node"]), f"sets-{name}")
    exact = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(_exact, JUDGED)
    far = tops.where(F.col("top") < limit).select("a", "b", "top", F.lit(False).alias("linked"))
    return stored(exact.unionByName(far), f"judged-{name}", narrow=True)


# (4) the rest of the lists ------------------------------------------------------

PAIR, PAIR_ARROW = _longs("a b")


def run_pairs(group: np.ndarray, size: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, end, i, j, skipped): the runs of rows sorted by (group, size,
    pos), the pairs of runs of a group whose headers leave a link possible,
    and how many pairs they rule out."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    count = np.diff(np.r_[start, len(group)])
    runs = -(-count // RUN)
    before = np.cumsum(runs) - runs
    list_of = np.repeat(np.arange(len(start)), runs)
    first = start[list_of] + RUN * (np.arange(len(list_of)) - before[list_of])
    end = np.minimum(first + RUN, (start + count)[list_of])
    least, most, early = size[first], size[end - 1], np.minimum.reduceat(pos, first)
    onward = (before + runs)[list_of] - np.arange(len(list_of))
    i = np.repeat(np.arange(len(list_of)), onward)
    j = i + np.arange(len(i)) - np.repeat(np.cumsum(onward) - onward, onward)
    # the latest place that a link leaves rises with a set's own size and falls with the other's
    ok = (LINK * least[j] <= 100 * most[i]) & (early[i] <= most[i] - overlap_needed(most[i], least[j])) & (early[j] <= most[j] - overlap_needed(most[j], least[i]))
    return first, end, i[ok], j[ok], int((~ok).sum())


def list_pairs(rows: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, int]:
    """Candidate pairs of rows (group, block, node, size, pos, component,
    leader, leader_size, cross) sorted by (group, size, pos), and the pairs of
    runs skipped.  ``sim``: (linked to the leader, similarity to it or a bound,
    over 1 if unknown) of each row.  ``cross``: only nodes of different blocks
    are paired."""
    none = np.zeros((0, 2), np.int64)
    if not len(rows):
        return none, 0
    group, block, node, size, pos, comp, leader, leader_size, cross = rows.T
    top = np.minimum(sim[:, 1], 1.0)
    common = np.minimum(np.floor(top * (size + leader_size) / (1 + top) + 1e-6).astype(np.int64), np.minimum(size, leader_size))
    tied = sim[:, 0] > 0  # its common count is exact, of others it is a bound
    first, end, p, q, skipped = run_pairs(group, size, pos)
    wide = (end - first)[q]
    total = (end - first)[p] * wide
    stop, at, out = np.cumsum(total), 0, [none]
    while at < len(p):
        done = stop[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(stop, done + EXPAND, side="right")))
        of = np.repeat(np.arange(at, to), total[at:to])
        k = np.arange(len(of)) - (stop[of] - total[of] - done)
        i, j = first[p[of]] + k // wide[of], first[q[of]] + k % wide[of]
        need = overlap_needed(size[i], size[j])
        ok = (i < j) & (pos[i] <= size[i] - need) & (pos[j] <= size[j] - need) & (comp[i] != comp[j]) & ((cross[i] == 0) | (block[i] != block[j]))
        i, j, need = i[ok], j[ok], need[ok]
        ok = np.ones(len(i), bool)
        same = leader[i] == leader[j]
        for x, y in ((i, j), (j, i)):  # what x has of the leader is known, and what it has besides
            ok &= ~(same & tied[x] & (np.minimum(common[x], common[y]) + size[x] - common[x] < need))
        a, b = node[i[ok]], node[j[ok]]
        out.append(np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0))
        at = to
    return np.unique(np.concatenate(out), axis=0), skipped


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (family, part, b1, b2, shingle, size, pos): the lists of
    a part of a family's two blocks are joined together, so a pair that meets
    in many of them comes out once."""
    kept = None
    names = ("family", "part", "b1", "b2", "shingle", "bucket", "node", "size", "pos", "component", "leader", "leader_size", "cross")

    def pairs(rows: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[0, (rows[1:, :5] != rows[:-1, :5]).any(1)])
        found, _ = list_pairs(np.column_stack([group, rows[:, 5:]]), sim)
        return _batch(PAIR_ARROW, found[:, 0], found[:, 1])

    for batch in filter(len, batches):
        rows = np.column_stack([batch[c].to_numpy() for c in names])
        sim = np.column_stack([batch[c].to_numpy() for c in ("tied", "top")])
        if kept is not None:
            rows, sim = np.concatenate([kept[0], rows]), np.concatenate([kept[1], sim])
        last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(1))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield pairs(rows[:cut], sim[:cut])
        kept = rows[cut:], sim[cut:]
    if kept is not None and len(kept[0]):
        yield pairs(*kept)


def _open_lists(entries: DataFrame, comps: DataFrame, judged: DataFrame) -> DataFrame:
    """Entries of the lists that hold more than one component, with what is
    known of each node and its leader, dealt to parts of families and block
    pairs.
    Lists of one leader are a family (they share most of their nodes); a list
    with several, as it is salted, is one by itself."""
    rows = entries.where(F.col("more") == 1).where((F.col("node") != F.col("leader")) | (F.col("shingle") >= LAST)).drop("more")
    rows = rows.join(comps.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lists = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"),
                                        F.min("leader").alias("l0"), F.max("leader").alias("l1"))
    lists = lists.where("c0 < c1").select("shingle", "n", F.when(F.col("l0") == F.col("l1"), F.col("l0")).otherwise(-1 - F.col("shingle")).alias("family"))
    families = lists.groupBy("family").agg(F.ceil(F.max("n") / BLOCK).alias("blocks"), F.sum("n").alias("rows"))
    families = families.select("family", "blocks", F.ceil(F.col("rows") / F.col("blocks") / GROUP).alias("parts"))
    lists = lists.drop("n").join(families, "family")
    known = judged.select(F.col("a").alias("leader"), F.col("b").alias("node"), "top", F.col("linked").cast("double").alias("tied"))
    rows = rows.join(lists, "shingle").join(known, ["leader", "node"], "left")
    self_ = F.col("leader") == F.col("node")
    rows = rows.withColumn("top", F.when(self_, 1.0).otherwise(F.coalesce("top", F.lit(2.0)))) \
        .withColumn("tied", F.when(self_, 1.0).otherwise(F.coalesce("tied", F.lit(0.0)))) \
        .withColumn("bucket", F.pmod(F.xxhash64("node"), "blocks")).withColumn("part", F.pmod(F.xxhash64("shingle"), "parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn("b1", F.least("bucket", "other")).withColumn("b2", F.greatest("bucket", "other")) \
        .withColumn("cross", (F.col("b1") != F.col("b2")).cast("long"))


# all ------------------------------------------------------------------------------

def groups(docs: DataFrame, bits: int = NAME_BITS) -> DataFrame:
    """(doc_id, n, own) for each input row: its set's size and the name of
    its component (null for the empty set).  ``bits``: of a set's name."""
    texts = _texts(docs)
    facts = stored(texts.mapInArrow(_facts(bits), FACTS), "jaccard-facts")
    sets = facts.where("node IS NOT NULL").select("node", "check", "n", "bits")
    nodes = stored(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), (F.min("check") < F.max("check")).alias("clash")), "jaccard-nodes")
    renames = _renames(sets.join(nodes.where("clash").select("node"), "node", "left_semi")) if not nodes.where("clash").isEmpty() else {}
    if renames:
        new = docs.sparkSession.createDataFrame([(*k, v) for k, v in renames.items()], "node long, check long, new long")
        facts = facts.join(F.broadcast(new), ["node", "check"], "left").withColumn("node", F.coalesce("new", "node"))
        nodes = stored(facts.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "jaccard-nodes")
    nodes = nodes.select("node", "n", "bits")
    members = facts.where("n IS NOT NULL").select("doc_id", "n", "node")
    often = facts.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("seen")) \
        .where(F.col("seen") >= FREQUENT).orderBy(F.desc("seen"), "shingle").limit(FREQUENT_MOST).toArrow()
    by = np.argsort(often["shingle"].to_numpy())
    often, salts = often["shingle"].to_numpy()[by], often["seen"].to_numpy()[by] // SALT_ROWS + 1

    postings = texts.mapInArrow(_postings(often, salts, bits, renames), POSTING).withColumn("salt", F.floor(F.col("place") / RARE))
    dealt = postings.repartition("shingle", "salt").drop("salt").sortWithinPartitions("shingle", "place", "node")
    entries = stored(dealt.mapInArrow(_lists, ENTRY), "jaccard-lists")

    first = entries.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"), F.col("leader_size").alias("na"), F.col("size").alias("nb"))
    heads = entries.where((F.col("node") == F.col("leader")) & (F.col("shingle") >= LAST)).select("shingle", "node", "size")
    top = heads.groupBy("shingle").agg(F.min_by(F.struct("node", "size"), "node").alias("h"))
    heads = heads.join(top, "shingle").where(F.col("node") != F.col("h.node")).select(F.col("h.node").alias("a"), F.col("node").alias("b"), F.col("h.size").alias("na"), F.col("size").alias("nb"))
    fits = (LINK * F.col("na") <= 100 * F.col("nb")) & (LINK * F.col("nb") <= 100 * F.col("na"))
    stars = stored(first.unionByName(heads).where(fits).select("a", "b").distinct(), "leader-pairs", narrow=True)
    judged = judge(texts, nodes, stars, "leaders", bits, renames)
    links = judged.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comps = connected_components(links).select("id", "component")

    dealt = _open_lists(entries, comps, judged).repartition("family", "part", "b1", "b2").sortWithinPartitions("family", "part", "b1", "b2", "shingle", "size", "pos")
    pairs = dealt.select("family", "part", "b1", "b2", "shingle", "bucket", "node", "size", "pos", "component", "leader", "leader_size", "cross", "tied", "top").mapInArrow(_rest, PAIR).distinct()
    pairs = stored(pairs.join(judged.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "rest-pairs", narrow=True)
    more = judge(texts, nodes, pairs, "rest", bits, renames).where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if not more.isEmpty():
        comps = connected_components(links.unionByName(more)).select("id", "component")

    own = F.coalesce("component", "node").alias("own")
    return members.join(comps.toDF("node", "component"), "node", "left").select("doc_id", "n", own)


def components(docs: DataFrame, bits: int = NAME_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each input row."""
    rows = groups(docs, bits)
    least = rows.where("own IS NOT NULL").groupBy("own").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "own", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    return components(docs)


def stage(docs: DataFrame) -> DataFrame:
    """One row of each component stays: that with the smallest id (rows
    without an id come last), and of several such rows any one.  Decided by
    row, so rows that share an id, or have none, stay or go one by one; rows
    with the empty set all stay, as they link with nothing."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "jaccard-rows")
    ids = rows.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("id"))
    of = groups(rows.select(F.col(key).alias("doc_id"), "text")).withColumnRenamed("doc_id", "key").join(ids, "key")
    best = F.min_by("key", F.struct(F.col("id").isNull(), "id", "key"))
    kept = of.where("own IS NOT NULL").groupBy("own").agg(best.alias(key)).select(key)
    kept = kept.unionByName(of.where("own IS NULL").select(F.col("key").alias(key)))
    return rows.join(kept, key, "left_semi").select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i+4] END AS g
      FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.seen) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY ALL
"""
