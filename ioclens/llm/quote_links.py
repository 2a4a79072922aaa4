"""Chat formatting by quotation linking.

Lines are parsed into quote levels; normalised quoted lines are hashed and
joined to the messages of the same conversation that say them unquoted; what
a message replies to follows from its quotes; conversations are built in
reply order from the unquoted text.

Rules.  A line's level is the number of ``>`` at its start (a blank may follow
each).  A passage is a line without its marks, A-Z lower-cased, white space
runs made one blank and none at its ends; empty ones do not count.  Each
quoted passage means the latest earlier message of its conversation that says
it at level 0.  A message's parent is the message that most of its passages of
the least level with any match mean; ties go to the later message.  The reply
order is by the turn of the thread's root, then by turn, so a reply follows
what it answers and threads stay together.

Plan: the passages meet in one ordered scan per (conversation, passage, range
of SPAN turns), with the last message of earlier ranges carried over by a
small aggregate, so neither a long conversation nor a passage that all its
messages repeat is one task's work, and no pairs are made.  Roots come from
pointer jumping.  Threads are rendered in segments of at most SPAN turns.

Defined results: equal rows count once; rows sharing conversation and turn
share their links; a null text says nothing; a row without conversation or
turn is a thread of its own; a null role is ``unknown``; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SPAN = 1024
MARKS = re.compile(r"(?:> ?)+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}

LINES = "conv_id long, turn long, level int, hi long, lo long"


def parse(text: str | None) -> Iterator[tuple[int, str]]:
    """(level, content) of each line."""
    for line in (text or "").split("\n"):
        m = MARKS.match(line)
        yield (m[0].count(">"), line[m.end():]) if m else (0, line)


def passage(content: str) -> str:
    return SPACE.sub(" ", content.translate(UPPER)).strip(" ")


def unquoted(text: str | None) -> str:
    """The level 0 lines, without white space around them."""
    return "\n".join(c for level, c in parse(text) if not level).strip(" \t\n\v\f\r")


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for conv, turn, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "text")), strict=True):
            for level, key in sorted({(level, p) for level, c in parse(text) if (p := passage(c))}):
                rows.append((conv, turn, level, *np.frombuffer(xxhash.xxh3_128_digest(key.encode()), "<i8").tolist()))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in LINES.split(", ")])


def quoted_from(lines: DataFrame) -> DataFrame:
    """Each quoted passage (level > 0) with ``source``, the latest earlier
    turn of its conversation that says it, or null."""
    place = ["conv_id", "hi", "lo"]
    lines = lines.withColumn("span", F.floor(F.col("turn") / SPAN))
    said = F.when(F.col("level") == 0, F.col("turn"))
    before = Window.partitionBy(*place, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = lines.withColumn("source", F.max(said).over(before)).where("level > 0")
    ends = lines.groupBy(*place, "span").agg(F.max(said).alias("end"), F.max("level").alias("most"))
    carried = ends.withColumn("carry", F.max("end").over(Window.partitionBy(*place).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.where("carry IS NOT NULL AND most > 0").select(*place, "span", "carry")
    return near.join(carried, [*place, "span"], "left").select("conv_id", "turn", "level", F.coalesce("source", "carry").alias("source"))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, n_quoted, n_linked, root, depth) of each
    conversation and turn."""
    keyed = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "text")
    quotes = quoted_from(keyed.mapInArrow(_passages, LINES).distinct())
    votes = quotes.groupBy("conv_id", "turn", "level", "source").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("source", F.when(F.col("source").isNotNull(), F.struct((-F.col("level")).alias("l"), "n", "source")))
    votes = votes.groupBy("conv_id", "turn").agg(best.alias("parent"), F.sum("n").alias("n_quoted"), F.coalesce(F.sum(F.when(F.col("source").isNotNull(), F.col("n"))), F.lit(0)).alias("n_linked"))
    tree = keyed.select("conv_id", "turn").distinct().join(votes, ["conv_id", "turn"], "left")
    tree = stored(tree.select("conv_id", "turn", "parent", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
                           F.coalesce("parent", "turn").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")), "reply-tree", narrow=True)
    moving, done = tree, tree.limit(0)
    while True:  # each round doubles how far a root is known; rows whose root is final leave
        up = done.unionByName(moving).where("parent IS NOT NULL").select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = moving.join(up, ["conv_id", "root"], "left")
        moved = stored(joined.select("conv_id", "turn", "parent", "n_quoted", "n_linked", F.coalesce("next", "root").alias("root"),
                                     (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "reply-tree", narrow=True)
        done = done.unionByName(moved.where("NOT moved").drop("moved"))
        moving = moved.where("moved").drop("moved")
        if moving.isEmpty():
            return done


def linked(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, parent, n_quoted, n_linked, root, depth):
    each different row, its text without quotes."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit("unknown")).alias("role"), "text").distinct()
    rows = stored(rows, "messages")
    kinds = "conv_id long, turn long, role string, text string"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([unquoted(t) for t in batch["text"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], batch["role"], text], names=["conv_id", "turn", "role", "text"])

    out = rows.mapInArrow(own, kinds).join(links(rows), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", "parent", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
                      F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))


def threads(messages: DataFrame) -> DataFrame:
    """(conv_id, root, segment, n_messages, n_linked, turns, parents, chat):
    threads in reply order, SPAN turns at a time; turns and parents are
    joined by commas ('-' for no parent)."""
    piece = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n"))
    rows = messages.select("conv_id", "root", F.floor(F.col("turn") / SPAN).alias("segment"), "n_linked",
                           F.struct("turn", F.xxhash64("role", "text").alias("h"), F.coalesce(F.col("parent").cast("string"), F.lit("-")).alias("parent"), piece.alias("piece")).alias("m"))
    whole = F.col("conv_id").isNotNull() & F.col("segment").isNotNull()
    some = rows.where(whole).groupBy("conv_id", "root", "segment").agg(F.sum("n_linked").alias("n_linked"), F.sort_array(F.collect_list("m")).alias("m"))
    alone = rows.where(~whole).withColumn("m", F.array("m")).select("conv_id", "root", "segment", "n_linked", "m")
    rows = some.unionByName(alone)
    return rows.select("conv_id", "root", "segment", F.size("m").cast("long").alias("n_messages"), "n_linked",
                       F.array_join(F.transform("m", lambda x: F.coalesce(x["turn"].cast("string"), F.lit("-"))), ",").alias("turns"),
                       F.array_join(F.transform("m", lambda x: x["parent"]), ",").alias("parents"), F.array_join(F.transform("m", lambda x: x["piece"]), "").alias("chat"))


def quoting(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: each message quotes the whole message
    before it and, one level deeper, the first line of the one before that."""
    said = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    ago = lambda k, name: said.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("said").alias(name))
    rows = conversations.select("conv_id", "turn", "role", "text").join(ago(1, "one"), ["conv_id", "turn"], "left").join(ago(2, "two"), ["conv_id", "turn"], "left")
    text = F.concat(F.coalesce(F.concat(F.lit("> > "), F.substring_index("two", "\n", 1), F.lit("\n")), F.lit("")),
                    F.coalesce(F.concat(F.lit("> "), F.replace("one", F.lit("\n"), F.lit("\n> ")), F.lit("\n")), F.lit("")), F.col("text"))
    return rows.select("conv_id", "turn", "role", text.alias("text"))


def query(conversations: DataFrame) -> DataFrame:
    """Applied to the conversations as mail, since the table quotes nothing."""
    t = threads(linked(quoting(conversations)))
    return t.select("conv_id", "root", "segment", "n_messages", "n_linked", "turns", "parents", F.sha2("chat", 256).alias("chat_sha256"))


SQL = r"""
WITH RECURSIVE said AS (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY ALL),
mail AS (SELECT DISTINCT c.conv_id, c.turn, c.role, coalesce('> > ' || split_part(b.said, chr(10), 1) || chr(10), '')
           || coalesce('> ' || replace(a.said, chr(10), chr(10) || '> ') || chr(10), '') || c.text AS text
         FROM conversations c LEFT JOIN said a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN said b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
l AS (SELECT conv_id, turn, role, text, i, line, regexp_extract(line, '^(> ?)+') AS marks
      FROM (SELECT conv_id, turn, role, text, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM mail))),
p AS (SELECT *, length(marks) - length(replace(marks, '>', '')) AS level, substr(line, length(marks) + 1) AS content FROM l),
k AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS key FROM p),
q AS (SELECT a.conv_id, a.turn, a.level, a.key, max(b.turn) AS source FROM k a LEFT JOIN k b ON b.conv_id = a.conv_id AND b.key = a.key AND b.level = 0 AND b.turn < a.turn
      WHERE a.level > 0 AND a.key <> '' GROUP BY ALL),
v AS (SELECT conv_id, turn, level, source, count(*) AS n FROM q GROUP BY ALL),
best AS (SELECT conv_id, turn, source AS parent FROM v WHERE source IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, source DESC) = 1),
num AS (SELECT conv_id, turn, sum(n) FILTER (source IS NOT NULL) AS n_linked FROM v GROUP BY ALL),
r(conv_id, turn, root) AS (SELECT c.conv_id, c.turn, c.turn FROM (SELECT DISTINCT conv_id, turn FROM mail) c
       LEFT JOIN best ON best.conv_id = c.conv_id AND best.turn = c.turn WHERE best.parent IS NULL
     UNION ALL SELECT best.conv_id, best.turn, r.root FROM r JOIN best ON best.conv_id = r.conv_id AND best.parent = r.turn),
own AS (SELECT conv_id, turn, role, text, regexp_replace(coalesce(string_agg(content, chr(10) ORDER BY i) FILTER (level = 0), ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS own
        FROM p GROUP BY conv_id, turn, role, text)
SELECT o.conv_id, r.root, o.turn // 1024 AS segment, count(*) AS n_messages, CAST(sum(coalesce(num.n_linked, 0)) AS BIGINT) AS n_linked,
       string_agg(CAST(o.turn AS VARCHAR), ',' ORDER BY o.turn) AS turns, string_agg(coalesce(CAST(best.parent AS VARCHAR), '-'), ',' ORDER BY o.turn) AS parents,
       sha256(string_agg('<|' || o.role || '|>' || chr(10) || o.own || chr(10), '' ORDER BY o.turn)) AS chat_sha256
FROM own o JOIN r ON r.conv_id = o.conv_id AND r.turn = o.turn LEFT JOIN best ON best.conv_id = o.conv_id AND best.turn = o.turn
     LEFT JOIN num ON num.conv_id = o.conv_id AND num.turn = o.turn
GROUP BY o.conv_id, r.root, o.turn // 1024
"""
