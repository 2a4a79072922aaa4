import pytest

from ioclens.llm import quote_links as Q

from .helpers import SMALL

TALK = "conv_id long, turn long, role string, text string"


def links(spark, rows):
    return {(r.conv_id, r.turn): (r.parent, r.n_quoted, r.n_linked, r.root, r.depth) for r in Q.linked(spark.createDataFrame(rows, TALK)).collect()}


def brute(rows):
    rows = {(c, t, r or "unknown", x) for c, t, r, x in rows}
    said, quoted = {}, {}
    for c, t, _, x in rows:
        for level, content in Q.parse(x):
            if p := Q.passage(content):
                (quoted.setdefault((c, t), set()) if level else said.setdefault((c, p), set())).add((level, p) if level else t)
    out = {}
    for c, t in sorted({(c, t) for c, t, _, _ in rows}):
        votes = {}
        for level, p in quoted.get((c, t), ()):
            before = [s for s in said.get((c, p), ()) if s < t]
            if before:
                votes[level, max(before)] = votes.get((level, max(before)), 0) + 1
        parent = max(votes, key=lambda v: (-v[0], votes[v], v[1]))[1] if votes else None
        root, depth = (t, 0) if parent is None else (out[c, parent][3], out[c, parent][4] + 1)
        out[c, t] = (parent, len(quoted.get((c, t), ())), sum(votes.values()), root, depth)
    return out


def test_levels_ties_and_threads(spark, monkeypatch):
    monkeypatch.setattr(Q, "SPAN", 3)
    rows = [(1, 0, "user", "Hello  World\nsecond line"), (1, 1, "assistant", "> hello world\nreply one"), (1, 2, "user", "> > HELLO world\n> Reply one\nthird"),
            (1, 3, "user", "a new subject"), (1, 4, "assistant", ">A new subject\n> > > second line\nyes"), (1, 5, "user", "> not said by anyone\nhm"), (1, 6, None, None),
            (1, 7, "user", "> third\n> yes\ntie goes late"), (1, 9, "user", "> > third\n> nothing\nby level two"), (1, 10, "user", "> myself\nmyself"), (1, 8, "user", "hello world"),
            (1, 11, "user", "> hello world"), (2, 0, "user", "> Hello World"), (2, 1, "user", "> hello world\nx"), (2, 2, "user", ">\n> \n>>"), (1, 20, "user", "> yes\nlate")]
    assert links(spark, rows) == brute(rows)
    assert links(spark, rows)[1, 7][0] == 4 and links(spark, rows)[1, 9][0] == 2 and links(spark, rows)[1, 11][0] == 8


def test_long_chain_and_repeated_passage(spark, monkeypatch):
    monkeypatch.setattr(Q, "SPAN", 16)
    rows = [(7, t, "user", (f"> line {t - 1}\n" if t else "") + f"> ok\nok\nline {t}") for t in range(150)] + [(8, t, "user", "> same\nsame") for t in range(60)]
    assert links(spark, rows) == brute(rows)


def test_whole_table_as_mail(spark):
    talk = spark.read.parquet(f"{SMALL}/conversations.parquet")
    mail = Q.quoting(talk)
    rows = [tuple(r) for r in mail.select("conv_id", "turn", "role", "text").collect()]
    got = {(r.conv_id, r.turn): (r.parent, r.n_quoted, r.n_linked, r.root, r.depth) for r in Q.linked(mail).collect()}
    assert got == brute(rows)
    texts = {(r.conv_id, r.turn): r.text for r in talk.collect()}
    for r in Q.linked(mail).collect():
        assert r.text == texts[r.conv_id, r.turn].strip()


def test_threads_are_in_reply_order(spark, monkeypatch):
    monkeypatch.setattr(Q, "SPAN", 4)
    rows = [(1, 0, "user", "alpha"), (1, 1, "user", "beta"), (1, 2, "assistant", "> alpha\ngamma"), (1, 3, "assistant", "> beta\ndelta"), (1, 6, "user", "> gamma\nepsilon")]
    got = {(r.root, r.segment): (r.turns, r.parents, r.chat) for r in Q.threads(Q.linked(spark.createDataFrame(rows, TALK))).collect()}
    assert got == {(0, 0): ("0,2", "-,0", "<|user|>\nalpha\n<|assistant|>\ngamma\n"), (0, 1): ("6", "2", "<|user|>\nepsilon\n"), (1, 0): ("1,3", "-,1", "<|user|>\nbeta\n<|assistant|>\ndelta\n")}


def test_nulls_repeats_clashes_and_empty(spark):
    talk = spark.createDataFrame([(None, 1, "u", "a", 1), (None, 1, "u", "a", 2), (3, None, "u", "> a", 3), (3, 1, None, None, 4), (3, 1, "u", "b", 5), (3, 1, "u", "b", 6)], TALK + ", root int")
    out = Q.threads(Q.linked(talk)).collect()
    assert sorted((r.conv_id is None, r.turns, r.n_messages) for r in out) == [(False, "-", 1), (False, "1,1", 2), (True, "1", 1)]
    assert Q.query(talk.limit(0)).count() == 0


@pytest.mark.parametrize("line, want", [("> a", (1, "a")), (">> a", (2, "a")), ("> > > a", (3, "a")), ("a > b", (0, "a > b")), (" > a", (0, " > a")), (">", (1, "")), ("", (0, ""))])
def test_parse(line, want):
    assert list(Q.parse(line)) == [want]
