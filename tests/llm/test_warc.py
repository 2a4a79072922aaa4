import base64
import gzip
import hashlib
import io

import pytest

from ioclens.llm import warc as W
from ioclens.session import scratch_path

from .helpers import SMALL

PAGES = "page_id long, url string, html string"


def brute(pages):
    data = [(i, (h or "").encode()) for i, _, h in pages]
    largest = {}
    for i, p in data:
        if i is not None:
            largest[p] = max(largest.get(p, i), i)
    out = []
    for i, p in data:
        top = largest.get(p)
        revisit = top is not None and top != i and sum(q == p for _, q in data) > 1
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_small_cases(spark):
    pages = [(1, "http://a/x y\r\nEvil: 1", "<p>same</p>"), (5, None, "<p>same</p>"), (3, "u", "<p>same</p>"), (2, "u", None), (4, "u", ""), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"),
             (8, "u", "é" * 400_000), (9, "u", "x" * 3_000_000), (None, "u", "<p>same</p>"), (None, "v", "alone"), (5, None, "<p>same</p>"), (-4, "n", "minus")]
    assert got(W.query(spark.createDataFrame(pages, PAGES))) == brute(pages)


def test_whole_table_and_hot_payload(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    pages += [(10_000 + i, f"http://h/{i}", "the same page") for i in range(200)]
    assert got(W.query(spark.createDataFrame(pages, PAGES).repartition(4))) == brute(pages)


def test_min_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "long enough"), (4, "u", "long enough")], PAGES)
    assert {r.page_id: r.refers_to for r in W.judged(pages, min_bytes=5).collect()} == {1: None, 2: None, 3: 4, 4: None}
    assert W.query(pages.limit(0)).count() == 0


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "abc", "x", 3)], PAGES + ", sha1 string, salt int")
    assert got(W.query(pages)) == brute([(1, "u", "abc")])


def test_payloads_come_back_and_members_stand_alone(spark, monkeypatch):
    monkeypatch.setattr(W, "FILE_BYTES", 5000)
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i * 20)) for i in range(40)]
    folder = scratch_path(spark, "warc-test")
    whole = W.write(W.judged(spark.createDataFrame(pages, PAGES).coalesce(2)), folder)
    assert whole.count() > 2
    members = W.normalise(whole, folder)
    assert {r.page_id: r.payload.decode() for r in W.read(members).collect()} == {i: h for i, _, h in pages}
    for r in members.collect():
        fs, where = W.shared_file(r.path)
        with fs.open_input_file(where) as f, fs.open_input_stream(where + ".idx") as side:
            places = [x.split() for x in side.read().decode().splitlines()]
            assert len(places) == r.n_records
            for offset, length, kind, name in places:
                one = gzip.decompress(f.read_at(int(length), int(offset)))
                assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and name.encode() in one and kind.encode() in one


@pytest.mark.parametrize("piece", [7, 1000, 1 << 20])
def test_stream_of_many_members_and_cut_files(monkeypatch, piece):
    monkeypatch.setattr(W, "PIECE", piece)
    records = [W.record(i, "u", b"p" * i * 50, hashlib.sha1(b"p" * i * 50).digest(), None) for i in range(30)]
    for source in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records[:9])) + gzip.compress(b"".join(records[9:]))):
        out = io.BytesIO()
        index = W.rewrite(io.BytesIO(source), out)
        assert [gzip.decompress(out.getvalue()[o:o + n]) for o, n, _, _ in index] == records
    with pytest.raises(ValueError):
        W.rewrite(io.BytesIO(gzip.compress(b"".join(records))[:-30]), io.BytesIO())
    with pytest.raises(ValueError):
        W.rewrite(io.BytesIO(gzip.compress(b"".join(records)[:-300])), io.BytesIO())
