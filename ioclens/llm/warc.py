"""WARC archives: writing pages, normalising monolithic gzip files, reading
by a sidecar offset index.

A monolithic file is one gzip stream over many records, so no record can be
read without inflating all before it.  ``normalise`` inflates each such file
once as a stream, rewrites every record as a gzip member of its own, and
writes ``<file>.idx`` beside it: a line with offset, length, type and id of
each member.  Record bodies pass in pieces, so memory does not grow with a
record or a file.

Writing: of records with equal payloads (by SHA-1) of at least ``min_bytes``
bytes, that with the largest page_id is the response and the others are
revisits of it, holding the HTTP header only.  The largest id of each payload
comes from an aggregate with map-side combining; its join back to the pages
is salted, so a payload that a third of all pages share is spread out.

Files get names of their own in the shared folder and count only once the
task that wrote them succeeded, so a repeated task does no harm.

Defined results: a null html is an empty payload; a page without id revisits
the response of its payload, or is a response if no page of that payload has
an id; rows that share the largest page_id are all responses; a null url
becomes the page's URN; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, shared_file, stored

SALTS = 32
#: Uncompressed bytes of an archive before the next one begins, bytes read
#: at a time, and the gzip level.
FILE_BYTES = 64 << 20
PIECE = 1 << 20
LEVEL = 6
GZIP = 31  # zlib's window bits for a gzip header and trailer
DATE = "1970-01-01T00:00:00Z"  # the pages carry no time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

FILES = "path string, n_records long"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit."""
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:page:none-{uuid.uuid5(uuid.NAMESPACE_URL, str(url) + sha1.hex())}"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or name)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def judged(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to) of each page."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload")) \
        .withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 AND largest IS NOT NULL").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rows = rows.join(first.drop("n"), ["sha1", "salt"], "left")
    return rows.select("page_id", "url", "payload", "sha1", F.when(~F.col("largest").eqNullSafe(F.col("page_id")), F.col("largest")).alias("refers_to"))


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Monolithic archives of rows of ``judged``: (path, n_records), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, packer, size, n, done = None, "", None, 0, 0, []

        def close() -> None:
            out.write(packer.flush())
            out.close()
            done.append((path, n))

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                cols = (batch[c].slice(at, 64).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to"))
                for row in zip(*cols, strict=True):
                    if out is None or size >= FILE_BYTES:
                        if out is not None:
                            close()
                        path = f"{folder}/whole-{uuid.uuid4().hex}.warc.gz"
                        fs, where = shared_file(path)
                        fs.create_dir(where.rpartition("/")[0], recursive=True)
                        out, packer, size, n = fs.open_output_stream(where, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0, 0
                    own = record(*row)
                    out.write(packer.compress(own))
                    size, n = size + len(own), n + 1
        if out is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], names=["path", "n_records"])

    return stored(rows.mapInArrow(run, FILES), "warc-whole")


class Inflated:
    """The bytes of a gzip file, inflated as they are asked for; the file may
    hold one member or many."""

    def __init__(self, file):
        self.file, self.unzip, self.held, self.ended = file, zlib.decompressobj(GZIP), bytearray(), False

    def more(self) -> bool:
        """Inflates one more piece; False at the end."""
        if self.ended:
            return False
        raw = self.unzip.unconsumed_tail or self.unzip.unused_data or self.file.read(PIECE)
        if self.unzip.eof and raw:
            self.unzip = zlib.decompressobj(GZIP)
        if raw:
            self.held += self.unzip.decompress(raw, PIECE)
        else:  # output that was held back for its size
            self.held += self.unzip.flush()
            self.ended = True
            if not self.unzip.eof:
                raise ValueError("the gzip stream is cut short")
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        at = 0
        while (end := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record's header")
                return None
        out = bytes(self.held[:end + len(mark)])
        del self.held[:end + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes."""
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends within a record")
            out = bytes(self.held[:n])
            del self.held[:n]
            n -= len(out)
            if out:
                yield out


def rewrite(source, target) -> list[tuple[int, int, str, str]]:
    """Each record of the open file ``source`` as a member of ``target``;
    (offset, length, type, id) of each."""
    stream, at, index = Inflated(source), 0, []
    while (head := stream.until(END)) is not None:
        head = head.lstrip(b"\r\n")
        own = fields(head)
        packer, length = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0
        length += target.write(packer.compress(head)) or 0
        for piece in stream.pieces(int(own["content-length"]) + len(END)):
            length += target.write(packer.compress(piece)) or 0
        length += target.write(packer.flush()) or 0
        index.append((at, length, own["warc-type"], own["warc-record-id"]))
        at += length
    return index


class _Counted:
    """An output stream whose write gives the bytes written."""

    def __init__(self, out):
        self.out = out

    def write(self, data: bytes) -> int:
        if data:
            self.out.write(data)
        return len(data)


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Normalised archives with sidecar indexes, one for each file: (path,
    n_records), stored.  Files go to tasks one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                fs, where = shared_file(path)
                name = f"{folder}/members-{uuid.uuid4().hex}.warc.gz"
                _, to = shared_file(name)
                fs.create_dir(to.rpartition("/")[0], recursive=True)
                with fs.open_input_stream(where, compression=None) as source, fs.open_output_stream(to, compression=None) as target:
                    index = rewrite(source, _Counted(target))
                with fs.open_output_stream(to + ".idx") as side:
                    side.write("".join(f"{o} {n} {kind} {rid}\n" for o, n, kind, rid in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64())], names=["path", "n_records"])

    return stored(files.select("path").repartition(max(1, files.count())).mapInArrow(run, FILES), "warc-members")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def page_of(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def parse(member: bytes) -> tuple:
    """A row of RECORDS.  Size and digest of a revisit are those its header
    states; those of a response are taken from its payload."""
    head, _, block = member.partition(END)
    own = fields(head)
    http, _, payload = block[:int(own["content-length"])].partition(END)
    if own["warc-type"] == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if f"sha1:{digest}" != own["warc-payload-digest"]:
            raise ValueError(f"payload of {own['warc-record-id']} does not match its digest")
    else:
        size, digest, payload = int(fields(http)["content-length"]), own["warc-payload-digest"].removeprefix("sha1:"), None
    return (page_of(own["warc-record-id"]), size, digest, own["warc-type"], page_of(own.get("warc-refers-to")), own["warc-target-uri"], payload)


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORDS of normalised archives, each member read at its indexed place."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                fs, where = shared_file(path)
                with fs.open_input_stream(where + ".idx") as side:
                    places = [tuple(map(int, x.split(b" ", 2)[:2])) for x in side.read().splitlines()]
                with fs.open_input_file(where) as file:
                    for at in range(0, len(places), 64):
                        rows = [parse(zlib.decompress(file.read_at(n, o), GZIP)) for o, n in places[at:at + 64]]
                        if not payloads:
                            rows = [(*r[:-1], None) for r in rows]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path").repartition(max(1, files.count())).mapInArrow(run, RECORDS)


def query(pages: DataFrame) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc")
    members = normalise(write(judged(pages), folder), folder)
    return read(members, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
b AS (SELECT page_id, h, s, array_to_string(list_transform(range(1, 41), lambda i:
        ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(s, i, 1))]), '') AS bits,
        max(page_id) OVER (PARTITION BY s) AS largest FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(substr(bits, 5 * k + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * k + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * k + 3, 1) AS INT)
           + 2 * CAST(substr(bits, 5 * k + 4, 1) AS INT) + CAST(substr(bits, 5 * k + 5, 1) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM b
"""
