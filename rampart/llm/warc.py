"""WARC archives: written a file a task, read in parallel byte ranges.

A WARC file is a chain of records, each as long as its header says.  To read
one file with many tasks, every task searches its byte range for the version
line that begins a record and emits each candidate with its successor, the
place where its header says the next record begins.  A payload may hold the
same line, even a whole archive, so a candidate proves nothing; only what the
chain from the start of the file reaches is a record.  The chain is followed
by pointer jumping: first inside each range (a candidate's exit is the first
place behind the range on its chain), then over ranges in Spark, where every
round doubles the length of the jumps.  Each range's true entry is then known
and its records are read one after the other.

Equal payloads are written once: one record is the response, the others are
revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import bounded_broadcast, partitions, prepare
from rampart.llm.tokenstore import open_fs
from rampart.session import shared_dir, write_table

RANGE = 8 << 20             # bytes of an archive that one task searches
PIECE = 1 << 20             # bytes read at once
COPIES = 1 << 18            # rows of the table of equal payloads that may be broadcast (about 25 MB)

# Fixed values of the format (WARC 1.0 and 1.1).
VERSION = b"WARC/1.1"
MAGIC = (b"WARC/1.1\r\n", b"WARC/1.0\r\n")
END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FIELD = re.compile(rb"[!#-'*+.0-9A-Z^-z|~-]+:[^\r\n]*\Z")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*(?=\r\n)", re.I)


# --- writing ------------------------------------------------------------------------

def payload_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _line(s: str) -> bytes:
    """A header value without control characters and blanks, which are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s).encode("utf-8", "replace")


def record(kind: str, fields: list[tuple[str, bytes]], block: list[bytes]) -> list[bytes]:
    head = [VERSION, b"WARC-Type: " + kind.encode(), *(k.encode() + b": " + v for k, v in fields),
            b"Content-Length: " + str(sum(map(len, block))).encode()]
    return [b"\r\n".join(head), END, *block, END]


def page_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> list[bytes]:
    """A response record, or a revisit record (without the payload) if ``refers_to`` is given."""
    fields = [("WARC-Record-ID", record_id(page_id).encode()), ("WARC-Date", date.encode()),
              ("Content-Type", b"application/http; msgtype=response"), ("WARC-Payload-Digest", b"sha1:" + digest.encode())]
    if url:
        fields.append(("WARC-Target-URI", _line(url)))
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + END)
    if refers_to is None:
        return record("response", fields, [http, payload])
    fields += [("WARC-Refers-To", record_id(refers_to).encode()), ("WARC-Profile", REVISIT.encode())]
    return record("revisit", fields, [http])


def first_copies(pages: DataFrame, least_bytes: int, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(sha1, bytes, keeper): payloads that several pages share, with the largest page_id."""
    slim = pages.select(F.col(page_id).alias("id"), F.sha1(_payload(html)).alias("sha1"), F.octet_length(_payload(html)).alias("bytes"))
    same = slim.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
    return same.where("n > 1 AND keeper IS NOT NULL").select("sha1", "bytes", "keeper")


def _payload(html: str):
    return F.coalesce(F.col(html), F.lit("")).cast("binary")


INDEX = "name string, bytes bigint, records bigint"


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
                   page_id: str = "page_id", url: str = "url", html: str = "html") -> tuple[str, DataFrame]:
    """Write every row as a record; returns the folder and its files (name, bytes, records).

    The payload is the html in UTF-8 (null: empty).  Of payloads that are
    equal (by SHA-1 and length) and at least ``least_bytes`` long, the rows of
    the largest page_id are responses and the others refer to it; null ids
    are smallest, and rows with equal payloads and no id at all are all
    responses.  A task writes one file under a name of its own, so a task
    that runs again leaves nothing that the index names twice; an empty table
    writes no file.  Other columns are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or shared_dir(spark, "warc")
    fs, place = open_fs(folder)
    fs.create_dir(place, recursive=True)
    copies = bounded_broadcast(write_table(first_copies(pages, least_bytes, page_id, html), "copies"), COPIES)
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
                        _payload(html).alias("payload"), F.sha1(_payload(html)).alias("sha1"),
                        F.octet_length(_payload(html)).alias("bytes"))
    rows = rows.join(copies, ["sha1", "bytes"], "left").select(
        "page_id", "url", "payload", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size, n = None, f"pages-{uuid.uuid4().hex}.warc", 0, 0

        def put(parts: list[bytes]) -> int:
            for x in parts:
                out.write(x)
            return sum(map(len, parts))

        for b in batches:
            for i in range(b.num_rows):
                pid, link, payload, sha1, refers = (b.column(c)[i].as_py() for c in
                                                    ("page_id", "url", "payload", "sha1", "refers_to"))
                if out is None:
                    fs, place = open_fs(folder)
                    out = fs.open_output_stream(f"{place}/{name}")
                    info = b"software: rampart\r\nformat: WARC file version 1.1\r\n"
                    size += put(record("warcinfo", [("WARC-Record-ID", f"<urn:file:{name}>".encode()), ("WARC-Date", date.encode()),
                                                    ("Content-Type", b"application/warc-fields")], [info]))
                size += put(page_record(pid, link, payload, payload_digest(bytes.fromhex(sha1)), refers, date))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())],
                                             ["name", "bytes", "records"])

    return folder, write_table(rows.mapInArrow(run, INDEX), "warc-index")


# --- record boundaries ---------------------------------------------------------------

class Span:
    """Bytes of a file from a place on, read in pieces as they are asked for."""

    def __init__(self, f, lo: int, size: int):
        self.f, self.lo, self.size = f, lo, size
        self.data = bytearray()
        f.seek(lo)

    def upto(self, hi: int) -> None:
        while self.lo + len(self.data) < min(hi, self.size):
            self.data += self.f.read(min(PIECE, self.size - self.lo - len(self.data)))

    def take(self, lo: int, hi: int) -> memoryview:
        self.upto(hi)
        return memoryview(self.data)[lo - self.lo:hi - self.lo]

    def forget(self, before: int) -> None:
        """Bytes before a place are not asked for again."""
        if before - self.lo > PIECE or before >= self.lo + len(self.data):
            if before > self.lo + len(self.data):
                self.f.seek(before)
            del self.data[:before - self.lo]
            self.lo = before

    def header(self, at: int) -> tuple[int, bytes] | None:
        """(end, text) of the header that begins at ``at``, None if that is none.

        Lines are read one by one and the first that is no field ends the
        search, so that a stray version line costs little.
        """
        line = at
        while True:
            self.upto(line + 2)
            stop = self.data.find(b"\r\n", line - self.lo)
            while stop < 0 and self.lo + len(self.data) < self.size:
                have = len(self.data)
                self.upto(self.lo + have + 1)
                stop = self.data.find(b"\r\n", max(have - 1, line - self.lo))
            if stop < 0:
                return None
            text = bytes(self.data[line - self.lo:stop])
            if not text:
                return stop + self.lo + 2, bytes(self.data[at - self.lo:stop])
            if line > at and not _FIELD.match(text) and text[:1] not in (b" ", b"\t"):
                return None
            line = stop + self.lo + 2


def successor(span: Span, at: int) -> int | None:
    """Where the record that a header at ``at`` describes ends; None if it cannot be one."""
    got = span.header(at)
    length = got and _LENGTH.search(got[1])
    if not length:
        return None
    end = got[0] + int(length[1]) + len(END)
    return end if end <= span.size else None


def candidates(f, lo: int, hi: int, size: int) -> list[tuple[int, int]]:
    """(place, successor) of every version line that begins in [lo, hi) and has a header."""
    span = Span(f, lo, size)
    span.upto(hi + len(MAGIC[0]) - 1)
    found = []
    for magic in MAGIC:
        at = span.data.find(magic, 0, hi - lo + len(magic) - 1)
        while at >= 0:
            found.append(lo + at)
            at = span.data.find(magic, at + 1, hi - lo + len(magic) - 1)
    out = []
    for at in sorted(found):
        end = successor(span, at)
        if end is not None:
            out.append((at, end))
    return out


def exits(links: list[tuple[int, int]]) -> list[int]:
    """For each candidate (ascending), the first place on its chain that is not one of them."""
    last = {}
    for at, nxt in reversed(links):
        last[at] = last.get(nxt, nxt)
    return [last[at] for at, _ in links]


def ranges(index: DataFrame, size: int) -> DataFrame:
    """(name, bytes, lo): the byte ranges of all files."""
    return index.where("bytes > 0").select("name", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1,
                                                                                 F.lit(size).cast("bigint"))).alias("lo"))


def candidate_links(folder: str, index: DataFrame, size: int = RANGE) -> DataFrame:
    """(name, at, next, exit) of all candidates of all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = open_fs(folder)
        for b in batches:
            for r in b.to_pylist():
                with fs.open_input_file(f"{place}/{r['name']}") as f:
                    links = candidates(f, r["lo"], min(r["lo"] + size, r["bytes"]), r["bytes"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["name"]] * len(links), pa.string()), pa.array([a for a, _ in links], pa.int64()),
                     pa.array([b for _, b in links], pa.int64()), pa.array(exits(links), pa.int64())],
                    ["name", "at", "next", "exit"])

    dealt = ranges(index, size)
    return dealt.repartition(partitions(index.sparkSession), "name", "lo").mapInArrow(
        run, "name string, at bigint, next bigint, exit bigint")


def entries(index: DataFrame, links: DataFrame) -> DataFrame:
    """(name, at): each range's first record, reached from the start of its file.

    Round k jumps 2**k ranges: what is reached jumps on, then every jump is
    joined with itself.  A chain that does not end with its file is an error.
    """
    jumps = links.select("name", "at", "exit")
    reached = write_table(index.where("bytes > 0").select("name", F.lit(0).cast("bigint").alias("at")), "reached")
    while True:
        further = write_table(reached.join(jumps, ["name", "at"]).select("name", F.col("exit").alias("at"))
                              .join(links.select("name", "at"), ["name", "at"], "left_semi"), "reached")
        if further.isEmpty():
            break
        reached = write_table(reached.unionByName(further), "reached")
        then = jumps.select("name", F.col("at").alias("exit"), F.col("exit").alias("far"))
        jumps = write_table(jumps.join(then, ["name", "exit"]).select("name", "at", F.col("far").alias("exit")), "jumps")
    ends = reached.join(links, ["name", "at"], "left").select("name", "exit").join(index.select("name", "bytes"), "name")
    ends = ends.join(links.select("name", F.col("at").alias("exit")), ["name", "exit"], "left_anti")
    broken = ends.where(F.col("exit").isNull() | (F.col("exit") != F.col("bytes"))).count()
    if broken:
        raise ValueError(f"{broken} archives have a record that does not end where another begins")
    return reached


# --- reading ------------------------------------------------------------------------

def header_fields(head: bytes) -> dict[str, str]:
    """Field names (lower case) and values of a header; folded lines are joined."""
    text = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace")
    lines = text.split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def page_number(urn: str | None):
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_record(span: Span, at: int) -> tuple[int, dict | None]:
    """(end, page columns) of the record at ``at``; None for one that is no page.

    The payload is digested piece by piece; a response whose payload does not
    have the digest or the length of its headers is an error.
    """
    start, head = span.header(at)
    fields = header_fields(head)
    end = start + int(fields["content-length"])
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return end + len(END), None
    body, http = span.header(start)
    length = int(header_fields(http)["content-length"])
    digest = fields["warc-payload-digest"].partition(":")[2]
    if kind == "response":
        sha1 = hashlib.sha1()
        for lo in range(body, end, PIECE):
            span.forget(lo)
            with span.take(lo, min(lo + PIECE, end)) as piece:
                sha1.update(piece)
        if payload_digest(sha1.digest()) != digest or end - body != length:
            raise ValueError(f"damaged payload of {fields.get('warc-record-id')}")
    return end + len(END), {"page_id": page_number(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"),
                            "payload_bytes": length, "payload_digest": digest, "record_type": kind,
                            "refers_to": page_number(fields.get("warc-refers-to"))}


PAGES = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(folder: str, index: DataFrame, size: int = RANGE) -> DataFrame:
    """Page records of the files of ``index`` (name, bytes), from the archives alone.

    Returns page_id, url, payload_bytes and payload_digest (both of the full
    payload, also for a revisit), record_type and refers_to.  Files of any
    number of records are read in ranges of ``size`` bytes; a record belongs
    to the range it begins in.  No file gives an empty result.
    """
    prepare(index.sparkSession)
    links = write_table(candidate_links(folder, index, size), "links")
    first = entries(index, links).join(index.select("name", "bytes"), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = open_fs(folder)
        names = [c.split()[0] for c in PAGES.split(", ")]
        types = [pa.int64() if "bigint" in c else pa.string() for c in PAGES.split(", ")]
        schema = pa.schema(list(zip(names, types)))
        for b in batches:
            for r in b.to_pylist():
                at, stop = r["at"], min((r["at"] // size + 1) * size, r["bytes"])
                out = []
                with fs.open_input_file(f"{place}/{r['name']}") as f:
                    span = Span(f, at, r["bytes"])
                    while at < stop:
                        at, page = read_record(span, at)
                        span.forget(at)
                        if page is not None:
                            out.append(page)
                        if len(out) == 1000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    return first.repartition(partitions(index.sparkSession), "name", "at").mapInArrow(run, PAGES)
