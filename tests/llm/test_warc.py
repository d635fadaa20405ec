"""op12: against a record-by-record reader, with records inside payloads, small ranges and damaged files."""
import base64
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from rampart.llm import warc as W
from rampart.llm.tokenstore import open_fs

SCHEMA = "page_id bigint, url string, html string"
INNER = b"".join(W.page_record(77, "http://x/", b"inner", W.payload_digest(hashlib.sha1(b"inner").digest()), None, "2020-01-01T00:00:00Z")).decode()


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of each row."""
    out = []
    body = lambda r: (r[2] or "").encode()
    for r in rows:
        b = body(r)
        ids = [x[0] for x in rows if body(x) == b and x[0] is not None]
        keeper = max(ids, default=None)
        again = len(b) >= least and keeper is not None and r[0] != keeper and sum(body(x) == b for x in rows) > 1
        out.append((r[0], len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response",
                    keeper if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"http://h{i % 7}.example/p {i}", f"<p>page {i % 40} é 漢</p>" * (i % 9 + 1)) for i in range(200)]
    out += [(300 + i, None, x) for i, x in enumerate([
        None, "", "WARC/1.1\r\n", "a WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nb", INNER, INNER * 30,
        "x\r\n\r\n" + INNER, "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 50, "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n",
        "WARC/1.1\r\nContent-Length: 999999999999999999999\r\n\r\n", "WARC/1.1\r\nContent-Length: x\r\n\r\n", "WARC/1.0\r\n\r\n",
        "\r\n" * 400, "Content-Length: 5\r\n\r\n", "long " * 60_000, INNER])]
    out += [(500, "http://a/\r\nContent-Length: 1\r\n\r\n", "header in the address"), (501, "", "é" * 5000)]
    return out + out[3:5] + [(None, "http://n/", "no id"), (None, None, "no id"), (None, None, out[0][2])]


@pytest.fixture(scope="module")
def written(spark, rows):
    df = (spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("sha1", F.lit("s")).withColumn("refers_to", F.lit(1))
          .withColumn("bytes", F.lit(2)).withColumn("keeper", F.lit(5)).withColumn("payload", F.lit("p")))
    return W.write_archives(df)


def read(folder, index, size):
    return sorted((tuple(r) for r in W.read_archives(folder, index, size).drop("url").collect()), key=str)


@pytest.mark.parametrize("size", [61, 1000, W.RANGE])
def test_round_trip(written, rows, size):
    assert read(*written, size) == expected(rows)


def test_candidates_inside_payloads_are_rejected(written, rows):
    folder, index = written
    n = W.candidate_links(folder, index, 500).count()
    records = index.agg(F.sum("records")).first()[0]
    assert records == len(rows) and n > records + index.count() + 50


def test_urls(written, rows):
    got = {r["page_id"]: r["url"] for r in W.read_archives(*written).collect()}
    assert got[7] == "http://h0.example/p%207" and got[300] is None and got[500].startswith("http://a/%0D%0A")


def test_least_bytes_and_repeats(spark):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb"), (4, "u", "bbbb"), (5, None, None), (6, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert read(*W.write_archives(df), W.RANGE) == expected(rows)
    assert read(*W.write_archives(df, least_bytes=3), W.RANGE) == expected(rows, 3)


def test_empty_table(spark):
    folder, index = W.write_archives(spark.createDataFrame([], SCHEMA))
    assert index.count() == 0 and W.read_archives(folder, index).collect() == []


def test_damaged_archives(spark):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(20)], SCHEMA).coalesce(1)
    for harm in ("cut", "length", "payload"):
        folder, index = W.write_archives(df)
        (row,) = index.collect()
        path = os.path.join(open_fs(folder)[1], row["name"])
        raw = open(path, "rb").read()
        if harm == "cut":
            raw = raw[:-40]
        elif harm == "length":
            at = [m.start() for m in re.finditer(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", raw)][7] + 18
            raw = raw[:at] + (b"1" if raw[at:at + 1] != b"1" else b"2") + raw[at + 1:]
        else:
            raw = raw.replace(b"page 9 ", b"page 8 ", 1)
        with open(path, "wb") as f:
            f.write(raw)
        index = index.withColumn("bytes", F.lit(len(raw)).cast("bigint"))
        with pytest.raises(Exception, match="does not end where another begins|damaged payload"):
            W.read_archives(folder, index, 700).collect()


def test_jumps_follow_the_chain():
    links = [(0, 10), (4, 9), (9, 30), (10, 20), (20, 33), (25, 28)]
    assert W.exits(links) == [33, 30, 30, 33, 33, 28]
