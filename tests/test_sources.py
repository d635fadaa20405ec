import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from rampart import schemas as SC
from rampart import sinks
from rampart.sources import files as SRC


def test_blocklist_and_whitelist_load(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "blocked.txt")
    with open(p, "w") as f:
        f.write("1.2.3.4\n 5.6.7.8 \r\n\n1.2.3.4\n")
    assert sorted(r[0] for r in SRC.read_blocklist(spark, p).collect()) == ["1.2.3.4", "5.6.7.8"]
    assert SRC.read_blocklist(spark, p + ".missing").count() == 0
    assert SRC.read_whitelist(spark, p).columns == ["entry"]


def test_export_and_read_normalized_csv(spark, tmpdir_path):
    rows = [(1, '1.1.1.1', '-', None, 'GET', '/a"b', 'HTTP/1.1', '200', '5', '"-"', '"UA x"', 'tok')]
    df = spark.createDataFrame(rows, SC.NORMALIZED).withColumn(
        "TimeLocal", F.to_timestamp_ntz(F.lit("2024-10-10 13:55:36")))
    out = os.path.join(tmpdir_path, "norm")
    sinks.export_csv(df, out)
    back = SRC.read_normalized_csv(spark, out).collect()[0]
    assert back["URL"] == '/a"b' and back["UserAgent"] == '"UA x"'
    assert str(back["TimeLocal"]) == "2024-10-10 13:55:36"
    assert SRC.read_normalized_csv(spark, out + "-missing", tolerant=True).count() == 0
    wrapped = os.path.join(tmpdir_path, "wrapped")
    sinks.export_csv(df.drop("TimeLocal"), wrapped, wrap_strings=True)
    raw = spark.read.option("header", True).option("escape", '"').csv(wrapped).collect()[0]
    assert raw["URL"] == '"/a""b"'              # the reference's double quoting


def test_positional_csv_short_rows(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "c.csv")
    with open(p, "w") as f:
        f.write("a,b,c\n1,2,3\n4,5\n")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])
    from rampart.operators.classify import split_short_rows
    good, bad = split_short_rows(SRC.read_positional_csv(spark, p, schema).cache())
    assert good.count() == 1 and bad.count() == 1


def test_binary_files_merge(spark, tmpdir_path):
    from rampart.operators.merge import merge_files
    a, b = os.path.join(tmpdir_path, "a.log"), os.path.join(tmpdir_path, "b.log")
    with open(a, "w") as f:
        f.write("x 11/Oct/2024:00:00:00 y\n")
    with open(b, "w") as f:
        f.write("x 10/Oct/2024:00:00:00 y\n")
    got = [os.path.basename(r["path"]) for r in merge_files([SRC.read_binary(spark, a), SRC.read_binary(spark, b)]).collect()]
    assert got == ["b.log", "a.log"]


def _put(folder, name, text, raw=None):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(raw if raw is not None else text.encode())


def test_addresses_by_name(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "cls")
    _put(d, "a.csv", "id,URL,RemoteAddress,Status\n1,/q,10.0.0.1,200\n2,\"/a,b\",10.0.0.2,200\n")
    _put(d, "b.csv", "\ufeffRemoteAddress;x,RemoteAddress\r\nno,10.0.0.3\r\n")             # a BOM and foreign columns
    _put(d, "c.csv", '"a\nb",remoteaddress,RemoteAddress,RemoteAddress\n1,no,10.0.0.4,no\n')
    _put(d, "d.csv", "")
    _put(d, "e.csv", "REMOTEADDRESS\n10.0.0.5\n")
    _put(d, "f.csv.gz", None, gzip.compress(b"x,RemoteAddress\n1,10.0.0.6\n"))
    got = sorted(r[0] for r in SRC.read_addresses_csv(spark, d).collect() if r[0] != 'b"')
    assert [g for g in got if g.startswith("10.")] == ["10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.4", "10.0.0.5", "10.0.0.6"]
    _put(d, "g.csv", "id,URL\n1,/x\n")
    with pytest.raises(ValueError, match="g.csv has no column RemoteAddress"):
        SRC.read_addresses_csv(spark, d)


def test_named_columns_are_parsed_alone(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "narrow")
    _put(d, "a.csv", "id,URL,RemoteAddress,Status\n1,/q,10.0.0.1,200\n")
    plan = SRC.read_addresses_csv(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<RemoteAddress:string>" in plan


def test_tolerant_load(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "mixed")
    _put(d, "a.csv", "URL,id,TimeLocal\n/a,1,2024-10-10 13:55:36\n/b,2,not a time\n")
    _put(d, "b.csv", None, b"\xff\xfe\x00binary\x80" * 9 + b"\n1,2\n")
    os.makedirs(os.path.join(tmpdir_path, "bare"))
    got = sorted((r["id"], r["URL"], str(r["TimeLocal"]), r["token"]) for r in SRC.read_normalized_csv(spark, d, tolerant=True).collect())
    assert got == [(1, "/a", "2024-10-10 13:55:36", None), (2, "/b", "None", None)]
    assert SRC.read_normalized_csv(spark, os.path.join(tmpdir_path, "bare"), tolerant=True).count() == 0
    assert SRC.read_normalized_csv(spark, d + "/*.none", tolerant=True).schema == SC.NORMALIZED
    with pytest.raises(ValueError, match="header that can be read"):
        SRC.read_normalized_csv(spark, d)


def test_whole_files_stream_resumes(spark, tmpdir_path):
    from rampart.operators import merge as M
    from rampart.streaming.files import merged_files, start_merge_files
    d, out, ck = (os.path.join(tmpdir_path, x) for x in ("logs", "out", "ck"))
    for names in (("b", "c"), ("a",), ()):
        for n in names:
            _put(d, n + ".log", f"no time here\n[1{ord(n) % 3}/Oct/2024:13:55:36] {n}\n[01/Jan/2020:00:00:00]\n")
        _put(d, f"none{len(names)}.log", "nothing\n")
        start_merge_files(spark, d, out, ck, max_files=1, available_now=True).awaitTermination()
    got = [(os.path.basename(r["path"]), r["ts"], bytes(r["content"])) for r in merged_files(spark, out).collect()]
    want = [(os.path.basename(r["path"]), r["ts"], bytes(r["content"])) for r in M.merge_files([SRC.read_binary(spark, d)]).collect()]
    assert len(got) == 3 and got == want


def test_sketch_rank_error(spark):
    from rampart.operators.threshold import sketch_quantile
    rnd = random.Random(3)
    xs = [rnd.choice([rnd.gauss(0, 1), float(rnd.randint(0, 3))]) for _ in range(20_000)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)] * 50, "s double").repartition(7)
    for q in (0.0007, 0.05, 0.5, 0.999):
        for error in (1e-2, 1e-3):
            v = sketch_quantile(df, "s", q, error)
            assert sum(x < v for x in xs) <= (q + error) * len(xs) + 1 and sum(x <= v for x in xs) >= (q - error) * len(xs) - 1
    assert sketch_quantile(df.where("s is null"), "s", 0.5, 0.01) is None
