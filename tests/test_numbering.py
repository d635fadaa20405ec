import os

from pyspark.sql import functions as F

from rampart.operators.numbering import index_sorted
from rampart.sources.files import read_lines


def _write_files(d, sizes):
    expected = []
    for fi, n in enumerate(sizes):
        lines = [f"file{fi} line{j} " + "x" * (j % 50) for j in range(n)]
        with open(os.path.join(d, f"part-{fi:03d}.log"), "w") as f:
            f.write("\n".join(lines) + "\n")
        expected += lines
    return expected


def test_number_lines_file_order(spark, tmpdir_path):
    expected = _write_files(tmpdir_path, [2000, 37, 1500])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")   # many splits per file
    try:
        df = read_lines(spark, tmpdir_path, numbered=True)
        assert read_lines(spark, tmpdir_path).rdd.getNumPartitions() > 5
        got = {r["id"]: r["value"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i + 1: v for i, v in enumerate(expected)}


def test_index_sorted_is_partition_invariant(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id"))
    for n in (1, 3, 16):
        got = index_sorted(df, ["k", "id"], num_partitions=n).select("k", "pos").collect()
        assert sorted((r["pos"], r["k"]) for r in got) == [(i, i) for i in range(5000)]


def test_utf16_batch_read(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "live.log")
    lines = ["première ligne", "second \"line\", with comma", "tab\there", "soh \x01 and nul \x00 kept",
             "no newline at the end"]
    with open(p, "wb") as f:
        f.write("\n".join(lines).encode("utf-16-le"))
    got = [r["value"] for r in read_lines(spark, p, encoding="UTF-16LE", numbered=True).orderBy("id").collect()]
    assert got == lines


def test_utf16_numbering_across_many_splits(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "u16.log")
    lines = [f"line {i} é ਊ " + "x" * (i % 37) for i in range(3000)]
    with open(p, "wb") as f:
        f.write(("\n".join(lines) + "\n").encode("utf-16-le"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")      # odd: splits land mid-character
    try:
        df = read_lines(spark, p, encoding="UTF-16LE", numbered=True)
        assert read_lines(spark, p, encoding="UTF-16LE").rdd.getNumPartitions() > 10
        got = [r["value"] for r in df.orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == lines


def test_index_sorted_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(0, 3000).select((F.col("id") * 7919 % 3000).alias("k"), F.col("id"))
        got = index_sorted(df.repartition(5), ["k", "id"], num_partitions=4).select("k", "pos").collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
    assert sorted((r["pos"], r["k"]) for r in got) == [(i, i) for i in range(3000)]
