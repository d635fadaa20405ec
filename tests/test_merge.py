from rampart.operators.merge import merge_logs


def test_merge_is_stable_by_time_file_line(spark):
    f1 = [(1, "a [10/Oct/2024:13:55:36 +0000] x"), (2, "no time"), (3, "b [10/Oct/2024:13:55:30 +0000]")]
    f2 = [(1, "c [10/Oct/2024:13:55:36 +0000]"), (2, "d [09/Oct/2024:00:00:00 +0000]")]
    s1 = spark.createDataFrame(f1, "line_no BIGINT, value STRING")
    s2 = spark.createDataFrame(f2, "line_no BIGINT, value STRING")
    got = [(r["pos"], r["file_no"], r["line_no"]) for r in merge_logs([s1, s2]).orderBy("pos").collect()]
    assert got == [(0, 2, 2), (1, 1, 3), (2, 1, 1), (3, 2, 1)]


def test_positions_and_merged_files_at_many_partitions(spark, tmpdir_path):
    """300,000 lines with a payload, 16 partitions: every position right, no
    inversion in the written text."""
    from pyspark.sql import functions as F

    from rampart import sinks
    from rampart.operators import merge as M
    n = 300_000
    stamp = F.date_format(F.timestamp_seconds(1_700_000_000 + F.col("id") * 7919 % 5000), "dd/MMM/yyyy:HH:mm:ss")
    rows = spark.range(0, n, 1, 8).select(
        F.col("id").alias("line_no"),
        F.concat(F.lit("["), stamp, F.lit("] "), F.md5(F.col("id").cast("string"))).alias("value"))
    sources = [rows.where("line_no % 2 = 1"), rows.where("line_no % 2 = 0")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        merged = merge_logs(sources)
        from pyspark.sql import Window
        want = F.row_number().over(Window.orderBy(*M.ORDER)) - 1
        wrong = merged.withColumn("want", want).where("pos <> want").count()
        sinks.write_merged_text(M.timed_lines(sources), tmpdir_path + "/merged", M.ORDER)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert wrong == 0 and merged.count() == n and "value" in merged.columns
    import glob
    lines = [x for f in sorted(glob.glob(tmpdir_path + "/merged/part-*")) for x in open(f)]
    keys = [x[:22] for x in lines]
    from datetime import datetime
    times = [datetime.strptime(k[1:21], "%d/%b/%Y:%H:%M:%S") for k in keys]
    assert len(lines) == n and times == sorted(times)
