from rampart.plans.partitioning import num_partitions, spread


def test_spread_only_scans_with_too_few_partitions(spark, tmpdir_path):
    path = tmpdir_path + "/one"
    spark.range(0, 1000).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert num_partitions(df) == 1
    assert num_partitions(spread(df)) == spark.sparkContext.defaultParallelism
    assert num_partitions(spread(df, 1)) == 1          # enough partitions: untouched
    assert sorted(r[0] for r in spread(df).collect()) == list(range(1000))
