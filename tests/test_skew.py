"""A hot address with a third of all rows: results stay whole, AQE splits it."""

from pyspark.sql import functions as F

from rampart.operators import dashboard as D

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_group_size_filter_with_hot_address(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        n = 30000
        df = spark.range(0, n).select(
            F.col("id"),
            F.when(F.col("id") % 3 == 0, F.lit("6.6.6.6"))
             .otherwise(F.concat(F.lit("10.0."), (F.col("id") % 500).cast("string"))).alias("RemoteAddress"))
        kept = D.group_size_filter(df, 0, None)
        rows = kept.collect()
        plan = kept._sc._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "simple")
        got = len(rows)
        hot = sum(1 for r in rows if r["RemoteAddress"] == "6.6.6.6")
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert got == n and hot == n // 3          # every row kept, the hot group whole
    assert "skew=true" in plan                 # the hot partition was split at run time
