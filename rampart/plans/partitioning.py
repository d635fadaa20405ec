"""Partition sizing helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Deal a scan with fewer partitions than the cluster has cores over them.

    A file with one row group is one scan task, so every per-row operator
    after it would run on one core.  An input that already has at least
    ``min_partitions`` (default: the default parallelism) keeps its splits.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df if num_partitions(df) >= want else df.repartition(want)


def num_partitions(df: DataFrame) -> int:
    """Partition count of a plan without running it.

    A plain scan plan answers directly on the JVM side; an adaptive plan
    would run its stages to answer, so it goes through ``df.rdd`` instead.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df.rdd.getNumPartitions()
    return plan.execute().getNumPartitions()
