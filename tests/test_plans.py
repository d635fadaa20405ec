"""Plan shapes that the scale design relies on."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from rampart.operators import blocking as B
from rampart.operators import classify as C
from rampart.operators import dashboard as D
from rampart.operators import parse as P
from rampart.sources import testdata as TD
from rampart.sources.files import read_lines


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _normalized(spark, d):
    path = os.path.join(d, "norm")
    TD.access_log(spark, SF_SMALL).write.parquet(path)
    return spark.read.parquet(path)


def test_prefix_filter_and_pruning_reach_the_scan(spark, tmpdir_path):
    df = _normalized(spark, tmpdir_path)
    p = plan(D.address_counts(D.prefix_filter(df, "10.0.0.1")))
    assert "StringStartsWith(RemoteAddress,10.0.0.1)" in p
    assert "ReadSchema: struct<RemoteAddress:string>" in p
    # the prefix reaches the scans of both the rows and their counts
    p2 = plan(D.group_size_filter(D.prefix_filter(df, "10.0.0.1"), 0, 1000))
    assert p2.count("StringStartsWith(RemoteAddress,10.0.0.1)") >= 2
    assert "Window" not in p2


def test_top_k_is_take_ordered(spark, tmpdir_path):
    df = _normalized(spark, tmpdir_path)
    assert "TakeOrderedAndProject" in plan(D.top_addresses(df, 10))


def test_parse_is_one_stage_with_one_tokenizer(spark, tmpdir_path):
    p_ = os.path.join(tmpdir_path, "x.log")
    with open(p_, "w") as f:
        f.write("a b c\n")
    parsed = P.split(P.parse_marker(read_lines(spark, p_).withColumn("id", F.lit(1))))[0]
    text = plan(parsed)
    assert "Exchange" not in text
    assert text.count("regexp_extract_all") == 1


def test_classifier_runs_each_regex_once_under_a_filter(spark, tmpdir_path):
    df = _normalized(spark, tmpdir_path)
    text = plan(C.classify(df).where(F.col("attack_types") != "Aucune"))
    assert text.count("RLIKE") == 6


def test_rate_ban_windows_by_address_and_bucket(spark, tmpdir_path):
    df = _normalized(spark, tmpdir_path)
    text = plan(B.rate_ban(df, B.failed_request(), 600, 5))
    assert "HashAggregate" in text and "Window" in text
    assert "partial_count" in text           # per-second counts are pre-aggregated


def test_dashboard_pages_scan_once_and_run_no_job(spark):
    """D8 / D9 come from one count per address: one scan each, nothing runs
    while the plan is built."""
    from rampart.operators import dashboard as D
    from rampart.plans.registry import access, error_table
    acc, err = access(spark, SF_SMALL), error_table(spark, SF_SMALL)
    spark.sparkContext.setJobGroup("pages", "building the pages")
    try:
        pages = [*D.error_page(err, "10.0.0.", 0, 1000).values(), *D.access_page(acc, "10.0.0.", 0, 1000).values()]
    finally:
        ran = spark.sparkContext.statusTracker().getJobIdsForGroup("pages")
        spark.sparkContext.setJobGroup("tests", "tests")
    assert not ran
    for p in pages:
        assert p._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
