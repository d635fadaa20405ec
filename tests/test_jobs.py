import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from rampart.plans import jobs as J
from rampart.sources import testdata as TD


def _write_log(spark, path, lines_df):
    rows = [r["value"] for r in lines_df.orderBy("id").collect()]   # small fixture only
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(rows) + "\nnot a log line\n")
    return rows


def test_pipeline_jobs(spark, tmpdir_path):
    d = tmpdir_path
    access = TD.access_log(spark, SF_SMALL)
    log = os.path.join(d, "access.log")
    rows = _write_log(spark, log, TD.marker_lines(access))
    norm = J.normalize_log(spark, log, d + "/norm", d + "/rejects", batch_size=25)
    n_good = access.where(F.col("token").isNotNull()).count()
    assert norm.count() == n_good
    assert spark.read.parquet(d + "/rejects").count() == len(rows) + 1 - n_good
    # ids are line numbers over all lines
    assert norm.agg(F.max("id")).collect()[0][0] <= len(rows)
    assert norm.select("batch_id").distinct().count() > 1

    J.train_job(spark, d + "/norm", d + "/model", d + "/train_scores", d + "/train_anomalies",
                n_trees=30, psi=64)
    assert spark.read.parquet(d + "/train_scores").count() == n_good
    J.score_job(spark, d + "/norm", d + "/model", d + "/scores", d + "/anomalies")
    import pytest
    spark.read.parquet(d + "/norm").drop("batch_id").write.parquet(d + "/plain")
    with pytest.raises(ValueError):                  # no batches given: an error, not one batch
        J.score_job(spark, d + "/plain", d + "/model", d + "/scores2", d + "/anomalies2")
    J.score_job(spark, d + "/plain", d + "/model", d + "/scores2", d + "/anomalies2", batch_size=25)
    assert spark.read.parquet(d + "/anomalies2").count() == spark.read.parquet(d + "/anomalies").count()
    anomalies = spark.read.parquet(d + "/anomalies")
    cls = J.classify_job(spark, d + "/anomalies", d + "/classified")
    assert cls.count() == anomalies.count()

    os.makedirs(d + "/blocked")
    with open(d + "/blocked/part-initial.txt", "w") as f:
        f.write("10.0.0.1\n")
    new = J.block_job(spark, d + "/classified", d + "/blocked")
    assert "10.0.0.1" not in {r[0] for r in new.collect()}
    again = J.block_job(spark, d + "/classified", d + "/blocked")
    assert again.count() == 0                        # second run adds nothing

    err, acc = J.load_dashboard(spark, d + "/missing.csv", d + "/missing2.csv")
    assert err.count() == 0 and acc.count() == 0
    board = J.dashboard(cls, norm)
    assert board["total_logs"].collect()[0]["total"] == n_good + cls.count()


def test_merge_and_legacy_jobs(spark, tmpdir_path):
    d = tmpdir_path
    a = os.path.join(d, "a.log")
    b = os.path.join(d, "b.log")
    with open(a, "w") as f:
        f.write("x [10/Oct/2024:13:00:00 +0000] a1\nno time\nx [10/Oct/2024:15:00:00 +0000] a2\n")
    with open(b, "w") as f:
        f.write("x [10/Oct/2024:14:00:00 +0000] b1\nx [10/Oct/2024:13:00:00 +0000] b2\n")
    J.merge_job(spark, [a, b], d + "/merged")
    out = []
    for name in sorted(os.listdir(d + "/merged")):
        if name.startswith("part-"):
            out += open(os.path.join(d, "merged", name)).read().splitlines()
    assert [s.split()[-1] for s in out] == ["a1", "b2", "b1", "a2"]

    comb = os.path.join(d, "combined.log")
    rows = [r["value"] for r in TD.combined_lines(spark, SF_SMALL).orderBy("id").collect()]
    with open(comb, "w") as f:
        f.write("\n".join(rows) + "\n")
    assert J.legacy_convert(spark, comb, d + "/legacy") is True
    assert J.legacy_convert(spark, comb, d + "/legacy") is False      # skipped when present
    assert spark.read.parquet(d + "/legacy").count() > 0


def test_classify_csv_job_rejects_short_rows(spark, tmpdir_path):
    d = tmpdir_path
    header = ("id,RemoteAddress,RemoteUser,TimeLocal,Request,URL,Version,Status,BodyBytesSent,Referer,"
              "UserAgent,token,lenToken,lenURL,anomaly,anomaly_score")
    rows = ["1,1.1.1.1,-,2024-10-10 13:55:36,GET,/etc/passwd,HTTP/1.1,200,5,-,ua,t,1,11,-1,-0.1",
            '2,1.1.1.2,-,2024-10-10 13:55:37,GET,"/a?q=1,2;x",HTTP/1.1,404,5,-,ua,t,1,8,-1,-0.2',
            "3,1.1.1.3,-,2024-10-10"]
    p = d + "/anomalies.csv"
    with open(p, "w") as f:
        f.write(header + "\n" + "\n".join(rows) + "\n")
    good, bad = J.classify_csv_job(spark, p, d + "/out")
    assert good.count() == 2 and bad.count() == 1
    out = spark.read.option("header", True).option("escape", '"').csv(d + "/out")
    got = {r["id"]: (r["Types d'attaque"], r["Alerte Critique"]) for r in out.collect()}
    assert got["1"] == ("LFI", "Oui")
    assert got["2"] == ("SQL Injection, Command Injection", "Non")
