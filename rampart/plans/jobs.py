"""File-to-file jobs: the reference's scripts as Spark jobs.

Each job reads its inputs with ``rampart.sources.files``, runs operators and
writes with ``rampart.sinks``; nothing is gathered on the driver except
bounded models (forest nodes, scaler rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart import schemas as SC
from rampart import sinks
from rampart.operators import blocking as B
from rampart.operators import classify as C
from rampart.operators import dashboard as D
from rampart.operators import merge as M
from rampart.operators import parse as P
from rampart.operators import threshold as TH
from rampart.plans import detect as DT
from rampart.session import write_table
from rampart.sources import files as SRC


def normalize_log(spark: SparkSession, log_path: str, out_table: str, rejects_path: str | None = None,
                  encoding: str = "utf-8", batch_size: int | None = None) -> DataFrame:
    """SRC1/SRC3 → P1–P8 → SNK2 (+ SNK5): the parser job over a whole log.

    Every line counts for the ids (P7), rejected ones included; all lines
    are processed (there is no unflushed last batch).  With ``batch_size``
    the rows also get the ``batch_id`` of the reference's micro-batches (S3).
    """
    lines = SRC.read_lines(spark, log_path, encoding=encoding, numbered=True)
    parsed = P.parse_marker(lines).persist()
    try:
        good, bad = P.split(parsed)
        if batch_size:
            good = TH.with_batches(good, batch_size)
        sinks.append(good, out_table)
        if rejects_path:
            sinks.write_rejects(bad, rejects_path)
    finally:
        parsed.unpersist()
    return spark.read.parquet(out_table)


def legacy_convert(spark: SparkSession, log_path: str, out_table: str) -> bool:
    """SRC4 → P11–P19 → SNK7: combined-log conversion, skipped when the
    output already exists (as the legacy converter did)."""
    if SRC.path_exists(spark, out_table):
        return False
    lines = SRC.read_lines(spark, log_path, numbered=True)
    good = P.normalize_combined(lines)
    good.write.mode("ignore").parquet(out_table)
    return True


def train_job(spark: SparkSession, normalized_table: str, model_path: str, scores_path: str,
              anomalies_path: str, **params) -> DT.Model:
    """Train on the normalized table; write scores, anomalies (M6) and
    the model tables (SNK8)."""
    model, scored = DT.train(spark, spark.read.parquet(normalized_table), **params)
    sinks.write_scored(scored, scores_path, anomalies_path, F.col("anomaly") == -1)
    DT.save_model(spark, model, model_path)
    return model


def score_job(spark: SparkSession, normalized_table: str, model_path: str, scores_path: str,
              anomalies_path: str, batch_col: str = "batch_id", batch_size: int | None = None) -> None:
    """E1 in batch: score with the saved model, cut per batch (A1–A3), and
    write all scores and the suspicious rows (SNK3).

    The cut depends on the batches: a table without ``batch_col`` needs
    ``batch_size``, and its batches are runs of that many lines by ``id``.
    """
    model = DT.load_model(spark, model_path)
    df = spark.read.parquet(normalized_table)
    if batch_col not in df.columns:
        if not batch_size:
            raise ValueError(f"the table has no {batch_col}; give batch_size")
        df = TH.with_batches(df, batch_size, out=batch_col)
    scored = write_table(DT.score(df, model), "scores")
    sinks.append(scored, scores_path)
    sinks.append(TH.adaptive_filter(scored, "anomaly_score", batch_col), anomalies_path)


def classify_job(spark: SparkSession, anomalies_table: str, out_path: str, csv: bool = False) -> DataFrame:
    """Anomalies → attack types and critical flag → append (SNK4)."""
    cls = C.classify(spark.read.parquet(anomalies_table))
    if csv:
        sinks.export_csv(cls, out_path)
    else:
        sinks.append(cls, out_path)
    return cls


def classify_csv_job(spark: SparkSession, csv_path: str, out_path: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """C12 over a positional CSV (SRC8): rows of fewer than eight fields go
    to the rejects; longer and shorter rows are classified by position.

    The parsed rows are written to the shared folder once, since both
    results read them.
    """
    raw = write_table(SRC.read_positional_csv(spark, csv_path, SC.SCORED, header), "positional")
    good, bad = C.split_short_rows(raw)
    sinks.export_csv(C.classify(good), out_path)
    return good, bad


def block_job(spark: SparkSession, classified: str, blocklist_path: str, whitelist_path: str | None = None,
              critical_only: bool = False, csv: bool = False) -> DataFrame:
    """SRC10 → SRC9 → J1 (+ J3) → SNK6, one line per new address.

    ``classified`` is a Parquet table or, with ``csv``, exported header CSV
    files, whose columns are found by name.  The block list is a folder of text files (one address per line); each
    run appends one more part file with the addresses it adds.
    """
    blocked = SRC.read_blocklist(spark, blocklist_path)
    if not csv:
        rows = spark.read.parquet(classified)
    else:
        rows = SRC.read_classified_csv(spark, classified) if critical_only else SRC.read_addresses_csv(spark, classified)
    wl = SRC.read_whitelist(spark, whitelist_path) if whitelist_path else None
    new = B.refresh_blocklist(rows, blocked, wl, critical_only).persist()
    try:
        new.write.mode("append").text(blocklist_path)
        return new
    finally:
        new.unpersist()


def merge_job(spark: SparkSession, paths: list[str], out_path: str) -> None:
    """O1–O3 → SNK10: line-level, time-ordered merge of several logs."""
    sources = [SRC.read_lines(spark, p, numbered=True).withColumnRenamed("id", "line_no") for p in paths]
    # one sort: the written order is the merged order, no position is needed
    sinks.write_merged_text(M.timed_lines(sources), out_path, M.ORDER)


def load_dashboard(spark: SparkSession, error_csv: str, access_csv: str) -> tuple[DataFrame, DataFrame]:
    """Both dashboard tables, each empty when its file is missing; the
    error table has the classified columns under their own names."""
    err = SRC.read_classified_csv(spark, error_csv, tolerant=True)
    acc = SRC.read_normalized_csv(spark, access_csv, tolerant=True)
    return err, acc


def dashboard(error: DataFrame, access: DataFrame, ip_prefix: str | None = None,
              min_rows: int | None = None, max_rows: int | None = None, top_k: int = 10) -> dict:
    """D8, D9 and V1–V7 as lazy frames; the page's row bounds are off unless given."""
    tagged = D.with_kind(access, error)
    out = {"error": D.error_page(error, ip_prefix, min_rows, max_rows),
           "access": D.access_page(access, ip_prefix, min_rows, max_rows),
           "total_logs": D.total_logs(tagged), "breakdown": D.logs_breakdown(tagged),
           "top_ips": D.top_addresses(access, top_k), "over_time": D.logs_over_time(tagged),
           "heatmap": D.hour_heatmap(tagged), "error_vs_access": D.error_vs_access(tagged)}
    if "critical_alert" in error.columns:
        out["recent_alerts"] = D.recent_alerts(error, top_k)
    return out
