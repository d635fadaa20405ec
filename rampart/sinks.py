"""Writers: parquet tables by default, CSV exports in the reference's form.

Appends that may be replayed (a micro-batch re-run after a failure) write
into a ``batch_id`` partition with dynamic partition overwrite, so a replay
replaces its own output instead of adding it twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rampart.functions import text as X
from rampart.schemas import CRITICAL_NO, CRITICAL_YES, EXPORT_NAMES

# Time layout of the CSV tables (what the readers parse back, FT3).
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK1: replace the output (per-batch file)."""
    df.write.mode("overwrite").format(fmt).save(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK2 / SNK6 / SNK7: add rows to the history table."""
    df.write.mode("append").format(fmt).save(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """SNK3 / SNK4 / S6: idempotent append of one batch.

    Only partition ``batch_id=<n>`` is replaced, so a replayed batch
    overwrites itself and leaves the others alone.
    """
    (df.withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def write_scored(scored: DataFrame, scores_path: str, anomalies_path: str,
                 anomaly_filter, batch_id: int | None = None) -> None:
    """SNK3: all scored rows and the anomalies, from one computation."""
    scored = scored.persist()
    try:
        if batch_id is None:
            append(scored, scores_path)
            append(scored.where(anomaly_filter), anomalies_path)
        else:
            write_batch(scored, scores_path, batch_id)
            write_batch(scored.where(anomaly_filter), anomalies_path, batch_id)
    finally:
        scored.unpersist()


def write_rejects(rejects: DataFrame, path: str) -> None:
    """SNK5: reject log, partitioned by reason."""
    rejects.write.mode("append").partitionBy("reason").parquet(path)


def export_csv(df: DataFrame, path: str, wrap_strings: bool = False) -> None:
    """CSV export with a header; optionally in the reference's doubled
    quoting (P9 + P10: ASCII-cleaned strings wrapped in literal quotes)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if wrap_strings and isinstance(f.dataType, T.StringType):
            c = X.export_clean(c)
        elif isinstance(f.dataType, T.BooleanType) and f.name == "critical_alert":
            c = F.when(c, F.lit(CRITICAL_YES)).otherwise(F.lit(CRITICAL_NO))
        cols.append(c.alias(EXPORT_NAMES.get(f.name, f.name)))
    (df.select(*cols).write.mode("append").option("header", True).option("escape", '"')
     .option("timestampNTZFormat", TIME_FORMAT).option("timestampFormat", TIME_FORMAT)
     .csv(path))


def write_merged_text(df: DataFrame, path: str, order_cols: list, value: str = "value") -> None:
    """SNK10: lines in merged order; part files are in order as well."""
    df.orderBy(*order_cols).select(value).write.mode("overwrite").text(path)
