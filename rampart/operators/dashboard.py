"""Dashboard queries: filters, grouped counts, top-k, time buckets, drill-down.

Each function returns a lazy ``DataFrame`` (``group_size_filter`` alone writes
a table while it builds its plan); only the small grouped result is meant to
reach the caller.  Grouped counts use ``groupBy`` so that Spark
pre-aggregates map-side: a single address holding a third of all rows costs
one partial count per task, never one giant group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ADDR = "RemoteAddress"


def prefix_filter(df: DataFrame, prefix: str | None, col: str = ADDR) -> DataFrame:
    """Rows whose address starts with ``prefix``; no-op when blank.

    Pushed down to the scan as ``StringStartsWith``.
    """
    if not prefix:
        return df
    return df.where(F.col(col).startswith(prefix))


def address_counts(df: DataFrame, col: str = ADDR, name: str = "count") -> DataFrame:
    """D3: rows per address (null addresses are not a bar)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))


def group_size_filter(df: DataFrame, min_rows: int | None = None, max_rows: int | None = None,
                      col: str = ADDR) -> DataFrame:
    """Keep the rows whose address has ``min_rows``..``max_rows`` rows.

    Bounds are inclusive, ``None`` means unbounded, null addresses drop.
    Counted with a partial aggregate and applied by a semi join rather than
    a window, which would put every row of a hot address into one task.
    The qualifying addresses (one row each) are written to the shared folder
    first: AQE
    then sees a plain shuffle on both sides of the join, so it can split a
    hot address's partition of the rows (its skew-join rule does not look
    through an aggregate), or broadcast the table when it is small.
    """
    from rampart.session import write_table
    counts = address_counts(df, col, "_n")
    if min_rows is not None:
        counts = counts.where(F.col("_n") >= min_rows)
    if max_rows is not None:
        counts = counts.where(F.col("_n") <= max_rows)
    return df.join(write_table(counts.select(col), "group-sizes"), on=col, how="left_semi")


def attack_counts(df: DataFrame, exploded: bool = False) -> DataFrame:
    """Rows per attack-type string, or per single class when exploded."""
    if exploded:
        df = df.select(F.explode(F.split("attack_types", ", ")).alias("attack_types"))
    return df.groupBy("attack_types").agg(F.count(F.lit(1)).alias("count"))


def total_count(df: DataFrame) -> DataFrame:
    """One row with the number of rows (0 on empty input, D6)."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def drill_down(df: DataFrame, ip: str, col: str = ADDR) -> DataFrame:
    """Every column of the rows of one exact address."""
    return df.where(F.col(col) == ip)


def _in_bounds(n, min_rows: int | None, max_rows: int | None):
    ok = F.lit(True)
    if min_rows is not None:
        ok = ok & (n >= min_rows)
    if max_rows is not None:
        ok = ok & (n <= max_rows)
    return ok


def error_page(df: DataFrame, ip_prefix: str | None = None, min_rows: int | None = None,
               max_rows: int | None = None, col: str = ADDR) -> dict[str, DataFrame]:
    """The error page's three answers over the classified table.

    All three come from one count per (address, attack types); an address's
    total is a window sum over its few rows of that table (at most one per
    set of attack classes), so the rows themselves are scanned once.
    """
    per = (prefix_filter(df, ip_prefix).where(F.col(col).isNotNull())
           .groupBy(col, "attack_types").agg(F.count(F.lit(1)).alias("count")))
    per = per.withColumn("_n", F.sum("count").over(Window.partitionBy(col)))
    per = per.where(_in_bounds(F.col("_n"), min_rows, max_rows))
    return {"by_address": per.groupBy(col).agg(F.sum("count").alias("count")),
            "by_attack": per.groupBy("attack_types").agg(F.sum("count").alias("count")),
            "total": per.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))}


def access_page(df: DataFrame, ip_prefix: str | None = None, min_rows: int | None = None,
                max_rows: int | None = None, col: str = ADDR) -> dict[str, DataFrame]:
    """The access page's two answers over the normalized table, both from
    the counts per address."""
    per = address_counts(prefix_filter(df, ip_prefix), col).where(_in_bounds(F.col("count"), min_rows, max_rows))
    return {"by_address": per, "total": per.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))}


def records_json(df: DataFrame) -> DataFrame:
    """Rows as JSON records, keys in column order, nulls kept."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]),
                               {"ignoreNullFields": "false"}).alias("record"))


# --- overview page ------------------------------------------------------

def with_kind(access: DataFrame, error: DataFrame,
              cols: tuple[str, ...] = ("id", ADDR, "TimeLocal")) -> DataFrame:
    """Both tables as one, tagged ``access`` / ``error`` (no subtraction)."""
    a = access.select(*cols, F.lit("access").alias("kind"))
    e = error.select(*cols, F.lit("error").alias("kind"))
    return a.unionByName(e)


def total_logs(tagged: DataFrame) -> DataFrame:
    """V1: total rows over both kinds."""
    return tagged.agg(F.count(F.lit(1)).alias("total"))


def logs_breakdown(tagged: DataFrame) -> DataFrame:
    """V2: rows per kind and their share of the total.

    The share divides by a window sum over the aggregated table, which
    holds one row per kind, so the unpartitioned window is tiny.
    """
    per = tagged.groupBy("kind").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return per.select("kind", "count", (F.col("count") / total).alias("share"))


def top_addresses(df: DataFrame, k: int = 10, col: str = ADDR) -> DataFrame:
    """V3: the ``k`` busiest addresses (ties by address).

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each task
    keeps its own top ``k`` and only those reach the final merge.
    """
    return (address_counts(df, col).withColumnRenamed(col, "ip")
            .orderBy(F.desc("count"), F.asc("ip")).limit(k))


def logs_over_time(tagged: DataFrame, width: str = "1 hour", ts: str = "TimeLocal") -> DataFrame:
    """V4: rows per tumbling time bucket (works on a watermarked stream)."""
    return (tagged.groupBy(F.window(ts, width).alias("w"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.col("w.start").alias("bucket"), "count"))


def hour_heatmap(tagged: DataFrame, ts: str = "TimeLocal") -> DataFrame:
    """V5: rows per (day of week 1=Sunday..7, hour of day)."""
    return (tagged.groupBy(F.dayofweek(ts).alias("dow"), F.hour(ts).alias("hour"))
            .agg(F.count(F.lit(1)).alias("count")))


def error_vs_access(tagged: DataFrame, width: str = "1 hour", ts: str = "TimeLocal") -> DataFrame:
    """V6: per bucket, access and error counts side by side (no pivot, so it
    also runs on a stream)."""
    return (tagged.groupBy(F.window(ts, width).alias("w"))
            .agg(F.count_if(F.col("kind") == "access").alias("access"),
                 F.count_if(F.col("kind") == "error").alias("error"))
            .select(F.col("w.start").alias("bucket"), "access", "error"))


def recent_alerts(classified: DataFrame, k: int = 10) -> DataFrame:
    """V7: the ``k`` latest critical rows as (alert_type, details)."""
    return (classified.where(F.col("critical_alert"))
            .orderBy(F.desc("TimeLocal"), F.desc("id")).limit(k)
            .select("id", "TimeLocal", F.col("attack_types").alias("alert_type"),
                    F.concat_ws(" ", ADDR, "Request", "URL", "Status").alias("details")))
