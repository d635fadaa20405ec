"""V4 / V6 on streams: event-time buckets with a watermark.

The watermark bounds the state: a bucket is final, emitted and dropped once
event time has moved ``lateness`` past its end (append mode); rows later
than that are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.functions.urls import NO_ATTACK
from rampart.operators import dashboard as D


def _event_time(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Watermark on the log time.  Watermarks need a zoned timestamp; log
    times are wall-clock (NTZ) and the session runs in UTC, so the cast
    keeps the instant."""
    return stream.withColumn("_evt", F.col(ts).cast("timestamp")).withWatermark("_evt", lateness)


def logs_over_time(stream: DataFrame, width: str = "1 hour", lateness: str = "10 minutes",
                   ts: str = "TimeLocal") -> DataFrame:
    """V4 on a stream of requests (append mode)."""
    out = D.logs_over_time(_event_time(stream, ts, lateness), width, "_evt")
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def error_vs_access(tagged: DataFrame, width: str = "1 hour", lateness: str = "10 minutes",
                    ts: str = "TimeLocal") -> DataFrame:
    """V6 on a stream tagged with ``kind`` (append mode)."""
    out = D.error_vs_access(_event_time(tagged, ts, lateness), width, "_evt")
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def tag_stream(stream: DataFrame, kind_of) -> DataFrame:
    """Tag one stream with ``kind`` from a column expression (e.g. the
    classifier's result), since two streams cannot be watermarked apart."""
    return stream.select("id", "RemoteAddress", "TimeLocal", kind_of.alias("kind"))


def access_or_error(classified: DataFrame) -> DataFrame:
    """``error`` for rows with an attack class, else ``access``."""
    return tag_stream(classified, F.when(F.col("attack_types") != NO_ATTACK, F.lit("error"))
                      .otherwise(F.lit("access")))
