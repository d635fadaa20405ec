"""Time-ordered merge of several logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.functions import text as X
from rampart.operators.numbering import index_sorted


# O3: stable order of the merged lines.
ORDER = ["ts", "file_no", "line_no"]


def timed_lines(sources: list[DataFrame], value: str = "value", line_no: str = "line_no") -> DataFrame:
    """O1 bag union (source ``i`` gets ``file_no = i + 1``) with each line's
    first embedded timestamp; O2 lines without one drop."""
    parts = [s.select(F.lit(i + 1).alias("file_no"), F.col(line_no).alias("line_no"), F.col(value).alias("value"))
             for i, s in enumerate(sources)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = u.withColumn("ts", X.embedded_time(F.col("value"))).where(F.col("ts").isNotNull())
    return u


def merge_logs(sources: list[DataFrame], value: str = "value", line_no: str = "line_no") -> DataFrame:
    """``timed_lines`` with ``pos``, the 0-based position in the merged order
    (ties keep the file order, then the line order), by a distributed sort."""
    return index_sorted(timed_lines(sources, value, line_no), ORDER, out="pos")


def merge_files(sources: list[DataFrame], by_file: bool = False) -> DataFrame:
    """Q11's file-level mode: each whole file is one record keyed by the
    first timestamp in it (``binaryFile`` input: ``path``, ``content``)."""
    u = None
    for i, s in enumerate(sources):
        part = s.select(F.lit(i + 1).alias("file_no"), "path", "content",
                        X.embedded_time(F.col("content").cast("string")).alias("ts"))
        u = part if u is None else u.unionByName(part)
    return u.where(F.col("ts").isNotNull()).orderBy("ts", "file_no", "path")
