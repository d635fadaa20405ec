"""Global row numbers without funnelling rows through one task.

Rows are tagged with their piece (an input split, or a sorted partition) and
``monotonically_increasing_id``; a partial aggregate counts each piece, the
counts become offsets, and the offsets are joined back.  The offsets table
has one row per piece; how it is joined is left to the planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_lines(lines: DataFrame, out: str = "id", base: int = 1) -> DataFrame:
    """Number text lines in file order, counting every line.

    ``lines`` must come from a file scan with ``file_path`` and
    ``block_start`` columns (see ``sources.files.read_lines``); rows of a
    split must come in file order within their partition.  Files are
    ordered by path, splits by start offset, lines by position in the split.
    Offsets are summed within each file and over files (one row a file, so
    that last sum is in one task), and joined by a 64-bit key of the split.
    Lines that were written with their ``_mid`` (see ``mark_lines``) keep it.
    """
    piece = F.xxhash64("file_path", "block_start")
    tagged = (lines if "_mid" in lines.columns else mark_lines(lines)).withColumn("_piece", piece)
    pieces = tagged.groupBy("file_path", "block_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    files = pieces.groupBy("file_path").agg(F.sum("_n").alias("_lines"))
    over_files = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_path", F.coalesce(F.sum("_lines").over(over_files), F.lit(0)).alias("_before"))
    in_file = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.join(files, "file_path").select(
        piece.alias("_piece"), "_m0", (F.col("_before") + F.coalesce(F.sum("_n").over(in_file), F.lit(0))).alias("_off"))
    return (tagged.join(offsets, on="_piece", how="inner")
            .withColumn(out, F.col("_off") + (F.col("_mid") - F.col("_m0")) + F.lit(base))
            .drop("_mid", "_m0", "_off", "_piece"))


def mark_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``_mid``, their place within the split that a task reads."""
    return lines.withColumn("_mid", F.monotonically_increasing_id())


def parse_bytes(s: str) -> int:
    """A byte size as Spark's settings spell it (``128m``, ``1g``, ``4096``)."""
    s = s.strip().lower()
    mult = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    for suf in ("kb", "mb", "gb", "tb", "b", "k", "m", "g", "t"):
        if s.endswith(suf):
            return int(float(s[: -len(suf)]) * mult.get(suf[0], 1))
    return int(s)


def index_sorted(df: DataFrame, order_cols: list, out: str = "pos", base: int = 0,
                 num_partitions: int | None = None) -> DataFrame:
    """Position of each row in the order of ``order_cols`` (a total order).

    The rows are range-partitioned, sorted within partitions, tagged with
    partition and place, and written to the shared folder; counting and
    numbering both read those tags from the written rows.  They must: two
    plans of the same sort that keep different columns sample different
    range bounds, so partitions of one say nothing about the other.
    """
    from rampart.session import write_table
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    tagged = write_table(ordered.withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    pieces = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_pid", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (tagged.join(pieces, on="_pid", how="inner")
            .withColumn(out, F.col("_off") + (F.col("_mid") - F.col("_m0")) + F.lit(base))
            .drop("_pid", "_mid", "_m0", "_off"))
