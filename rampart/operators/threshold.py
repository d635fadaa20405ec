"""Score thresholds: batch statistics, the adaptive cut, exact percentiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.operators.numbering import index_sorted

# Fixed values of the reference's adaptive cut: score < mean * (1 - 10 * std)
# and score < 0.09.
STD_FACTOR = 10.0
SCORE_CAP = 0.09


def batch_stats(df: DataFrame, score: str = "anomaly_score", batch: str = "batch_id") -> DataFrame:
    """A1 / A2: mean and population std of the score per batch."""
    return df.groupBy(batch).agg(F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"))


def adaptive_filter(df: DataFrame, score: str = "anomaly_score", batch: str = "batch_id",
                    factor: float = STD_FACTOR, cap: float = SCORE_CAP) -> DataFrame:
    """A3: rows with ``score < mean * (1 - factor * std)`` and ``score < cap``.

    Statistics come from a grouped aggregate joined back on the batch key
    (one row per batch; AQE broadcasts it), not from a window, so a batch is
    never gathered into one task.
    """
    stats = batch_stats(df, score, batch)
    j = df.join(stats, on=batch, how="inner")
    thr = F.col("score_mean") * (F.lit(1.0) - F.lit(factor) * F.col("score_std"))
    return j.where((F.col(score) < thr) & (F.col(score) < F.lit(cap))).drop("score_mean", "score_std")


def with_batches(df: DataFrame, size: int, id_col: str = "id", out: str = "batch_id") -> DataFrame:
    """S3 in batch mode: line ``id`` (1-based) → batch ``floor((id-1)/size)``."""
    return df.withColumn(out, F.floor((F.col(id_col) - 1) / size).cast("bigint"))


def sketch_quantile(df: DataFrame, col: str, q: float, error: float) -> float | None:
    """A value whose rank is off ``q`` by at most ``error`` of the rows, null ones aside.

    One pass: each task keeps a mergeable summary of about 1 / error values
    (Spark's approximate percentile); ``exact_quantile`` takes three and a sort.
    """
    x = F.col(col).cast("double")
    got = df.where(x.isNotNull()).agg(F.percentile_approx(x, q, math.ceil(1 / error)).alias("v")).first()
    return got["v"]


def exact_quantile(df: DataFrame, col: str, q: float, n: int | None = None) -> float | None:
    """The ``q`` quantile with linear interpolation (NumPy's default).

    The column is never gathered: an approximate percentile brackets the two
    ranks needed, two counts verify the bracket, and only the rows inside it
    are sorted (a distributed sort) to read the exact values.  ``n``, when the
    caller knows it, is the number of non-null values (saves a count).
    """
    x = F.col(col).cast("double")
    base = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    if n is None:
        n = base.count()
    if n == 0:
        return None
    k = q * (n - 1)
    lo, hi = int(math.floor(k)), int(math.ceil(k))
    accuracy = 10_000
    slack = 4.0 / accuracy
    a, b = base.agg(F.percentile_approx("_x", [max(0.0, q - slack), min(1.0, q + slack)], accuracy)
                    .alias("ab")).collect()[0]["ab"]
    c = base.agg(F.count_if(F.col("_x") < a).alias("below"), F.count_if(F.col("_x") <= b).alias("upto")
                 ).collect()[0]
    below, upto = c["below"], c["upto"]
    if not (below <= lo and upto >= hi + 1):
        a, b, below = float("-inf"), float("inf"), 0
    inside = base.where((F.col("_x") >= a) & (F.col("_x") <= b))
    wanted = [lo - below, hi - below]
    picked = (index_sorted(inside.withColumn("_tie", F.monotonically_increasing_id()), ["_x", "_tie"],
                           out="_pos")
              .where(F.col("_pos").isin(wanted)).select("_pos", "_x").collect())
    vals = {r["_pos"]: r["_x"] for r in picked}
    v_lo, v_hi = vals[wanted[0]], vals[wanted[1]]
    return v_lo + (k - lo) * (v_hi - v_lo)
