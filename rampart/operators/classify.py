"""Attack classification of request URLs (pure column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.functions import text as X
from rampart.functions import urls as U


def classify(df: DataFrame, url: str = "URL", status: str = "Status",
             with_map: bool = False) -> DataFrame:
    """Add ``attack_types`` and ``critical_alert`` (and the map).

    The URL is decoded once and the six searches run once per row (see
    ``compute_once``: a later filter on the labels does not repeat them);
    the labels are derived from those booleans.  Null URL or status count
    as ``''``.
    """
    flag_cols = [f"_atk{i}" for i in range(len(U.ATTACK_NAMES))]
    decoded = U.percent_decode(F.coalesce(F.col(url), F.lit("")))
    staged = X.compute_once(df.select("*", decoded.alias("_decoded")), df.columns,
                            {c: U.attack_flag(F.col("_decoded"), n) for n, c in zip(U.ATTACK_NAMES, flag_cols)})
    flags = [F.col(c) for c in flag_cols]
    extra = [U.attack_types(flags).alias("attack_types"),
             U.critical_alert(flags, F.col(status)).alias("critical_alert")]
    if with_map:
        extra.append(U.attack_map(flags).alias("attacks"))
    return staged.select(*[F.col(c) for c in df.columns], *extra)


def decoded_urls(df: DataFrame, url: str = "URL") -> DataFrame:
    """C1 on its own: the percent-decoded URL beside the raw one."""
    return df.withColumn("decoded", U.percent_decode(F.col(url)))


# Fields of a positional row that classification needs: URL (6th), Status (8th).
MIN_FIELDS = 8


def field_count(line: Column) -> Column:
    """Number of CSV fields of a raw line (quoted fields may hold commas)."""
    return F.size(F.split(F.regexp_replace(line, '"(?:[^"]|"")*"', ""), ","))


def split_short_rows(df: DataFrame, corrupt_col: str = "_corrupt_record",
                     min_fields: int = MIN_FIELDS) -> tuple[DataFrame, DataFrame]:
    """C11's reject branch for positional CSV input: rows of fewer than
    ``min_fields`` fields are rejected; a row that is only shorter or longer
    than the schema keeps the fields it has."""
    if corrupt_col not in df.columns:
        return df, df.where(F.lit(False))
    short = F.col(corrupt_col).isNotNull() & (field_count(F.col(corrupt_col)) < min_fields)
    return df.where(~short).drop(corrupt_col), df.where(short)
