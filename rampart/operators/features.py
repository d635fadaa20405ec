"""Model features: lengths, label codes, standard scaling, assembly.

Label dictionaries are tables ``(column, label, code)``; codes follow the
sorted label order (0..k-1 per column), computed with a distributed sort.
Scaler statistics are one row per column, small enough to become literals
in the projection, so scaling stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rampart.operators.numbering import index_sorted

NULL_LABEL = "nan"   # what a missing value turns into when cast to text
UNSEEN_CODE = -1     # code for a label the dictionary does not hold
NUMERIC = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.ShortType, T.ByteType)

# Feature lists of scoring and training, and the experiment's variant.
SCORE_FEATURES = ["lenToken", "lenURL", "URL", "RemoteAddress", "token"]
EXPERIMENT_FEATURES = ["lenToken", "lenURL", "Request", "URL"]


def add_lengths(df: DataFrame) -> DataFrame:
    """FT1 / FT2: ``lenToken`` (null → -1) and ``lenURL`` (null → 3, the
    length of the text a missing value prints as); -1 when the column is
    absent."""
    tok = F.coalesce(F.length("token"), F.lit(-1)) if "token" in df.columns else F.lit(-1)
    url = F.coalesce(F.length("URL"), F.lit(len(NULL_LABEL))) if "URL" in df.columns else F.lit(-1)
    return df.withColumn("lenToken", tok.cast("int")).withColumn("lenURL", url.cast("int"))


def string_columns(df: DataFrame, exclude: tuple = ()) -> list[str]:
    """FT4: columns encoded as labels."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude: tuple = ()) -> list[str]:
    """FT4: columns scaled."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def as_label(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL_LABEL))


def _label_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """FT10: distinct ``(column, label)`` over the given columns."""
    out = None
    for c in columns:
        part = df.select(F.lit(c).alias("column"), as_label(c).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _codes(pairs: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Sorted position of each label within its column (+ per-column start)."""
    indexed = index_sorted(pairs, ["column", "label"], out="_pos")
    first = indexed.groupBy("column").agg(F.min("_pos").alias("_first"))
    coded = indexed.join(F.broadcast(first), "column")  # one row per column
    code = F.col("_pos") - F.col("_first")
    if start is not None:
        coded = coded.join(F.broadcast(start), "column", "left")
        code = code + F.coalesce(F.col("_start"), F.lit(0))
    return coded.select("column", "label", code.cast("int").alias("code"))


def _materialize(df: DataFrame) -> DataFrame:
    """Write a fitted dictionary once to the shared checkpoint folder.

    A dictionary is read several times (anti join, code offsets, lookups);
    without this each read would redo the distinct, the sort and the
    offsets.
    """
    from rampart.session import write_table
    return write_table(df, "labels")


def fit_labels(df: DataFrame, columns: list[str], materialize: bool = True) -> DataFrame:
    """FT5: label dictionary, codes 0..k-1 in sorted label order."""
    out = _codes(_label_pairs(df, columns))
    return _materialize(out) if materialize else out


def new_labels(labels: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Labels of ``df`` the dictionary lacks."""
    return _label_pairs(df, columns).join(labels.select("column", "label"), ["column", "label"], "left_anti")


def update_labels(labels: DataFrame, df: DataFrame, columns: list[str], refit: bool = False,
                  materialize: bool = True) -> DataFrame:
    """FT6 / O4: extend the dictionary with ``df``'s new labels.

    Default: known codes never move; new labels get codes after the
    column's largest, in sorted order.  ``refit=True`` re-sorts the union
    and re-codes everything, as a refitted encoder would (codes may shift
    under a trained model).
    """
    fresh = new_labels(labels, df, columns)
    if refit:
        union = labels.select("column", "label").unionByName(fresh).distinct()
        out = _codes(union)
    else:
        start = labels.groupBy("column").agg((F.max("code") + 1).alias("_start"))
        out = labels.unionByName(_codes(fresh, start))
    return _materialize(out) if materialize else out


def encode(df: DataFrame, labels: DataFrame, columns: list[str], suffix: str = "_code",
           small_input: bool = False) -> DataFrame:
    """Add ``<column><suffix>`` with the label's code (unseen → -1).

    One left join per column; AQE broadcasts the small dictionaries and
    shuffles the large ones (a URL dictionary can be as long as the log).
    With ``small_input`` (a micro-batch) the dictionary is first cut to the
    input's own labels by a semi join, whose small side AQE broadcasts, so no
    micro-batch shuffles the whole dictionary.
    """
    out = df
    for c in columns:
        d = labels.where(F.col("column") == c).select(F.col("label").alias("_lbl"), F.col("code").alias("_code"))
        if small_input:
            wanted = df.select(as_label(c).alias("_lbl")).distinct()
            d = d.join(wanted, "_lbl", "left_semi")
        out = (out.join(d, as_label(c) == F.col("_lbl"), "left")
               .withColumn(c + suffix, F.coalesce("_code", F.lit(UNSEEN_CODE)))
               .drop("_lbl", "_code"))
    return out


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """FT7 fit: ``(column, mean, std, n)`` with population std, in one pass
    (``n`` is the number of rows fitted on)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"),
                      F.col(f"s{i}").alias("std"), F.col("n").alias("n")) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*parts)))


def scaler_stats(scaler: DataFrame) -> dict:
    """The scaler rows as ``{column: (mean, std)}`` (one row per column)."""
    return {r["column"]: (r["mean"], r["std"]) for r in scaler.collect()}


def scale(df: DataFrame, scaler, columns: list[str] | None = None,
          suffix: str = "") -> DataFrame:
    """FT7 apply: ``(x - mean) / std`` with a zero std treated as 1.

    The scaler has one row per column (a bound fixed by the schema), so it
    is read once and inlined as literals; ``scaler`` may also be those rows
    already read, as ``{column: (mean, std)}``.
    """
    stats = scaler if isinstance(scaler, dict) else scaler_stats(scaler)
    cols = columns or list(stats)
    out = df
    for c in cols:
        mean, std = stats[c]
        std = 1.0 if (std is None or std == 0.0) else std
        mean = 0.0 if mean is None else mean
        out = out.withColumn(c + suffix, (F.col(f"`{c}`").cast("double") - F.lit(mean)) / F.lit(std))
    return out
