"""Log line parsers: the marker log (current) and the combined log (legacy).

Both are one lazy projection over ``(id, value)`` lines, with a ``reason``
column that is null for good rows.  ``split`` turns that into the typed table
and the reject table from one pass over the input (cache the parsed frame if
both are written).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.functions import text as X
from rampart.schemas import LEGACY, NORMALIZED_COLUMNS

# Tokens accepted by the marker parser: index 16 must exist, 19+ is rejected.
MIN_TOKENS, MAX_TOKENS = 17, 18


def parse_marker(lines: DataFrame, id_col: str = "id", value_col: str = "value", keep: tuple = ()) -> DataFrame:
    """Normalized columns plus ``reason`` (null = good row); the
    columns of ``keep`` pass through.

    Reasons, checked in this order: ``no_marker`` (no ``RemoteAddress=``),
    ``too_many`` (more than 18 tokens), ``too_few`` (fewer than 17),
    ``bad_time`` (time token does not parse).
    """
    base = lines.select(F.col(id_col).cast("bigint").alias("id"), F.col(value_col).alias("value"), *keep)
    staged = X.compute_once(base, ["id", "value", *keep], {"_t": X.tokens(X.from_marker(F.col("value")))})
    t = F.col("_t")
    n = F.size(t)
    time_local = X.parse_local_time(X.strip_prefix(X.token_at(t, 2), "TimeLocal="))
    staged = staged.select("id", "value", "_t", *keep, time_local.alias("TimeLocal"))
    reason = (F.when(n == 0, F.lit("no_marker"))
              .when(n > MAX_TOKENS, F.lit("too_many"))
              .when(n < MIN_TOKENS, F.lit("too_few"))
              .when(F.col("TimeLocal").isNull(), F.lit("bad_time")))
    return staged.select(
        "id",
        X.strip_prefix(X.token_at(t, 0), "RemoteAddress=").alias("RemoteAddress"),
        X.token_at(t, 1).alias("RemoteUser"),
        "TimeLocal",
        X.token_at(t, 4).alias("Request"),
        X.token_at(t, 5).alias("URL"),
        X.token_at(t, 6).alias("Version"),
        X.token_at(t, 7).alias("Status"),
        X.token_at(t, 8).alias("BodyBytesSent"),
        X.token_at(t, 9).alias("Referer"),
        X.token_at(t, 10).alias("UserAgent"),
        X.token_at(t, 16).alias("token"),
        *keep,
        "value",
        reason.alias("reason"),
    )


def split(parsed: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows (typed columns only) and rejects ``(id, value, reason)``."""
    cols = columns or NORMALIZED_COLUMNS
    good = parsed.where(F.col("reason").isNull()).select(*cols)
    bad = parsed.where(F.col("reason").isNotNull()).select("id", "value", "reason")
    return good, bad


def normalize(lines: DataFrame, id_col: str = "id", value_col: str = "value") -> DataFrame:
    """Good rows of ``parse_marker`` only."""
    return split(parse_marker(lines, id_col, value_col))[0]


def reject_counts(parsed: DataFrame) -> DataFrame:
    """Rejected lines per reason."""
    return (parsed.where(F.col("reason").isNotNull())
            .groupBy("reason").agg(F.count(F.lit(1)).alias("count")))


# --- combined log (legacy) ---------------------------------------------------

# One explicit pattern for the combined format: address, ident, user,
# [local time with zone], "request", status, size, "referer", "agent".
COMBINED_PATTERN = (r'^(\S+) (\S+) (\S+) \[([^\]]*)\] "((?:[^"\\]|\\.)*+)" (\S+) (\S+)'
                    r' "((?:[^"\\]|\\.)*+)" "((?:[^"\\]|\\.)*+)"')

# Request methods the legacy parser keeps; any other blanks the request.
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]


# Separator between captured groups; a line can hold it only as a quoted
# field's content, which the match check below catches.
_SEP = "\u0001\u0002\u0003"
_HIT = "\u0000"


def parse_combined(lines: DataFrame, id_col: str = "id", value_col: str = "value",
                   runtime_seed: int = 1) -> DataFrame:
    """Legacy columns plus ``reason`` (null = good row).

    The line is matched once: a single ``regexp_replace`` rewrites a matching
    line into its nine groups joined by a separator, and ``split`` cuts them
    apart.  The zone in the time field is honoured, so ``time_local`` is true
    epoch seconds.  ``runtime`` is a repeatable placeholder in 100..10000
    drawn from a hash of ``id`` and the seed.
    """
    v = F.col(value_col)
    template = _HIT + _SEP.join(f"${i}" for i in range(1, 10))
    base = lines.select(F.col(id_col).cast("bigint").alias("id"), v.alias("value"))
    rewritten = F.regexp_replace(F.col("value"), "(?s)" + COMBINED_PATTERN + ".*$", template)
    staged = X.compute_once(base, ["id", "value"], {"_r": rewritten})
    staged = staged.select("id", "value", F.split("_r", _SEP).alias("_g"),
                           (F.col("_r").startswith(_HIT) & ~F.col("value").startswith(_HIT)).alias("_ok"))
    g = F.col("_g")
    ok = F.col("_ok") & (F.size(g) == 9)

    def grp(i: int):
        x = F.get(g, i - 1)
        return F.substr(x, F.lit(2)) if i == 1 else x

    req = F.split(grp(5), " ")
    method = F.get(req, 0)
    known = method.isin(METHODS)
    status = grp(6).try_cast("int")
    size = grp(7).try_cast("bigint")
    epoch = X.parse_zoned_epoch(grp(4))
    reason = (F.when(~ok, F.lit("malformed"))
              .when(status.isNull(), F.lit("bad_status"))
              .when(size.isNull(), F.lit("bad_size"))
              .when(epoch.isNull(), F.lit("bad_time")))
    return staged.select(
        "id",
        grp(1).alias("remote_addr"),
        grp(3).alias("remote_user"),
        (F.pmod(F.xxhash64(F.col("id"), F.lit(runtime_seed)), F.lit(9901)) + 100).cast("int").alias("runtime"),
        epoch.alias("time_local"),
        F.when(known, method).otherwise(F.lit("")).alias("request_type"),
        F.when(known, X.unescape_backslash(F.coalesce(F.get(req, 1), F.lit(""))))
        .otherwise(F.lit("")).alias("request_path"),
        F.when(known, F.coalesce(F.get(req, 2), F.lit(""))).otherwise(F.lit("")).alias("request_protocol"),
        status.alias("status"),
        size.alias("size"),
        grp(8).alias("referer"),
        grp(9).alias("user_agent"),
        "value",
        reason.alias("reason"),
    )


def normalize_combined(lines: DataFrame, id_col: str = "id", value_col: str = "value") -> DataFrame:
    return split(parse_combined(lines, id_col, value_col), [f.name for f in LEGACY.fields])[0]
