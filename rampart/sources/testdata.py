"""Views of the driver's parquet tables as web-server logs.

The driver tables are not logs, so each view below maps them onto one with
plain column expressions (no UDF).  The raw-line builders turn the same rows
into text lines so that the parsers are exercised on real lines; the SQL
oracles compute the expected columns straight from the tables, without going
through any line.

Mapping of ``events`` onto an access log:

* ``id`` = ``event_id + 1``; ``RemoteAddress`` = ``10.0.<user div 256>.<user mod 256>``
* ``TimeLocal`` = ``ts`` cut to the second; ``Request`` = upper-cased event type
* ``URL`` = ``/<event_type>?k=<k>`` with ``k`` from ``props``, then attack
  fragment number ``k mod 8`` (none for 0)
* ``Status`` = ``500`` for ``error`` events, else ``200``
* ``BodyBytesSent`` = ``floor(value * 100)``; ``token`` = ``k`` times ``t``, null when ``k < 5``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.plans.partitioning import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Fixed values of the synthetic log lines (ours, not the reference's).
AGENT = '"Mozilla/5.0 (X11; Linux x86_64)"'
REFERER = '"-"'
FILLER = ["a", "b", "c", "d", "e"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over the cores when its scan is too coarse
    (each table is a single row group)."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def _pick(values: list, n: Column) -> Column:
    """``values[n mod len(values)]`` as a column."""
    idx = (F.pmod(n, F.lit(len(values))) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx)


def _k(props: Column) -> Column:
    return F.regexp_extract(props, r'"k": (\d+)', 1).cast("int")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a normalized access log (schema ``NORMALIZED``)."""
    ev = table(spark, sf_dir, "events")
    k = _k(F.col("props"))
    uid = F.col("user_id")
    return ev.select(
        (F.col("event_id") + 1).alias("id"),
        F.concat(F.lit("10.0."), F.floor(uid / 256).cast("string"), F.lit("."),
                 F.pmod(uid, F.lit(256)).cast("string")).alias("RemoteAddress"),
        F.lit("-").alias("RemoteUser"),
        F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").alias("TimeLocal"),
        F.upper("event_type").alias("Request"),
        F.concat(F.lit("/"), F.col("event_type"), F.lit("?k="), k.cast("string"),
                 _pick(ACCESS_SUFFIXES, k)).alias("URL"),
        F.lit("HTTP/1.1").alias("Version"),
        F.when(F.col("event_type") == "error", F.lit("500")).otherwise(F.lit("200")).alias("Status"),
        F.floor(F.col("value") * 100).cast("bigint").cast("string").alias("BodyBytesSent"),
        F.lit(REFERER).alias("Referer"),
        F.lit(AGENT).alias("UserAgent"),
        F.when(k >= 5, F.repeat(F.lit("t"), k)).alias("token"),
    )


def marker_lines(access: DataFrame) -> DataFrame:
    """Access-log rows written back as raw marker lines ``(id, value)``.

    A syslog-style prefix precedes ``RemoteAddress=``; rows without a token
    produce a 16-token line, which the parser rejects as ``too_few``.
    """
    t = F.col("TimeLocal")
    return access.select(
        "id",
        F.concat_ws(
            " ",
            F.date_format(t, "MMM d HH:mm:ss"), F.lit("web01"), F.lit("httpd:"),
            F.concat(F.lit("RemoteAddress="), F.col("RemoteAddress")), F.col("RemoteUser"),
            F.concat(F.lit("TimeLocal="), F.date_format(t, "dd/MMM/yyyy:HH:mm:ss")),
            F.lit("+0000"), F.col("Request"), F.col("URL"), F.col("Version"), F.col("Status"),
            F.col("BodyBytesSent"), F.col("Referer"), F.col("UserAgent"),
            *[F.lit(x) for x in FILLER], F.col("token"),
        ).alias("value"),
    )


def damaged_marker_lines(access: DataFrame) -> DataFrame:
    """Marker lines with one kind of damage chosen by ``id mod 10``.

    0: marker renamed (``no_marker``); 1: three extra tokens (``too_many``);
    2: day 99 (``bad_time``); 3: the last two tokens cut (``too_few``);
    other rows stay intact (and still lose their token when ``k < 5``).
    """
    lines = marker_lines(access)
    v, m = F.col("value"), F.pmod(F.col("id"), F.lit(10))
    return lines.select("id", F.when(m == 0, F.replace(v, F.lit("RemoteAddress="), F.lit("RemoteAddr=")))
                        .when(m == 1, F.concat(v, F.lit(" x y z")))
                        .when(m == 2, F.regexp_replace(v, r"TimeLocal=\d\d/", "TimeLocal=99/"))
                        .when(m == 3, F.regexp_replace(v, r" \S+ \S+$", ""))
                        .otherwise(v).alias("value"))


# Zones written into combined lines, by user id mod 3, as (text, seconds east).
ZONES = [("+0000", 0), ("+0200", 7200), ("-0530", -19800)]


def combined_method(event_type: Column) -> Column:
    return (F.when(event_type == "purchase", "POST").when(event_type == "signup", "PUT")
            .when(event_type == "error", "BREW").otherwise("GET"))


def combined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as standard combined-format lines ``(id, value)``.

    The local time is written in one of three zones for the same instant; a
    method outside the whitelist (``BREW``) and ``\\x22`` escapes in paths
    exercise the request rules; ``k < 5`` writes ``-`` as status (rejected).
    """
    ev = table(spark, sf_dir, "events")
    k = _k(F.col("props"))
    uid = F.col("user_id")
    zone_no = F.pmod(uid, F.lit(3))
    zone_txt = F.element_at(F.array(*[F.lit(z) for z, _ in ZONES]), (zone_no + 1).cast("int"))
    zone_sec = F.element_at(F.array(*[F.lit(s) for _, s in ZONES]), (zone_no + 1).cast("int"))
    epoch = F.unix_timestamp(F.date_trunc("second", F.col("ts")).cast("timestamp"))
    wall = F.timestamp_seconds(epoch + zone_sec)
    path = F.concat(F.lit("/"), F.col("event_type"), F.lit("?k="), k.cast("string"),
                    F.when(F.pmod(k, F.lit(10)) == 0, F.lit("&q=\\x22")).otherwise(F.lit("")))
    status = F.when(k < 5, F.lit("-")).when(F.col("event_type") == "error", F.lit("500")) \
        .otherwise(F.lit("200"))
    return ev.select(
        (F.col("event_id") + 1).alias("id"),
        F.concat(
            F.lit("10.0."), F.floor(uid / 256).cast("string"), F.lit("."),
            F.pmod(uid, F.lit(256)).cast("string"), F.lit(" - u"), uid.cast("string"),
            F.lit(" ["), F.date_format(wall, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" "), zone_txt,
            F.lit('] "'), combined_method(F.col("event_type")), F.lit(" "), path,
            F.lit(' HTTP/1.1" '), status, F.lit(" "),
            F.floor(F.col("value") * 100).cast("bigint").cast("string"),
            F.lit(' "-" '), F.lit(AGENT),
        ).alias("value"),
    )


# Attack fragments appended to page paths, by page id mod 8 (ours).
ATTACK_SUFFIXES = [
    "",
    "?id=1%27%20OR%201=1--",
    "?q=%3Cscript%3Ealert(1)%3C/script%3E",
    "?file=../../etc/passwd",
    "?u=http://evil.example/x.txt",
    "?cmd=ls%20%7C%20cat",
    "?p=%252e%252e%252f",
    "?s=a+b&t=100%&r=SeLeCt",
]
STATUSES = ["200", "404", "500"]
# The same fragments joined to an existing query string.
ACCESS_SUFFIXES = ["&" + s[1:] if s else "" for s in ATTACK_SUFFIXES]


def attack_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as request rows ``(id, URL, Status)``.

    The path is the page URL without scheme and host, followed by one of
    the attack fragments; the status cycles over 200, 404 and 500.
    """
    pg = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    suffix = _pick(ATTACK_SUFFIXES, pid)
    status = _pick(STATUSES, pid)
    return pg.select(
        pid.alias("id"),
        F.concat(F.regexp_replace("url", r"^[a-z]+://[^/]+", ""), suffix).alias("URL"),
        status.alias("Status"),
    )
