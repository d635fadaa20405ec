"""Registered queries (Spark) and their DuckDB oracles.

Every query reads whole driver tables through ``rampart.sources.testdata``
and runs a rampart operator chain on them.  Result columns are aliased the
same on both sides; timestamps leave as ``yyyy-MM-dd HH:mm:ss`` text and
doubles are rounded, so that both engines print identical values.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rampart.operators import blocking as B
from rampart.operators import classify as C
from rampart.functions import text as X
from rampart.functions import urls as U
from rampart import schemas as SC
from rampart.operators import dashboard as D
from rampart.operators import features as FT
from rampart.operators import forest as FR
from rampart.operators import threshold as TH
from rampart.operators.numbering import index_sorted
from rampart.operators import merge as M
from rampart.operators import parse as P
from rampart.plans import detect as DT
from rampart.plans import oracle as O
from rampart.sources import testdata as TD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as text and all integers as BIGINT, for the comparison."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# --- shared inputs -----------------------------------------------------------

def access(spark, sf):
    return TD.access_log(spark, sf)


def classified_access(spark, sf):
    return C.classify(access(spark, sf))


def error_table(spark, sf):
    """Stand-in for the classified anomaly table: rows with some attack."""
    return classified_access(spark, sf).where(F.col("attack_types") != U.NO_ATTACK)


CL_ACCESS = O.classified_cte("access", "classified")
ERR = "errors AS (SELECT * FROM classified WHERE attack_types <> 'Aucune')"
TAGGED = ("tagged AS (SELECT id, RemoteAddress, TimeLocal, 'access' AS kind FROM access "
          "UNION ALL SELECT id, RemoteAddress, TimeLocal, 'error' AS kind FROM errors)")


# --- slice 0: busiest addresses (D1 → D2 → D3) --------------------------------

@register("busiest_addresses", O.with_ctes(O.ACCESS, """
counts AS (SELECT RemoteAddress, count(*) AS count FROM access WHERE RemoteAddress IS NOT NULL GROUP BY 1)
""") + " SELECT RemoteAddress, count FROM counts")
def busiest_addresses(spark, sf):
    page = D.access_page(access(spark, sf))
    return page["by_address"]


@register("count_by_ip", O.with_ctes(O.ACCESS) + """
SELECT RemoteAddress, count(*) AS count FROM access WHERE RemoteAddress IS NOT NULL GROUP BY 1""")
def count_by_ip(spark, sf):
    return D.address_counts(access(spark, sf))


@register("group_size_filter", O.with_ctes(O.ACCESS) + """
SELECT id, RemoteAddress FROM (
  SELECT id, RemoteAddress, count(*) OVER (PARTITION BY RemoteAddress) AS n
  FROM access WHERE RemoteAddress IS NOT NULL) t
WHERE n BETWEEN 60 AND 80""")
def group_size_filter(spark, sf):
    return D.group_size_filter(access(spark, sf), 60, 80).select("id", "RemoteAddress")


@register("prefix_filter", O.with_ctes(O.ACCESS) + f"""
SELECT id, RemoteAddress, {O.ts_text('TimeLocal')} AS TimeLocal
FROM access WHERE starts_with(RemoteAddress, '10.0.0.1')""")
def prefix_filter(spark, sf):
    return plain(D.prefix_filter(access(spark, sf), "10.0.0.1").select("id", "RemoteAddress", "TimeLocal"))


@register("drill_down", O.with_ctes(O.ACCESS) + f"""
SELECT id, RemoteAddress, RemoteUser, {O.ts_text('TimeLocal')} AS TimeLocal, Request, URL, Version,
       Status, BodyBytesSent, Referer, UserAgent, token
FROM access WHERE RemoteAddress = '10.0.0.42'""")
def drill_down(spark, sf):
    return plain(D.drill_down(access(spark, sf), "10.0.0.42"))


@register("records_json", O.with_ctes(O.ACCESS) + """
SELECT CAST(to_json(struct_pack(id := id, RemoteAddress := RemoteAddress, URL := URL,
       Status := Status, token := token)) AS VARCHAR) AS record
FROM access WHERE RemoteAddress = '10.0.0.42'""")
def records_json(spark, sf):
    rows = D.drill_down(access(spark, sf), "10.0.0.42").select("id", "RemoteAddress", "URL", "Status", "token")
    return D.records_json(rows)


@register("total_count", O.with_ctes(O.ACCESS) + "SELECT count(*) AS total FROM access")
def total_count(spark, sf):
    return D.total_count(access(spark, sf))


@register("error_page_by_attack", O.with_ctes(O.ACCESS, CL_ACCESS, ERR, """
f AS (SELECT * FROM errors WHERE starts_with(RemoteAddress, '10.0.0.')),
g AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY RemoteAddress) AS n FROM f
                     WHERE RemoteAddress IS NOT NULL) t WHERE n BETWEEN 0 AND 1000)""") + """
SELECT attack_types, count(*) AS count FROM g GROUP BY 1""")
def error_page_by_attack(spark, sf):
    return D.error_page(error_table(spark, sf), "10.0.0.", 0, 1000)["by_attack"]


@register("error_page_by_address", O.with_ctes(O.ACCESS, CL_ACCESS, ERR, """
f AS (SELECT * FROM errors WHERE starts_with(RemoteAddress, '10.0.0.')),
g AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY RemoteAddress) AS n FROM f
                     WHERE RemoteAddress IS NOT NULL) t WHERE n BETWEEN 0 AND 1000)""") + """
SELECT RemoteAddress, count(*) AS count FROM g GROUP BY 1""")
def error_page_by_address(spark, sf):
    return D.error_page(error_table(spark, sf), "10.0.0.", 0, 1000)["by_address"]


@register("access_page_total", O.with_ctes(O.ACCESS, """
f AS (SELECT * FROM access WHERE starts_with(RemoteAddress, '10.0.0.1')),
g AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY RemoteAddress) AS n FROM f
                     WHERE RemoteAddress IS NOT NULL) t WHERE n BETWEEN 0 AND 1000)""") + """
SELECT count(*) AS total FROM g""")
def access_page_total(spark, sf):
    return D.access_page(access(spark, sf), "10.0.0.1", 0, 1000)["total"]


@register("count_by_attack_exploded", O.with_ctes(O.ACCESS, CL_ACCESS, ERR) + """
SELECT attack_types, count(*) AS count
FROM (SELECT unnest(string_split(attack_types, ', ')) AS attack_types FROM errors) t GROUP BY 1""")
def count_by_attack_exploded(spark, sf):
    return D.attack_counts(error_table(spark, sf), exploded=True)


# --- overview (V1–V7) ---------------------------------------------------------

def tagged(spark, sf):
    return D.with_kind(access(spark, sf), error_table(spark, sf))


OVERVIEW = O.with_ctes(O.ACCESS, CL_ACCESS, ERR, TAGGED)


@register("overview_total", OVERVIEW + " SELECT count(*) AS total FROM tagged")
def overview_total(spark, sf):
    return D.total_logs(tagged(spark, sf))


@register("overview_breakdown", OVERVIEW + """
SELECT kind, count, round(count / sum(count) OVER (), 9) AS share
FROM (SELECT kind, count(*) AS count FROM tagged GROUP BY 1) t""")
def overview_breakdown(spark, sf):
    return D.logs_breakdown(tagged(spark, sf)).withColumn("share", F.round("share", 9))


@register("overview_top_ips", O.with_ctes(O.ACCESS) + """
SELECT RemoteAddress AS ip, count(*) AS count FROM access WHERE RemoteAddress IS NOT NULL
GROUP BY 1 ORDER BY count DESC, ip ASC LIMIT 10""")
def overview_top_ips(spark, sf):
    return D.top_addresses(access(spark, sf), 10)


@register("overview_over_time", OVERVIEW + f"""
SELECT {O.ts_text("date_trunc('hour', TimeLocal)")} AS bucket, count(*) AS count FROM tagged GROUP BY 1""")
def overview_over_time(spark, sf):
    return plain(D.logs_over_time(tagged(spark, sf)))


@register("overview_heatmap", OVERVIEW + """
SELECT CAST(dayofweek(TimeLocal) + 1 AS BIGINT) AS dow, CAST(hour(TimeLocal) AS BIGINT) AS hour,
       count(*) AS count FROM tagged GROUP BY 1, 2""")
def overview_heatmap(spark, sf):
    return plain(D.hour_heatmap(tagged(spark, sf)))


@register("overview_error_vs_access", OVERVIEW + f"""
SELECT {O.ts_text("date_trunc('hour', TimeLocal)")} AS bucket,
       count(*) FILTER (WHERE kind = 'access') AS access,
       count(*) FILTER (WHERE kind = 'error') AS error
FROM tagged GROUP BY 1""")
def overview_error_vs_access(spark, sf):
    return plain(D.error_vs_access(tagged(spark, sf)))


@register("overview_recent_alerts", O.with_ctes(O.ACCESS, CL_ACCESS) + f"""
SELECT id, {O.ts_text('TimeLocal')} AS TimeLocal, attack_types AS alert_type,
       concat_ws(' ', RemoteAddress, Request, URL, Status) AS details
FROM classified WHERE critical_alert ORDER BY TimeLocal DESC, id DESC LIMIT 10""")
def overview_recent_alerts(spark, sf):
    return plain(D.recent_alerts(classified_access(spark, sf), 10))


# --- classification (C1–C12) --------------------------------------------------

@register("url_decode", O.with_ctes(O.ATTACK_URLS) + """
SELECT id, URL, url_decode(URL) AS decoded FROM attack_urls""")
def url_decode(spark, sf):
    return C.decoded_urls(TD.attack_urls(spark, sf)).select("id", "URL", "decoded")


# Ends of URLs with percent-encoded bytes that are no UTF-8, by page id; the
# expected text is the standard library's.
HOSTILE = ["%ED%A0%80", "%C3", "%C3%A9%FF", "%E0%80%AF", "%F0%9F%98", "%F0%9F%98%80", "%F4%90%80%80", "%C0%AE%C0%AE/",
           "%E6%BC+%A2", "%80%BF%", "%f1%80%80%41"]


@register("url_decode_bytes", O.with_ctes(O.ATTACK_URLS) + f"""
SELECT page_id AS id, regexp_replace(url, '^[a-z]+://[^/]+', '') || {O.pick([unquote(x) for x in HOSTILE], 'page_id')} AS decoded
FROM pages WHERE NOT contains(url, '%')""")
def url_decode_bytes(spark, sf):
    """C1 on byte sequences that are no UTF-8: one U+FFFD for each maximal part."""
    pg = TD.table(spark, sf, "pages").where(~F.col("url").contains("%"))
    url = F.concat(F.regexp_replace("url", r"^[a-z]+://[^/]+", ""), TD._pick(HOSTILE, F.col("page_id")))
    return pg.select(F.col("page_id").alias("id"), U.percent_decode(url).alias("decoded"))


@register("attack_types", O.with_ctes(O.ATTACK_URLS, O.classified_cte("attack_urls")) + """
SELECT id, attack_types FROM classified""")
def attack_types(spark, sf):
    return C.classify(TD.attack_urls(spark, sf)).select("id", "attack_types")


@register("critical", O.with_ctes(O.ATTACK_URLS, O.classified_cte("attack_urls")) + """
SELECT id, Status, critical_alert FROM classified""")
def critical(spark, sf):
    return C.classify(TD.attack_urls(spark, sf)).select("id", "Status", "critical_alert")


@register("classify_access", O.with_ctes(O.ACCESS, CL_ACCESS) + """
SELECT id, URL, attack_types, critical_alert FROM classified""")
def classify_access(spark, sf):
    return classified_access(spark, sf).select("id", "URL", "attack_types", "critical_alert")


# --- parsing (P1–P19) ----------------------------------------------------------

NORM_COLS_SQL = f"""id, RemoteAddress, RemoteUser, {O.ts_text('TimeLocal')} AS TimeLocal, Request, URL, Version,
       Status, BodyBytesSent, Referer, UserAgent, token"""


@register("parse_log", O.with_ctes(O.ACCESS) + f"""
SELECT {NORM_COLS_SQL} FROM access WHERE token IS NOT NULL""")
def parse_log(spark, sf):
    return plain(P.normalize(TD.marker_lines(access(spark, sf))))


@register("reject_counts", O.with_ctes(O.ACCESS) + """
SELECT reason, count(*) AS count FROM (
  SELECT CASE WHEN id % 10 = 0 THEN 'no_marker'
              WHEN id % 10 = 1 THEN 'too_many'
              WHEN id % 10 = 3 THEN 'too_few'
              WHEN token IS NULL THEN 'too_few'
              WHEN id % 10 = 2 THEN 'bad_time' END AS reason
  FROM access) t
WHERE reason IS NOT NULL GROUP BY 1""")
def reject_counts(spark, sf):
    return P.reject_counts(P.parse_marker(TD.damaged_marker_lines(access(spark, sf))))


@register("parse_with_rejects", O.with_ctes(O.ACCESS) + """
SELECT count(*) FILTER (WHERE token IS NOT NULL AND id % 10 NOT IN (0, 1, 2, 3)) AS good,
       count(*) FILTER (WHERE NOT (token IS NOT NULL AND id % 10 NOT IN (0, 1, 2, 3))) AS rejected,
       count(*) AS lines
FROM access""")
def parse_with_rejects(spark, sf):
    parsed = P.parse_marker(TD.damaged_marker_lines(access(spark, sf)))
    return parsed.agg(F.count_if(F.col("reason").isNull()).alias("good"),
                      F.count_if(F.col("reason").isNotNull()).alias("rejected"),
                      F.count(F.lit(1)).alias("lines"))


@register("clean_text", """
SELECT doc_id, CAST(length(c) AS BIGINT) AS n_clean, md5(c) AS md5_clean
FROM (SELECT doc_id, regexp_replace(text, '[^\\x20-\\x7E\\n\\r\\t]', '', 'g') AS c FROM documents) t""")
def clean_text(spark, sf):
    c = X.ascii_clean(F.col("text"))
    return (TD.table(spark, sf, "documents")
            .select("doc_id", F.length(c).cast("bigint").alias("n_clean"), F.md5(c).alias("md5_clean")))


@register("quote_wrap", """
SELECT doc_id, CAST(length(w) AS BIGINT) AS n_wrapped, md5(w) AS md5_wrapped
FROM (SELECT doc_id, '"' || replace(regexp_replace(text, '[^\\x20-\\x7E\\n\\r\\t]', '', 'g'), '"', '""') || '"' AS w
      FROM documents) t""")
def quote_wrap(spark, sf):
    w = X.export_clean(F.col("text"))
    return (TD.table(spark, sf, "documents")
            .select("doc_id", F.length(w).cast("bigint").alias("n_wrapped"), F.md5(w).alias("md5_wrapped")))


@register("tokenize", """
SELECT doc_id, CAST(len(regexp_extract_all(text, '"(?:\\\\[^\\n]|[^\\\\"])*"|\\S+')) AS BIGINT) AS n_tokens
FROM documents""")
def tokenize(spark, sf):
    return (TD.table(spark, sf, "documents")
            .select("doc_id", F.size(X.tokens(F.col("text"))).cast("bigint").alias("n_tokens")))


@register("combined_parse", O.with_ctes(O.ACCESS) + f"""
SELECT id,
       RemoteAddress AS remote_addr,
       'u' || CAST(user_id AS VARCHAR) AS remote_user,
       CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS time_local,
       CASE WHEN event_type = 'error' THEN '' ELSE
         CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' ELSE 'GET' END END AS request_type,
       CASE WHEN event_type = 'error' THEN '' ELSE
         '/' || event_type || '?k=' || CAST(k AS VARCHAR) || CASE WHEN k % 10 = 0 THEN '&q=x22' ELSE '' END
       END AS request_path,
       CASE WHEN event_type = 'error' THEN '' ELSE 'HTTP/1.1' END AS request_protocol,
       CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS BIGINT) AS status,
       CAST(floor(value * 100) AS BIGINT) AS size,
       '-' AS referer,
       {O.q(TD.AGENT[1:-1])} AS user_agent
FROM access WHERE k >= 5""")
def combined_parse(spark, sf):
    return plain(P.normalize_combined(TD.combined_lines(spark, sf)).drop("runtime"))


@register("combined_rejects", O.with_ctes(O.ACCESS) + """
SELECT 'bad_status' AS reason, count(*) AS count FROM access WHERE k < 5 HAVING count(*) > 0""")
def combined_rejects(spark, sf):
    return P.reject_counts(P.parse_combined(TD.combined_lines(spark, sf)))


# --- merge (O1–O3, P18) -------------------------------------------------------

def merge_sources(spark, sf):
    """Two logs from ``events`` split by event id parity; hour-resolution
    times make ties across the files; ``k < 5`` rows carry no time."""
    a = access(spark, sf).withColumn("k", F.regexp_extract("URL", r"\?k=(\d+)", 1).cast("int"))
    line = F.when(F.col("k") < 5, F.concat(F.lit("-- MARK -- event "), F.col("id").cast("string"))) \
        .otherwise(F.concat(F.lit("["), F.date_format(F.date_trunc("hour", "TimeLocal"), "dd/MMM/yyyy:HH:mm:ss"),
                            F.lit("] event "), F.col("id").cast("string")))
    rows = a.select(F.col("id").alias("line_no"), line.alias("value"), (F.col("id") % 2).alias("_p"))
    return [rows.where(F.col("_p") == 1).drop("_p"), rows.where(F.col("_p") == 0).drop("_p")]


@register("merge_logs", O.with_ctes(O.ACCESS) + f"""
SELECT CAST(row_number() OVER (ORDER BY ts, file_no, line_no) - 1 AS BIGINT) AS pos,
       file_no, line_no, {O.ts_text('ts')} AS ts,
       '[' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || '] event ' || CAST(line_no AS VARCHAR) AS value
FROM (SELECT CAST(CASE WHEN id % 2 = 1 THEN 1 ELSE 2 END AS BIGINT) AS file_no, id AS line_no,
             date_trunc('hour', TimeLocal) AS ts
      FROM access WHERE k >= 5) t""")
def merge_logs(spark, sf):
    merged = M.merge_logs(merge_sources(spark, sf))
    return plain(merged.select("pos", "file_no", "line_no", "ts", "value"))


# --- numbering of a written log (SRC1, SNK10, P7) -------------------------------

@register("number_lines", """
SELECT event_id + 1 AS id, 'event ' || CAST(event_id AS VARCHAR) AS value FROM events""")
def number_lines_query(spark, sf):
    """Write events as text lines in event order (several part files), read
    them back and number them in file order."""
    from rampart.session import shared_dir
    from rampart.sinks import write_merged_text
    from rampart.sources.files import read_lines
    out = shared_dir(spark, "lines")
    ev = TD.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("value"))
    write_merged_text(ev.repartition(4), out, ["event_id"])
    return read_lines(spark, out, numbered=True).select("id", "value")


# --- blocking (J1, J3, B1, B2) ------------------------------------------------

# Whitelist used by the queries (a parameter, like the reference's setting).
WHITELIST = ["10.0.0.0/26", "10.0.0.100", "10.0.1.0/28", "not-an-address"]


def blocked_list(spark, sf):
    """Existing block list: addresses that sent a request valued over 300."""
    ev = TD.table(spark, sf, "events").where(F.col("value") > 300)
    uid = F.col("user_id")
    return ev.select(F.concat(F.lit("10.0."), F.floor(uid / 256).cast("string"), F.lit("."),
                              F.pmod(uid, F.lit(256)).cast("string")).alias("RemoteAddress")).distinct()


def whitelist_df(spark):
    return spark.createDataFrame([(e,) for e in WHITELIST], "entry STRING")


BLOCKED_SQL = "blocked AS (SELECT DISTINCT RemoteAddress FROM access WHERE value > 300)"
WL_SQL = """wl AS (
  SELECT RemoteAddress FROM access
  WHERE RemoteAddress = '10.0.0.100'
     OR (split_part(RemoteAddress, '.', 1) = '10' AND split_part(RemoteAddress, '.', 2) = '0'
         AND ((split_part(RemoteAddress, '.', 3) = '0' AND CAST(split_part(RemoteAddress, '.', 4) AS INT) < 64)
           OR (split_part(RemoteAddress, '.', 3) = '1' AND CAST(split_part(RemoteAddress, '.', 4) AS INT) < 16))))"""


@register("new_blocked", O.with_ctes(O.ACCESS, CL_ACCESS, ERR, BLOCKED_SQL) + """
SELECT DISTINCT RemoteAddress FROM errors
WHERE RemoteAddress IS NOT NULL AND RemoteAddress NOT IN (SELECT RemoteAddress FROM blocked)""")
def new_blocked(spark, sf):
    return B.new_addresses(error_table(spark, sf), blocked_list(spark, sf))


@register("whitelist_excl", O.with_ctes(O.ACCESS, WL_SQL) + """
SELECT RemoteAddress, count(*) AS count FROM access
WHERE RemoteAddress NOT IN (SELECT RemoteAddress FROM wl) GROUP BY 1""")
def whitelist_excl(spark, sf):
    kept = B.exclude_whitelisted(access(spark, sf), whitelist_df(spark))
    return D.address_counts(kept)


@register("block_refresh_critical", O.with_ctes(O.ACCESS, CL_ACCESS, BLOCKED_SQL, WL_SQL) + """
SELECT DISTINCT RemoteAddress FROM classified
WHERE critical_alert AND RemoteAddress IS NOT NULL
  AND RemoteAddress NOT IN (SELECT RemoteAddress FROM blocked)
  AND RemoteAddress NOT IN (SELECT RemoteAddress FROM wl)""")
def block_refresh_critical(spark, sf):
    return B.refresh_blocklist(classified_access(spark, sf), blocked_list(spark, sf),
                               whitelist_df(spark), critical_only=True)


RATE_SQL = """
SELECT RemoteAddress, strftime(min(TimeLocal), '%Y-%m-%d %H:%M:%S') AS ban_time FROM (
  SELECT RemoteAddress, TimeLocal,
         count(*) OVER (PARTITION BY RemoteAddress ORDER BY epoch(TimeLocal)
                        RANGE BETWEEN {findtime} PRECEDING AND CURRENT ROW) AS n
  FROM access WHERE {cond}) t
WHERE n >= {maxretry} GROUP BY 1"""


@register("rate_ban", O.with_ctes(O.ACCESS) + RATE_SQL.format(
    findtime=86400, maxretry=5, cond="regexp_matches(Status, '^[45]')"))
def rate_ban(spark, sf):
    return plain(B.rate_ban(access(spark, sf), B.failed_request(), findtime=86400, maxretry=5))


@register("rate_limit", O.with_ctes(O.ACCESS) + RATE_SQL.format(findtime=86400, maxretry=5, cond="true"))
def rate_limit(spark, sf):
    return plain(B.rate_ban(access(spark, sf), None, findtime=86400, maxretry=5))


# --- features (FT1–FT10, J2, O4, O5) -----------------------------------------

CATS = ["URL", "RemoteAddress", "token"]


def _pairs_sql(src: str) -> str:
    return " UNION ".join(f"SELECT DISTINCT '{c}' AS \"column\", coalesce({c}, 'nan') AS label FROM {src}"
                          for c in CATS)


@register("lengths", O.with_ctes(O.ACCESS) + """
SELECT id, CAST(coalesce(length(token), -1) AS BIGINT) AS lenToken,
       CAST(coalesce(length(URL), 3) AS BIGINT) AS lenURL FROM access""")
def lengths(spark, sf):
    return plain(FT.add_lengths(access(spark, sf)).select("id", "lenToken", "lenURL"))


@register("label_encode", O.with_ctes(O.ACCESS, f"pairs AS ({_pairs_sql('access')})") + """
SELECT "column", label, CAST(dense_rank() OVER (PARTITION BY "column" ORDER BY label) - 1 AS BIGINT) AS code
FROM pairs""")
def label_encode(spark, sf):
    return plain(FT.fit_labels(access(spark, sf), CATS))


KNOWN_SRC = "(SELECT * FROM access WHERE event_type IN ('view', 'click'))"


@register("label_update", O.with_ctes(
    O.ACCESS,
    f"known_pairs AS ({_pairs_sql(KNOWN_SRC)})",
    f"all_pairs AS ({_pairs_sql('access')})",
    """known AS (SELECT "column", label, dense_rank() OVER (PARTITION BY "column" ORDER BY label) - 1 AS code
               FROM known_pairs)""",
    """fresh AS (SELECT "column", label FROM all_pairs EXCEPT SELECT "column", label FROM known_pairs)""",
    """start AS (SELECT "column", max(code) + 1 AS s FROM known GROUP BY 1)""") + """
SELECT "column", label, CAST(code AS BIGINT) AS code FROM known
UNION ALL
SELECT f."column", f.label,
       CAST(coalesce(s.s, 0) + dense_rank() OVER (PARTITION BY f."column" ORDER BY f.label) - 1 AS BIGINT) AS code
FROM fresh f LEFT JOIN start s ON f."column" = s."column\"""")
def label_update(spark, sf):
    a = access(spark, sf)
    known = FT.fit_labels(a.where(F.col("Request").isin("VIEW", "CLICK")), CATS)
    return plain(FT.update_labels(known, a, CATS))


@register("label_new", O.with_ctes(
    O.ACCESS, f"known_pairs AS ({_pairs_sql(KNOWN_SRC)})", f"all_pairs AS ({_pairs_sql('access')})") + """
SELECT "column", label FROM all_pairs EXCEPT SELECT "column", label FROM known_pairs""")
def label_new(spark, sf):
    a = access(spark, sf)
    known = FT.fit_labels(a.where(F.col("Request").isin("VIEW", "CLICK")), CATS)
    return FT.new_labels(known, a, CATS)


@register("label_refit", O.with_ctes(O.ACCESS, f"pairs AS ({_pairs_sql('access')})") + """
SELECT "column", label, CAST(dense_rank() OVER (PARTITION BY "column" ORDER BY label) - 1 AS BIGINT) AS code
FROM pairs""")
def label_refit(spark, sf):
    a = access(spark, sf)
    known = FT.fit_labels(a.where(F.col("Request").isin("VIEW", "CLICK")), CATS)
    return plain(FT.update_labels(known, a, CATS, refit=True))


@register("scale_stats", O.with_ctes(O.ACCESS) + """
SELECT * FROM (
  SELECT 'id' AS "column", round(avg(id), 6) AS mean, round(stddev_pop(id), 6) AS std FROM access
  UNION ALL SELECT 'lenToken', round(avg(coalesce(length(token), -1)), 6),
                   round(stddev_pop(coalesce(length(token), -1)), 6) FROM access
  UNION ALL SELECT 'lenURL', round(avg(coalesce(length(URL), 3)), 6),
                   round(stddev_pop(coalesce(length(URL), 3)), 6) FROM access) t""")
def scale_stats(spark, sf):
    st = FT.fit_scaler(FT.add_lengths(access(spark, sf)), ["id", "lenToken", "lenURL"])
    return st.select("column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _feature_sql() -> str:
    codes = ",\n".join(
        f"  dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1 AS {c}_code" for c in CATS)
    raw = f"""raw AS (
  SELECT id, CAST(coalesce(length(token), -1) AS DOUBLE) AS lenToken,
         CAST(coalesce(length(URL), 3) AS DOUBLE) AS lenURL,
{codes}
  FROM access)"""
    names = ["lenToken", "lenURL"] + [f"{c}_code" for c in CATS]
    cols = ",\n".join(
        f"  round((x{i} - avg(x{i}) OVER ()) / coalesce(nullif(stddev_pop(x{i}) OVER (), 0), 1), 6) AS f{i}"
        for i in range(len(names)))
    ren = ", ".join(f"CAST({n} AS DOUBLE) AS x{i}" for i, n in enumerate(names))
    return O.with_ctes(O.ACCESS, raw, f"xs AS (SELECT id, {ren} FROM raw)") + f"\nSELECT id,\n{cols}\nFROM xs"


@register("feature_matrix", _feature_sql())
def feature_matrix(spark, sf):
    frame, _, _ = DT.prepare(access(spark, sf), FT.SCORE_FEATURES)
    return frame.select("id", *[F.round(f"f{i}", 6).alias(f"f{i}") for i in range(5)])


# --- thresholds (A1–A3, M3, M5, M6) ----------------------------------------------

@register("batch_stats", O.with_ctes(O.ACCESS) + """
SELECT CAST(floor((id - 1) / 25) AS BIGINT) AS batch_id,
       round(avg(-value / 1000), 9) AS score_mean, round(stddev_pop(-value / 1000), 9) AS score_std
FROM access GROUP BY 1""")
def batch_stats(spark, sf):
    s = TH.with_batches(access_scores(spark, sf), 25)
    st = TH.batch_stats(s, "score", "batch_id")
    return st.select("batch_id", F.round("score_mean", 9).alias("score_mean"),
                     F.round("score_std", 9).alias("score_std"))


def access_scores(spark, sf):
    """Stand-in scores in [-0.5, 0): lower is odder, like the forest's."""
    ev = TD.table(spark, sf, "events")
    return ev.select((F.col("event_id") + 1).alias("id"), (-F.col("value") / 1000).alias("score"))


@register("adaptive_threshold", O.with_ctes(O.ACCESS) + """
SELECT id, batch_id, round(score, 9) AS score FROM (
  SELECT id, batch_id, score, avg(score) OVER (PARTITION BY batch_id) AS m,
         stddev_pop(score) OVER (PARTITION BY batch_id) AS s
  FROM (SELECT id, CAST(floor((id - 1) / 25) AS BIGINT) AS batch_id, -value / 1000 AS score FROM access) a) t
WHERE score < m * (1 - 10 * s) AND score < 0.09""")
def adaptive_threshold(spark, sf):
    s = TH.with_batches(access_scores(spark, sf), 25)
    kept = TH.adaptive_filter(s, "score", "batch_id")
    return kept.select("id", "batch_id", F.round("score", 9).alias("score"))


@register("contamination_cut", """
SELECT event_id + 1 AS id, CAST(-1 AS BIGINT) AS anomaly,
       round(value - (SELECT quantile_cont(value, 0.0007) FROM events), 9) AS anomaly_score
FROM events WHERE value - (SELECT quantile_cont(value, 0.0007) FROM events) < 0""")
def contamination_cut(spark, sf):
    ev = TD.table(spark, sf, "events").select((F.col("event_id") + 1).alias("id"),
                                              F.col("value").alias("raw_score"))
    offset = FR.fit_offset(ev, 0.0007)
    flagged = FR.anomalies(FR.decide(ev, offset))
    return flagged.select("id", F.col("anomaly").cast("bigint").alias("anomaly"),
                          F.round("anomaly_score", 9).alias("anomaly_score"))


SKETCH_ERROR = 1e-3


@register("contamination_sketch", f"""
SELECT CAST(count(*) AS BIGINT) AS n, true AS below_holds, true AS upto_holds FROM events WHERE value IS NOT NULL""")
def contamination_sketch(spark, sf):
    """M3 in one pass: the rows below and up to the approximate offset leave
    its rank within the stated error of the exact one."""
    ev = TD.table(spark, sf, "events").where(F.col("value").isNotNull()).select(F.col("value").alias("raw_score"))
    offset = F.lit(FR.fit_offset(ev, 0.0007, error=SKETCH_ERROR)).cast("double")
    c = ev.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw_score") < offset).alias("below"),
               F.count_if(F.col("raw_score") <= offset).alias("upto"))
    return c.select("n", (F.col("below") <= F.col("n") * (0.0007 + SKETCH_ERROR) + 1).alias("below_holds"),
                    (F.col("upto") >= F.col("n") * (0.0007 - SKETCH_ERROR) - 1).alias("upto_holds"))


# --- isolation forest (M1–M6): no SQL oracle; see tests/test_forest.py ----------

@register("forest_score")
def forest_score(spark, sf):
    """Train on the whole access log (100 trees, 150 samples, seed 42) and
    score every row."""
    _, scored = DT.train(spark, access(spark, sf))
    return scored.select("id", F.round("anomaly_score", 9).alias("anomaly_score"),
                         F.col("anomaly").cast("bigint").alias("anomaly"))


@register("forest_anomalies")
def forest_anomalies(spark, sf):
    """M6: the training rows labelled -1 (contamination 0.0007)."""
    _, scored = DT.train(spark, access(spark, sf))
    return plain(FR.anomalies(scored).select("id", "RemoteAddress", "URL", "anomaly_score"))


# --- streaming (SRC2-style file stream, S3–S6, stateful B2) ----------------------

ROWS_PER_FILE = 250_000


def _write_log_files(spark, sf, n_files: int = 4, shuffled: bool = False, rows: DataFrame | None = None,
                     out: str | None = None) -> tuple[str, int]:
    """Marker lines of the access log (or of ``rows``) as at least ``n_files``
    text files under the shared folder; returns their folder and number.

    Files hold ranges of ids in name order, or rows from all times each, and
    are dated in name order, so that a file stream takes them one after the other.
    """
    from rampart.session import file_names, shared_dir
    out = out or shared_dir(spark, "log")
    a = access(spark, sf) if rows is None else rows
    n = max(n_files, -(-a.count() // ROWS_PER_FILE))
    dealt = a.repartition(n, "id") if shuffled else a.repartitionByRange(n, "id").sortWithinPartitions("id")
    TD.marker_lines(dealt).select("value").write.mode("append").text(out)
    names = file_names(spark, out)
    fs = spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    now = int(time.time()) * 1000
    for i, name in enumerate(names):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(name), now - 1000 * (len(names) - i), -1)
    return out, len(names)


@register("stream_classify", O.with_ctes(O.ACCESS, CL_ACCESS) + f"""
SELECT RemoteAddress, {O.ts_text('TimeLocal')} AS TimeLocal, URL, attack_types, critical_alert
FROM classified WHERE token IS NOT NULL""")
def stream_classify(spark, sf):
    """Log files → streaming parse (several micro-batches) → foreachBatch
    classify → per-batch partitions; the result is read back whole."""
    from rampart.session import shared_dir
    from rampart.streaming.live import outputs_under, start_file_stream
    logs, n = _write_log_files(spark, sf)
    out, ckpt = shared_dir(spark, "live-out"), shared_dir(spark, "live-ckpt")
    start_file_stream(spark, logs, out, ckpt, model=None, max_files=-(-n // 2))
    res = spark.read.parquet(outputs_under(out).classified)
    return plain(res.select("RemoteAddress", "TimeLocal", "URL", "attack_types", "critical_alert"))


@register("tail_batches", O.with_ctes(O.ACCESS, CL_ACCESS) + f"""
SELECT n AS id, RemoteAddress, {O.ts_text('TimeLocal')} AS TimeLocal, URL, attack_types, (n - 1) // 5 AS line_batch
FROM (SELECT *, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS lines FROM classified) t
WHERE token IS NOT NULL AND n <= lines // 5 * 5""")
def tail_batches(spark, sf):
    """SRC2 / S1–S6: the tailed log in batches of five lines with running
    line numbers, over rotations and restarts.

    The log is written as files of consecutive lines, which become the tailed
    file in turn (the one before is rotated away); the stream is started anew
    from its checkpoint four times, with rotations in between.
    """
    from rampart.session import delete_path, file_names, rename_path, shared_dir
    from rampart.streaming.live import outputs_under, start_tail
    parts, _ = _write_log_files(spark, sf)
    folder, out = shared_dir(spark, "tailed"), shared_dir(spark, "tail-out")
    log, ckpt = folder + "/access.log", shared_dir(spark, "tail-ckpt")
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(
        spark._jvm.org.apache.hadoop.fs.Path(folder))
    names = file_names(spark, parts)
    step = -(-max(len(names) - 1, 1) // 3)
    runs = [names[:1], *(names[i:i + step] for i in range(1, len(names), step))]
    for group in runs:
        # the file before and all but the last of the group end up as .k, ..., .1
        for n, name in zip(range(len(group), -1, -1), [log, *group]):
            rename_path(spark, name, f"{log}.{n}" if n else log)
        start_tail(spark, log, out, ckpt, encoding="utf-8", starting="earliest", available_now=True).awaitTermination()
        for n in range(1, len(group) + 1):
            delete_path(spark, f"{log}.{n}")
    rows = spark.read.parquet(outputs_under(out).classified)
    return plain(rows.select("id", "RemoteAddress", "TimeLocal", "URL", "attack_types", "line_batch"))


@register("stream_rate_ban", O.with_ctes(O.ACCESS, "parsed AS (SELECT * FROM access WHERE token IS NOT NULL)")
          + RATE_SQL.format(findtime=86400, maxretry=5, cond="true").replace("FROM access", "FROM parsed"))
def stream_rate_ban(spark, sf):
    """Streaming ban over shuffled log files in four micro-batches; the
    emitted bans are read back and reduced to one an address."""
    from rampart.session import shared_dir
    from rampart.streaming.rateban import ban_times, start_rate_ban
    logs, n = _write_log_files(spark, sf, shuffled=True)
    out = shared_dir(spark, "ban-out")
    lines = spark.readStream.schema("value STRING").option("maxFilesPerTrigger", -(-n // 4)).text(logs)
    good = P.normalize(lines.select(F.xxhash64("value").alias("id"), "value"))
    start_rate_ban(good, out, shared_dir(spark, "ban-state"), shared_dir(spark, "ban-ckpt"), None, findtime=86400, maxretry=5,
                   lateness=3650 * 86400, available_now=True).awaitTermination()
    return plain(ban_times(spark.read.parquet(out)))


@register("stream_block", O.with_ctes(O.ACCESS, CL_ACCESS, ERR, BLOCKED_SQL, WL_SQL) + """
SELECT RemoteAddress, CAST(1 AS BIGINT) AS lines FROM (
  SELECT RemoteAddress FROM blocked UNION
  SELECT RemoteAddress FROM errors WHERE token IS NOT NULL AND RemoteAddress NOT IN (SELECT RemoteAddress FROM wl)) t""")
def stream_block(spark, sf):
    """J1 / J3 / B1 on a stream: log files classified as they come, new
    addresses appended to the block list, over several micro-batches and a
    restart; how often each address stands in the list."""
    from rampart.session import shared_dir
    from rampart.streaming.blocking import start_block_stream
    lst, logs, ckpt = (shared_dir(spark, x) for x in ("blocklist", "log", "block-ckpt"))
    blocked_list(spark, sf).write.text(lst)
    half = access(spark, sf)
    for i in range(2):
        _, n = _write_log_files(spark, sf, 2, rows=half.where(F.col("id") % 2 == i), out=logs)
        lines = spark.readStream.schema("value STRING").option("maxFilesPerTrigger", -(-n // 4)).text(logs)
        rows = C.classify(P.normalize(lines.select(F.xxhash64("value").alias("id"), "value")))
        start_block_stream(rows.where(F.col("attack_types") != U.NO_ATTACK), lst, ckpt, whitelist_df(spark),
                           available_now=True).awaitTermination()
    lines = spark.read.option("recursiveFileLookup", True).text(lst)
    return lines.groupBy(F.col("value").alias("RemoteAddress")).agg(F.count(F.lit(1)).alias("lines"))


@register("forest_experiment")
def forest_experiment(spark, sf):
    """The experiment variant: features lenToken, lenURL, Request, URL;
    default 256 samples per tree; contamination 0.0005; seed 42."""
    _, scored = DT.train(spark, access(spark, sf), features=FT.EXPERIMENT_FEATURES, psi=256,
                         contamination=DT.EXPERIMENT_CONTAMINATION, seed=42)
    return scored.select("id", F.round("anomaly_score", 9).alias("anomaly_score"),
                         F.col("anomaly").cast("bigint").alias("anomaly"))


@register("stream_detect")
def stream_detect(spark, sf):
    """E1 end to end: a model trained on the access log, then the log files
    streamed through parse → score → per-batch cut → classify."""
    from rampart.session import shared_dir
    from rampart.streaming.live import outputs_under, start_file_stream
    model, _ = DT.train(spark, access(spark, sf))
    logs, n = _write_log_files(spark, sf)
    out, ckpt = shared_dir(spark, "detect-out"), shared_dir(spark, "detect-ckpt")
    start_file_stream(spark, logs, out, ckpt, model=model, max_files=-(-n // 2))
    res = spark.read.parquet(outputs_under(out).classified)
    return plain(res.select("RemoteAddress", "TimeLocal", "URL", "anomaly_score", "attack_types",
                            "critical_alert"))


# --- UTF-16LE logs (SRC3 through the byte-range reader, P7, P1–P8) -------------

@register("utf16_parse", O.with_ctes(O.ACCESS) + f"""
SELECT {NORM_COLS_SQL.replace('id, ', 'id AS line_no, ', 1)}
FROM access WHERE token IS NOT NULL""")
def utf16_parse(spark, sf):
    """Marker lines written as UTF-16LE files (several parts, time order),
    read back by the byte-range reader, numbered in file order, parsed."""
    from rampart.session import shared_dir
    from rampart.sources.files import read_lines
    out = shared_dir(spark, "utf16")
    lines = TD.marker_lines(access(spark, sf))
    (lines.repartitionByRange(4, "id").sortWithinPartitions("id").select("value").write
     .option("encoding", "UTF-16LE").option("lineSep", "\n").option("sep", "\u0001")
     .option("quote", "\u0000").option("escapeQuotes", False).option("quoteAll", False)
     .csv(out))
    parsed = P.normalize(read_lines(spark, out, encoding="UTF-16LE", numbered=True))
    return plain(parsed.withColumnRenamed("id", "line_no"))


# --- isolation forest against SQL (M1, M2, M4–M6, FT9) ----------------------------

# A small literal forest: (tree, node, feature, threshold, left, right, path).
WALK_NODES = [(0, 0, 0, 50.0, 1, 2, None), (0, 1, -1, 0.0, -1, -1, 2.5), (0, 2, 1, 40.0, 3, 4, None),
              (0, 3, -1, 0.0, -1, -1, 3.75), (0, 4, -1, 0.0, -1, -1, 1.0),
              (1, 0, 1, 20.0, 1, 2, None), (1, 1, -1, 0.0, -1, -1, 4.0), (1, 2, -1, 0.0, -1, -1, 2.0)]
WALK_PSI, WALK_OFFSET = 150, -0.75


@register("forest_walk", f"""
SELECT id, user_id, round(value, 9) AS value, round(raw - ({WALK_OFFSET}), 9) AS anomaly_score,
       CAST(CASE WHEN raw - ({WALK_OFFSET}) < 0 THEN -1 ELSE 1 END AS BIGINT) AS anomaly
FROM (SELECT event_id + 1 AS id, user_id, value, -pow(2, -((
        CASE WHEN value <= 50 THEN 2.5 WHEN user_id <= 40 THEN 3.75 ELSE 1.0 END
        + CASE WHEN user_id <= 20 THEN 4.0 ELSE 2.0 END) / 2) / {FR.c_factor(WALK_PSI)!r}) AS raw FROM events) t""")
def forest_walk(spark, sf):
    """M4 / M5 / FT9: a literal forest scores events beside their own columns."""
    import pandas as pd
    nodes = pd.DataFrame(WALK_NODES, columns=["tree", "node", "feat", "thr", "l", "r", "path"])
    forest = FR.Forest.from_nodes(nodes, WALK_PSI, 0, ["value", "user_id"])
    ev = TD.table(spark, sf, "events").select((F.col("event_id") + 1).alias("id"), "user_id", "value",
                                              F.col("value").alias("f0"), F.col("user_id").cast("double").alias("f1"))
    out = FR.decide(FR.score(ev, forest), WALK_OFFSET)
    return out.select("id", "user_id", F.round("value", 9).alias("value"), F.round("anomaly_score", 9).alias("anomaly_score"),
                      F.col("anomaly").cast("bigint").alias("anomaly"))


@register("forest_trees", f"""
SELECT CAST(range AS BIGINT) AS tree, least({DT.TRAIN_MAX_SAMPLES}, (SELECT count(*) FROM events)) AS n_rows,
       true AS binary, true AS within_depth FROM range({DT.N_TREES})""")
def forest_trees(spark, sf):
    """M1 / M2: rows of each tree's sample, and the shape of the tree grown
    on it (leaves = inner nodes + 1, no path longer than the depth bound)."""
    import math
    frame, _, _ = DT.prepare(access(spark, sf), FT.SCORE_FEATURES)
    n = frame.count()
    sample, psi = FR.sample_trees(frame, n, DT.N_TREES, DT.TRAIN_MAX_SAMPLES, DT.DEFAULT_SEED)
    forest = FR.fit_forest(spark, frame, psi=DT.TRAIN_MAX_SAMPLES, n_rows=n)
    nodes = spark.createDataFrame(forest.nodes_frame(), SC.FOREST_NODES)
    deepest = math.ceil(math.log2(max(psi, 2))) + FR.c_factor(psi)
    shape = nodes.groupBy("tree").agg(
        (F.count_if(F.col("feat") < 0) == F.count_if(F.col("feat") >= 0) + 1).alias("binary"),
        (F.max(F.when(F.col("feat") < 0, F.col("path"))) <= deepest).alias("within_depth"))
    rows = sample.groupBy("tree").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(shape, "tree").select(F.col("tree").cast("bigint").alias("tree"), "n_rows", "binary", "within_depth")


@register("forest_planted", O.with_ctes(O.ACCESS) + """
SELECT id, RemoteAddress, CAST(-1 AS BIGINT) AS anomaly FROM access WHERE id % 50 = 0""")
def forest_planted(spark, sf):
    """M1–M6 with outliers planted in the log (very long URL and token): the
    contamination that is their share flags exactly them, beside the rows'
    own columns."""
    odd = F.col("id") % 50 == 0
    rows = access(spark, sf).withColumn("URL", F.when(odd, F.concat(F.lit("~"), F.repeat(F.lit("z"), 4000))).otherwise(F.col("URL"))) \
        .withColumn("token", F.when(odd, F.concat(F.lit("~"), F.repeat(F.lit("z"), 2000))).otherwise(F.col("token")))
    c = rows.agg(F.count_if(odd).alias("k"), F.count(F.lit(1)).alias("n")).first()
    _, scored = DT.train(spark, rows, features=["lenToken", "lenURL", "Request"], contamination=c["k"] / max(c["n"], 1))
    return FR.anomalies(scored).select("id", "RemoteAddress", F.col("anomaly").cast("bigint").alias("anomaly"))


@register("stream_detect_twin", """SELECT CAST(0 AS BIGINT) AS only_stream, CAST(0 AS BIGINT) AS only_batch, true AS some_flagged""")
def stream_detect_twin(spark, sf):
    """E1 on a stream against the same model in batch: the rows that only one
    of them flags, with the cut on the same batches of lines (S3), and
    whether there are rows that both flag."""
    from rampart.session import shared_dir
    from rampart.sources.files import read_lines
    from rampart.streaming.live import LINE_BATCH, outputs_under, start_file_stream
    model, _ = DT.train(spark, access(spark, sf))
    logs, n = _write_log_files(spark, sf, n_files=5)
    out = shared_dir(spark, "twin-out")
    start_file_stream(spark, logs, out, shared_dir(spark, "twin-ckpt"), model=model, max_files=-(-n // 3))
    cols = ["id", "RemoteAddress", "URL", F.round("anomaly_score", 9).alias("anomaly_score")]
    stream = spark.read.parquet(outputs_under(out).anomalies).select(*cols)
    lines = TD.marker_lines(access(spark, sf))
    good = TH.with_batches(P.normalize(lines), LINE_BATCH)
    batch = TH.adaptive_filter(DT.score(good, model), "anomaly_score", "batch_id").select(*cols)
    sides = stream.withColumn("s", F.lit(1)).unionByName(batch.withColumn("s", F.lit(-1)))
    rows = sides.groupBy(*stream.columns).agg(F.sum("s").alias("more"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    return rows.agg(F.coalesce(F.sum(F.greatest("more", zero)), zero).alias("only_stream"),
                    F.coalesce(F.sum(F.greatest(-F.col("more"), zero)), zero).alias("only_batch"),
                    (F.coalesce(F.sum(F.col("n") - F.abs("more")), zero) > 0).alias("some_flagged"))


# --- files written and read back (SRC6–SRC11, SNK1–SNK9, C8, D10) -------------------

def classified_export(spark, sf):
    """Classified rows with all columns of the classified table."""
    rows = FT.add_lengths(access(spark, sf)).withColumn("anomaly", F.lit(-1)).withColumn("anomaly_score", F.lit(-0.25))
    return C.classify(rows).select(*SC.CLASSIFIED.names)


@register("dashboard_files", O.with_ctes(O.ACCESS, CL_ACCESS, ERR, """
f AS (SELECT * FROM errors WHERE starts_with(RemoteAddress, '10.0.0.'))""") + """
SELECT 'address' AS part, RemoteAddress AS key, count(*) AS count FROM f GROUP BY 2
UNION ALL SELECT 'attack', attack_types, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'critical', CAST(critical_alert AS VARCHAR), count(*) FROM f GROUP BY 2
UNION ALL SELECT 'error total', '', count(*) FROM f
UNION ALL SELECT 'access total', '', count(*) FROM access WHERE starts_with(RemoteAddress, '10.0.0.')""")
def dashboard_files(spark, sf):
    """D10 → D8 / D9: both tables exported as CSV, loaded by the dashboard and
    asked its pages' questions."""
    from rampart import sinks
    from rampart.plans import jobs
    from rampart.session import shared_dir
    err, acc = shared_dir(spark, "err-csv"), shared_dir(spark, "acc-csv")
    rows = classified_export(spark, sf)
    sinks.export_csv(rows.where(F.col("attack_types") != U.NO_ATTACK), err)
    sinks.export_csv(rows.select(*SC.NORMALIZED.names), acc)
    error, acc = jobs.load_dashboard(spark, err, acc)
    pages = jobs.dashboard(error, acc, ip_prefix="10.0.0.")

    def part(name, df, key):
        return df.select(F.lit(name).alias("part"), key.cast("string").alias("key"), F.col(df.columns[-1]).alias("count"))

    flags = D.prefix_filter(error, "10.0.0.").groupBy("critical_alert").agg(F.count(F.lit(1)).alias("count"))
    parts = [part("address", pages["error"]["by_address"], F.col("RemoteAddress")),
             part("attack", pages["error"]["by_attack"], F.col("attack_types")),
             part("critical", flags, F.col("critical_alert")),
             part("error total", pages["error"]["total"], F.lit("")),
             part("access total", pages["access"]["total"], F.lit(""))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("positional_classify", O.with_ctes(O.ACCESS, CL_ACCESS) + """
SELECT id, CASE WHEN id % 4 = 0 THEN 'rejected' ELSE attack_types END AS attack_types,
       CASE WHEN id % 4 <> 0 THEN critical_alert END AS critical_alert FROM classified""")
def positional_classify(spark, sf):
    """SRC8 → C11 / C12 over a CSV whose rows have 4, 8, 16 and 18 fields:
    only the shortest are rejected."""
    from rampart.plans import jobs
    from rampart.session import shared_dir
    path, out = shared_dir(spark, "wide-csv"), shared_dir(spark, "wide-out")
    time = F.date_format("TimeLocal", "yyyy-MM-dd HH:mm:ss")
    fields = [F.col("id").cast("string"), F.col("RemoteAddress"), F.col("RemoteUser"), time, F.col("Request"), F.col("URL"),
              F.col("Version"), F.col("Status"), F.col("BodyBytesSent"), F.lit("-"), F.lit("a"), F.lit("t"),
              F.lit("1"), F.lit("2"), F.lit("-1"), F.lit("-0.5"), F.lit("x"), F.lit("y")]
    m = F.pmod(F.col("id"), F.lit(4))
    lines = access(spark, sf).select(F.when(m == 0, F.concat_ws(",", *fields[:4])).when(m == 1, F.concat_ws(",", *fields[:8]))
                                     .when(m == 2, F.concat_ws(",", *fields[:16])).otherwise(F.concat_ws(",", *fields)).alias("value"))
    lines.write.option("header", False).text(path)
    good, bad = jobs.classify_csv_job(spark, path, out, header=False)
    return C.classify(good).select("id", "attack_types", "critical_alert").unionByName(
        bad.select("id", F.lit("rejected").alias("attack_types"), F.lit(None).cast("boolean").alias("critical_alert")))


@register("csv_round_trip", O.with_ctes(O.ACCESS) + f"SELECT {NORM_COLS_SQL} FROM access")
def csv_round_trip(spark, sf):
    """SRC6 / FT3: the normalized table through its CSV form."""
    from rampart import sinks
    from rampart.session import shared_dir
    from rampart.sources.files import read_normalized_csv
    path = shared_dir(spark, "norm-csv")
    sinks.export_csv(access(spark, sf), path)
    return plain(read_normalized_csv(spark, path).select(*SC.NORMALIZED.names))


@register("block_files", O.with_ctes(O.ACCESS, CL_ACCESS, ERR, BLOCKED_SQL, WL_SQL) + """
SELECT RemoteAddress FROM blocked UNION
SELECT RemoteAddress FROM errors WHERE RemoteAddress NOT IN (SELECT RemoteAddress FROM wl)""")
def block_files(spark, sf):
    """E4 over files: SRC10, SRC11, SRC9 / J1 / J3, SNK6; the block list read back."""
    from rampart import sinks
    from rampart.plans import jobs
    from rampart.session import shared_dir
    from rampart.sources.files import read_blocklist
    lst, wl, cls = (shared_dir(spark, x) for x in ("blocklist", "whitelist", "classified"))
    blocked_list(spark, sf).write.text(lst)
    whitelist_df(spark).write.text(wl)
    sinks.overwrite(error_table(spark, sf), cls)
    jobs.block_job(spark, cls, lst, wl)
    return read_blocklist(spark, lst)


def _write_layouts(rows: DataFrame, layouts: list[list[str]], path: str) -> None:
    """Export row group ``id mod n`` with the columns of layout n, all into one folder."""
    from rampart import sinks
    for i, cols in enumerate(layouts):
        sinks.export_csv(rows.where(F.pmod(F.col("id"), F.lit(len(layouts))) == i).select(*cols), path)


@register("csv_by_name", O.with_ctes(O.ACCESS) + f"""
SELECT {NORM_COLS_SQL} FROM (SELECT * REPLACE (
  CASE WHEN id % 3 <> 2 THEN token END AS token, CASE WHEN id % 3 <> 2 THEN Referer END AS Referer,
  CASE WHEN id % 3 <> 2 THEN RemoteUser END AS RemoteUser) FROM access) t""")
def csv_by_name(spark, sf):
    """SRC6 by header: CSV files with all columns, with reordered and foreign
    ones, and with some missing, in one folder."""
    from rampart.session import shared_dir
    from rampart.sources.files import read_normalized_csv
    path = shared_dir(spark, "named-csv")
    names = SC.NORMALIZED.names
    rows = access(spark, sf).withColumn("Note", F.lit('a "note", quoted'))
    _write_layouts(rows, [names, ["Note", *reversed(names)],
                          [c for c in names[5:] + names[:5] if c not in ("token", "Referer", "RemoteUser")]], path)
    return plain(read_normalized_csv(spark, path).select(*names))


@register("block_files_csv", O.with_ctes(O.ACCESS, CL_ACCESS, ERR, BLOCKED_SQL, WL_SQL) + """
SELECT RemoteAddress FROM blocked UNION
SELECT RemoteAddress FROM errors WHERE RemoteAddress NOT IN (SELECT RemoteAddress FROM wl)""")
def block_files_csv(spark, sf):
    """E4 with SRC9: the classified table as CSV files of several layouts, its
    addresses read by name; the block list read back."""
    from rampart.plans import jobs
    from rampart.session import shared_dir
    from rampart.sources.files import read_blocklist
    lst, wl, cls = (shared_dir(spark, x) for x in ("blocklist", "whitelist", "classified-csv"))
    blocked_list(spark, sf).write.text(lst)
    whitelist_df(spark).write.text(wl)
    rows = classified_export(spark, sf).where(F.col("attack_types") != U.NO_ATTACK)
    _write_layouts(rows, [SC.CLASSIFIED.names, ["id", "URL", "RemoteAddress", "Status"], ["attack_types", "RemoteAddress"]], cls)
    jobs.block_job(spark, cls, lst, wl, csv=True)
    return read_blocklist(spark, lst)


@register("parse_files", O.with_ctes(O.ACCESS) + f"SELECT {NORM_COLS_SQL} FROM access WHERE token IS NOT NULL")
def parse_files(spark, sf):
    """SRC1 → P1–P8 → SNK2 / SNK5: log files through the parser job, its table read back."""
    from rampart.plans import jobs
    from rampart.session import shared_dir
    logs, _ = _write_log_files(spark, sf)
    return plain(jobs.normalize_log(spark, logs, shared_dir(spark, "normalized"), shared_dir(spark, "rejects")))


@register("merge_files_written", O.with_ctes(O.ACCESS) + """
SELECT CAST(row_number() OVER (ORDER BY ts, file_no, id) AS BIGINT) AS id, 'event ' || CAST(id AS VARCHAR) AS event FROM (
  SELECT id, CASE WHEN id % 2 = 1 THEN 1 ELSE 2 END AS file_no, date_trunc('hour', TimeLocal) AS ts FROM access WHERE k >= 5) t""")
def merge_files_written(spark, sf):
    """O1–O3 → SNK10: two logs merged into files, read back in file order."""
    from rampart import sinks
    from rampart.session import shared_dir
    from rampart.sources.files import read_lines
    out = shared_dir(spark, "merged")
    sinks.write_merged_text(M.timed_lines(merge_sources(spark, sf)), out, M.ORDER)
    return read_lines(spark, out, numbered=True).select("id", F.regexp_extract("value", r"(event \d+)$", 1).alias("event"))


@register("reject_files", O.with_ctes(O.ACCESS) + "SELECT id, 'too_few' AS reason FROM access WHERE token IS NULL")
def reject_files(spark, sf):
    """SRC1 → P1–P8 → SNK5: the rejects that the parser job wrote, read back."""
    from rampart.plans import jobs
    from rampart.session import shared_dir
    logs, _ = _write_log_files(spark, sf)
    rejects = shared_dir(spark, "rejects")
    jobs.normalize_log(spark, logs, shared_dir(spark, "normalized"), rejects)
    return spark.read.parquet(rejects).select("id", "reason")


@register("legacy_files", SQL["combined_parse"])
def legacy_files(spark, sf):
    """SRC4 → P11–P19 → SNK7: a combined log in files through the legacy
    converter; a second run leaves its table alone."""
    from rampart.plans import jobs
    from rampart.session import shared_dir
    log, out = shared_dir(spark, "combined"), shared_dir(spark, "legacy")
    lines = TD.combined_lines(spark, sf)
    lines.repartitionByRange(4, "id").sortWithinPartitions("id").select("value").write.text(log)
    jobs.legacy_convert(spark, log, out)
    jobs.legacy_convert(spark, log, out)
    return plain(spark.read.parquet(out).drop("runtime"))


FILE_LINES = 1000             # lines of one file of the whole-file merge

FILES_SQL = O.with_ctes(O.ACCESS) + f"""
SELECT part, {O.ts_text("ts")} AS ts, lines, CAST(row_number() OVER (ORDER BY ts, part) AS BIGINT) AS pos
FROM (SELECT id // {FILE_LINES} AS part, arg_min(date_trunc('hour', TimeLocal), id) FILTER (WHERE k >= 5) AS ts,
             count(*) AS lines FROM access GROUP BY 1) t WHERE ts IS NOT NULL"""


def _write_whole_files(lines: DataFrame, folder: str) -> None:
    """Lines (line_no, value) as files of ``FILE_LINES`` consecutive lines, named by their part."""
    part = F.floor(F.col("line_no") / FILE_LINES)
    dealt = lines.withColumn("part", F.format_string("%012d", part)).repartition("part").sortWithinPartitions("part", "line_no")
    dealt.select("value", "part").write.mode("append").partitionBy("part").text(folder)


def _file_rows(merged: DataFrame) -> DataFrame:
    """part, ts and number of lines of merged files, with their place."""
    rows = merged.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint").alias("part"), "path", "ts",
                         F.regexp_count(F.col("content").cast("string"), F.lit("\n")).cast("bigint").alias("lines"))
    return plain(index_sorted(rows, ["ts", "path"], out="pos", base=1).drop("path"))


@register("merge_whole_files", FILES_SQL)
def merge_whole_files(spark, sf):
    """SRC5 → O1–O3: whole files as records, by the first timestamp in each."""
    from rampart.session import shared_dir
    from rampart.sources.files import read_binary
    folder = shared_dir(spark, "whole-files")
    odd, even = merge_sources(spark, sf)
    _write_whole_files(odd.unionByName(even), folder)
    return _file_rows(M.merge_files([read_binary(spark, folder + "/*/*")]))


@register("merge_files_stream", FILES_SQL)
def merge_files_stream(spark, sf):
    """SRC5 on a stream: files of the log added in two runs of one
    checkpoint, merged as in batch."""
    from rampart.session import shared_dir
    from rampart.streaming.files import merged_files, start_merge_files
    folder, out, ckpt = (shared_dir(spark, x) for x in ("watched-files", "file-records", "files-ckpt"))
    odd, even = merge_sources(spark, sf)
    lines = odd.unionByName(even)
    for i in range(2):
        _write_whole_files(lines.where(F.floor(F.col("line_no") / FILE_LINES) % 2 == i), folder)
        start_merge_files(spark, folder, out, ckpt, available_now=True).awaitTermination()
    return _file_rows(merged_files(spark, out))


def _bucket_stream(spark, sf, count) -> DataFrame:
    """Time buckets of the streamed log: the last state that each bucket was written with."""
    from rampart.session import shared_dir
    from rampart.sinks import write_batch
    logs, n = _write_log_files(spark, sf, shuffled=True)
    out = shared_dir(spark, "buckets")
    lines = spark.readStream.schema("value STRING").option("maxFilesPerTrigger", -(-n // 2)).text(logs)
    rows = count(C.classify(P.normalize(lines.select(F.xxhash64("value").alias("id"), "value"))))
    (rows.writeStream.outputMode("update").option("checkpointLocation", shared_dir(spark, "buckets-ckpt"))
     .foreachBatch(lambda df, i: write_batch(df, out, i)).trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(out)
    last = F.max_by(F.struct(*[c for c in got.columns if c not in ("bucket", "batch_id")]), "batch_id")
    return plain(got.groupBy("bucket").agg(last.alias("v")).select("bucket", "v.*"))


@register("stream_over_time", O.with_ctes(O.ACCESS) + f"""
SELECT {O.ts_text("date_trunc('hour', TimeLocal)")} AS bucket, count(*) AS count FROM access WHERE token IS NOT NULL GROUP BY 1""")
def stream_over_time(spark, sf):
    """V4 on a stream of log files."""
    from rampart.streaming import windows as W
    return _bucket_stream(spark, sf, lambda rows: W.logs_over_time(rows, lateness="3650 days"))


@register("stream_error_vs_access", O.with_ctes(O.ACCESS, CL_ACCESS) + f"""
SELECT {O.ts_text("date_trunc('hour', TimeLocal)")} AS bucket,
       count(*) FILTER (WHERE attack_types = '{U.NO_ATTACK}') AS access,
       count(*) FILTER (WHERE attack_types <> '{U.NO_ATTACK}') AS error
FROM classified WHERE token IS NOT NULL GROUP BY 1""")
def stream_error_vs_access(spark, sf):
    """V6 on a stream of log files, tagged by the classifier."""
    from rampart.streaming import windows as W
    return _bucket_stream(spark, sf, lambda rows: W.error_vs_access(W.access_or_error(rows), lateness="3650 days"))


@register("model_store", O.with_ctes(O.ACCESS) + """
SELECT id, CAST(dense_rank() OVER (ORDER BY URL) - 1 AS BIGINT) AS code FROM access""")
def model_store(spark, sf):
    """SNK8 / SNK9: a dictionary grown in a store from one half of the log,
    then refitted with the other, encodes like one fitted on all of it."""
    from rampart.session import shared_dir
    path = shared_dir(spark, "label-store")
    a = access(spark, sf)
    DT.encode_with_store(spark, a.where(F.col("id") % 2 == 0), ["URL"], path)
    out = DT.encode_with_store(spark, a, ["URL"], path, refit=True)
    return out.select("id", F.col("URL_code").cast("bigint").alias("code"))


@register("attack_map", O.with_ctes(O.ATTACK_URLS) + f"""
SELECT id, concat_ws('', {', '.join(f"CASE WHEN {f} THEN '1' ELSE '0' END" for f in O.flags_sql("url_decode(coalesce(URL, ''))"))}) AS bits
FROM attack_urls""")
def attack_map(spark, sf):
    """The map of attack flags, in class order."""
    rows = C.classify(TD.attack_urls(spark, sf), with_map=True)
    bits = [F.when(F.element_at("attacks", F.lit(n)), "1").otherwise("0") for n in U.ATTACK_NAMES]
    return rows.select("id", F.concat(*bits).alias("bits"))
