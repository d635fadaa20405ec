"""DuckDB SQL building blocks for the correctness oracles.

The oracles compute expected results straight from the driver tables with
DuckDB's own functions; they share only the fixed data values (fragments,
zones, attack patterns) with the Spark side, never the parsing logic.
"""

from __future__ import annotations

from rampart.functions.urls import ATTACK_NAMES, ATTACK_PATTERNS, NO_ATTACK
from rampart.sources import testdata as TD


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def pick(values: list, n_sql: str) -> str:
    """``values[n mod len]`` as a SQL CASE."""
    arms = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values))
    return f"(CASE ({n_sql}) % {len(values)} {arms} END)"


def ts_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


ACCESS = f"""
access AS (
  SELECT event_id + 1 AS id,
         '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS RemoteAddress,
         '-' AS RemoteUser,
         date_trunc('second', ts) AS TimeLocal,
         upper(event_type) AS Request,
         '/' || event_type || '?k=' || CAST(k AS VARCHAR) || {pick(TD.ACCESS_SUFFIXES, 'k')} AS URL,
         'HTTP/1.1' AS Version,
         CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS Status,
         CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS BodyBytesSent,
         {q(TD.REFERER)} AS Referer,
         {q(TD.AGENT)} AS UserAgent,
         CASE WHEN k >= 5 THEN repeat('t', k) END AS token,
         k, event_type, user_id, value, ts
  FROM (SELECT *, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS k FROM events) e
)"""

ATTACK_URLS = f"""
attack_urls AS (
  SELECT page_id AS id,
         regexp_replace(url, '^[a-z]+://[^/]+', '') || {pick(TD.ATTACK_SUFFIXES, 'page_id')} AS URL,
         {pick(TD.STATUSES, 'page_id')} AS Status
  FROM pages
)"""


def flags_sql(decoded: str) -> list[str]:
    return [f"regexp_matches({decoded}, {q('(?i)' + p)})" for _, p in ATTACK_PATTERNS]


def attack_types_sql(decoded: str) -> str:
    parts = ", ".join(f"CASE WHEN {f} THEN {q(n)} END" for n, f in zip(ATTACK_NAMES, flags_sql(decoded)))
    return f"coalesce(nullif(concat_ws(', ', {parts}), ''), {q(NO_ATTACK)})"


def critical_sql(decoded: str, status: str) -> str:
    anyhit = " OR ".join(flags_sql(decoded))
    return f"(({anyhit}) AND starts_with(coalesce({status}, ''), '2'))"


def classified_cte(src: str, name: str = "classified") -> str:
    """``src`` plus attack_types / critical_alert, decoding with url_decode."""
    d = "url_decode(coalesce(URL, ''))"
    return f"""
{name} AS (
  SELECT *, {attack_types_sql(d)} AS attack_types, {critical_sql(d, 'Status')} AS critical_alert
  FROM {src}
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
