import duckdb

import __spark_entry__ as E
from conftest import SF_SMALL
from rampart.sources.testdata import TABLES

FAST = ["busiest_addresses", "parse_log", "reject_counts", "attack_types", "combined_parse",
        "merge_logs", "label_encode", "rate_ban", "overview_top_ips", "contamination_cut"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["RemoteAddress", "count"]


def test_every_query_is_registered_once_with_sql_keys_subset():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 50


def test_fast_queries_match_duckdb_at_small_sf(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    q, s = E.queries(), E.oracle_sql()
    for name in FAST:
        sdf = q[name](spark, SF_SMALL)
        got = sorted(tuple(str(r[c]) for c in sorted(sdf.columns)) for r in sdf.collect())
        cur = con.execute(s[name])
        cols = [d[0] for d in cur.description]
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        want = sorted(tuple(str(r[i]) for i in order) for r in cur.fetchall())
        assert got == want, name
