"""op1 and op4 against DuckDB on the tables; op1, op4 and op9 by hand on edge rows."""
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from edge_rows import docs, no_docs, rows  # noqa: F401
from rampart.llm import licenses as C
from rampart.llm import mixing as X
from rampart.llm import preference as P
from rampart.llm import queries as Q


@pytest.mark.parametrize("name", ["op1_raked_mixture", "op4_preference_pairs", "op8_tiled_topk"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = Q.QUERIES[name](spark, SF_SMALL)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({Q.SQL[name]}) t").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["op1_raked_mixture", "op3_minhash_fingerprints", "op4_preference_pairs", "op9_licence_dice"])
def test_native_queries_run_no_python(spark, name):
    plan = Q.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_mixing_reaches_targets(spark):
    rows = [(i, "w " * (1 + i % 7), ("en", "fr")[i % 2], f"s{i % 3}", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    total = 600.0
    want = {"source": {"s0": .5, "s1": .3, "s2": .2}, "lang": {"en": .7, "fr": .3}, "topic": {"prose": 1.0}}
    targets = {d: spark.createDataFrame([(k, v * total) for k, v in t.items()], f"{d} string, t_{d} double") for d, t in want.items()}
    out = X.mix(docs, targets=targets, share=0.1, keep=("doc_id",))
    for d, t in want.items():
        got = {r[d]: r["m"] for r in out.groupBy(d).agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("m")).collect()}
        assert got == pytest.approx({k: v * total for k, v in t.items()}, rel=1e-3)
    drawn = out.where("sampled").agg(F.sum("n_tokens")).first()[0]
    assert drawn == pytest.approx(total, rel=0.25)


def test_mixing_edge_rows(docs, rows, no_docs):
    got = X.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["rate"] <= 1 for r in got)
    assert sorted(r["n_tokens"] for r in got) == sorted(len((r[1] or "").split()) for r in rows)
    same = {}
    for r in got:
        same.setdefault((r["doc_id"], r["n_tokens"], r["source"], r["lang"], r["topic"]), set()).add(r["sampled"])
    assert all(len(v) == 1 for v in same.values())
    assert X.mix(no_docs).collect() == []


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b))


def test_licence_size_bounds_lose_nothing():
    for n in range(1, 60):
        low, high = C.bounds(n, *C.DICE)
        for m in range(1, 120):
            reach = 2 * min(n, m) / (n + m) >= C.DICE[0] / C.DICE[1]
            assert not reach or low <= m <= high


def test_licence_edge_rows(spark, docs, rows, no_docs):
    texts = ["Released under the MIT License.", "x\nLICENSED under   CC BY-NC 4.0!\nAll rights reserved.", "all rights", "",
             None, "\n\n", "All rights reserved.\n" * 3, "released under the terms of the mit license by somebody else entirely",
             C.TEMPLATES["GPL-3.0"][1], "license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("_found", F.lit(1)).withColumn("line", F.lit(2))
    got = {r["doc_id"]: r for r in C.scan(df).collect()}
    sets = C.template_sets()
    import re
    for i, t in enumerate(texts):
        found = []
        for k, line in enumerate((t or "").split("\n"), 1):
            w = re.sub("[^a-z0-9]+", " ", line.lower()).split()
            b = {f"{x} {y}" for x, y in zip(w, w[1:])} or set(w)
            hits = sorted((-dice(b, set(s)), k, n) for n, s in sets if b and dice(b, set(s)) >= 0.8)
            found += hits[:1]
        best = min(found) if found else None
        r = got[i]
        assert (r["n_notices"], r["license"], r["line"]) == (len(found), best and best[2], best and best[1])
        assert r["dice"] == pytest.approx(-best[0] if best else 0.0)
    assert C.scan(docs).count() == len(rows) and C.scan(no_docs).collect() == []


def test_preference_pairs_by_hand(spark):
    def conv(*turns):
        return [{"role": r, "text": t} for r, t in turns]

    a = conv(("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "good"))
    rows = [(1, a, conv(("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "bad é"))), (2, a, a), (3, a, a[:2]),
            (4, conv(("user", "x")), None), (5, [], []), (6, conv(("assistant", "")), conv(("user", ""), ("assistant", "z")))]
    df = spark.createDataFrame(rows, "pair_id bigint, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r["pair_id"]: r for r in P.format_pairs(df).collect()}
    assert got[1]["n_prefix"] == 3 and got[1]["prompt"].count(P.START) == 3
    for side, say in (("chosen", "good"), ("rejected", "bad é")):
        (span,) = got[1][f"{side}_mask"]
        assert got[1][side][span["start"]:span["end"]] == say + P.END
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["chosen_mask"] == []
    assert got[3]["rejected"] == "" and got[3]["n_prefix"] == 2 and len(got[3]["chosen_mask"]) == 1
    assert got[4]["n_prefix"] == 0 and got[4]["rejected"] == "" and got[4]["chosen_mask"] == []
    assert got[5]["prompt"] == "" and got[6]["chosen_mask"][0]["end"] - got[6]["chosen_mask"][0]["start"] == len(P.END)
    assert P.format_pairs(df.limit(0)).collect() == []


def test_conversations_with_nulls_and_ties(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, "system", None), (2, 0, None, "q"), (2, 0, "assistant", "r"),
            (None, 0, "assistant", "x"), (3, 0, "user", "only"), (4, 0, "assistant", "b"), (4, 0, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in P.turns(df).collect()}
    assert got == {1: [("system", ""), ("user", "a"), ("assistant", "b")], 2: [("", "q"), ("assistant", "r")],
                   3: [("user", "only")], 4: [("assistant", "b")] * 2}
    pairs = {r["pair_id"]: r["rejected"][-1]["text"] for r in P.crossed_replies(df).collect()}
    assert pairs == {1: "r", 2: "b", 4: "b"}
    assert P.crossed_replies(df.limit(0)).collect() == []
    assert math.isfinite(len(P.START))


def test_sides_part_at_any_reply_and_keep_later_turns(spark):
    rows = [(c, i, "assistant" if i % 2 else "user", f"{c}:{i}") for c, n in ((5, 7), (6, 6), (7, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["pair_id"]: [t["text"] for t in r["rejected"]] for r in P.crossed_replies(df).collect()}
    assert got == {5: ["5:0", "5:1", "5:2", "5:3", "5:4", "6:5", "5:6"], 6: ["6:0", "7:1", "6:2", "7:1", "6:4", "7:1"],
                   7: ["7:0", "5:1", "7:2"]}
    done = {r["pair_id"]: r for r in P.format_pairs(P.crossed_replies(df)).collect()}
    assert {i: r["n_prefix"] for i, r in done.items()} == {5: 5, 6: 1, 7: 1}
    assert [done[6]["rejected"][m["start"]:m["end"]] for m in done[6]["rejected_mask"]] == ["7:1" + P.END] * 3
