"""op1 and the pipeline's mixture: raking goes on until the weights settle."""
import pytest
from pyspark.sql import functions as F

from rampart.llm import mixing as X


def hot_docs(spark):
    """Cells of one hot source, whose caps bind at a share of 0.8."""
    rows, heads = [], ("", "w | ", "@ ")
    for s in range(4):
        for lang in ("en", "de", "fr"):
            for f, head in enumerate(heads):
                n = 3 + (len(rows) * 7919 + 13) % 97 + (2000 if s == 0 and (lang == "en" or f == 0) else 0) + (300 if lang == "en" else 0)
                rows.append((len(rows), head + "w " * (n - len(head.split())), lang, f"s{s}", 1))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def plain(df, rounds):
    rows = df.withColumn("topic", X.form(F.col("text"))).withColumn("n", X.word_count(F.col("text"))).collect()
    tok = {(r["source"], r["lang"], r["topic"]): float(r["n"]) for r in rows}
    total, goals = 0.8 * sum(tok.values()), []
    for i in range(3):
        own = {}
        for c, n in tok.items():
            own[c[i]] = own.get(c[i], 0) + n
        power = {k: v ** X.TEMPER for k, v in own.items()}
        goals.append({k: v / sum(power.values()) * total for k, v in power.items()})
    m = {c: 0.8 * n for c, n in tok.items()}
    for _ in range(rounds):
        for i in range(3):
            s = {}
            for c, x in m.items():
                s[c[i]] = s.get(c[i], 0) + x
            m = {c: min(tok[c], x * goals[i][c[i]] / s[c[i]]) for c, x in m.items()}
    return {c: m[c] / tok[c] for c in tok}


def test_weights_settle(spark):
    docs = hot_docs(spark)
    want, early = plain(docs, 5000), plain(docs, 8)
    assert max(abs(want[c] - early[c]) for c in want) > 0.01          # eight rounds are not enough here
    got = {(r["source"], r["lang"], r["topic"]): r["rate"] for r in X.mix(docs, share=0.8).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_rounds_on_spark_tables_settle_alike(spark, monkeypatch):
    docs = hot_docs(spark).where("source <> 's0'")
    cells = docs.select("source", "lang", X.form(F.col("text")).alias("topic"), X.word_count(F.col("text")).alias("tokens"))
    total = F.lit(0.5 * cells.agg(F.sum("tokens")).first()[0])
    targets = {d: X.tempered_targets(cells, d, total, X.TEMPER) for d in X.DIMS}
    monkeypatch.setattr(X, "SETTLED", 1e-4)
    a, b = ({tuple(r[d] for d in X.DIMS): r["m"] for r in X.rake(cells, targets, 0.5, local_cells=n).collect()}
            for n in (0, X.LOCAL_CELLS))
    assert a == pytest.approx(b, rel=1e-9)
