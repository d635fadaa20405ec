"""Each stage of the corpus pipeline against a plain version of its rule."""
import numpy as np
import pytest

import corpus_pipeline as CP
from conftest import SF_SMALL
from edge_rows import docs, no_docs, rows  # noqa: F401
from rampart.llm import bpe, langid, mixing, quality
from rampart.llm.common import table
from rampart.session import write_table
from test_jaccard import brute


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    out = [docs]
    for _, f in CP.STAGES:
        out.append(write_table(f(spark, out[-1], SF_SMALL), "test-stage"))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_columns_and_names(stages):
    assert 4 <= len(CP.STAGES) <= 5
    for s in stages[1:-1]:
        assert s.columns == list(CP.COLUMNS)


def test_quality_and_language_stages(spark, stages):
    scored = quality.score(stages[0], table(spark, SF_SMALL, "labels")).collect()
    assert ids(stages[1]) == sorted(r["doc_id"] for r in scored if r["score"] >= 0.7)
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF_SMALL, "labels").collect()}
    kept = set(ids(stages[1]))
    clean = [d for d, q in labels.items() if q == 1]
    assert np.mean([d in kept for d in clean]) > 0.95
    named = langid.identify(stages[1]).collect()
    assert ids(stages[2]) == sorted(r["doc_id"] for r in named if not r["ambiguous"])


def test_dedup_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want = sorted(d for d, _, c, _ in brute(rows, 5, 80, 100) if d == c)
    assert ids(stages[3]) == want


def test_mixture_stage(stages):
    import hashlib
    rows = stages[3].collect()
    form = lambda t: ("table" if " | " in t else "notice" if "icense" in t or "ights reserved" in t else "contact" if "@" in t else "prose")
    cell = {r["doc_id"]: (r["source"] or "", r["lang"] or "", form(r["text"] or "")) for r in rows}
    tokens = {}
    for r in rows:
        tokens[cell[r["doc_id"]]] = tokens.get(cell[r["doc_id"]], 0) + len((r["text"] or "").split())
    total = CP.MIX_SHARE * sum(tokens.values())
    targets = []
    for i in range(3):
        own = {}
        for c, n in tokens.items():
            own[c[i]] = own.get(c[i], 0) + n
        power = {k: v ** mixing.TEMPER for k, v in own.items()}
        targets.append({k: v / sum(power.values()) * total for k, v in power.items()})
    m = {c: n * CP.MIX_SHARE for c, n in tokens.items()}
    for _ in range(mixing.ROUNDS):
        for i in range(3):
            s = {}
            for c, x in m.items():
                s[c[i]] = s.get(c[i], 0) + x
            m = {c: min(tokens[c], x * targets[i][c[i]] / s[c[i]]) if s[c[i]] else 0.0 for c, x in m.items()}
    u = lambda d: int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:8], 16) / 2**32
    want = sorted(d for d, c in cell.items() if tokens[c] and u(d) < m[c] / tokens[c])
    assert ids(stages[4]) == want


def test_encoding_stage(stages):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    got = stages[5].collect()
    assert len(got) == len(texts)
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids


def test_run_on_empty_and_messy_tables(spark, docs, rows, no_docs, tmp_path):
    """Nulls, repeats and clashing columns pass through every stage."""
    for name, df in (("messy", docs), ("none", no_docs)):
        d = str(tmp_path / name)
        df.write.parquet(d + "/documents.parquet")
        table(spark, SF_SMALL, "labels").write.parquet(d + "/labels.parquet")
        now = table(spark, d, "documents")
        for _, f in CP.STAGES:
            now = write_table(f(spark, now, d), "messy-stage")
        assert now.count() <= df.count()
