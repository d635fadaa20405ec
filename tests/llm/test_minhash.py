"""op3: estimates against true Jaccard, the edited text by hand."""
import hashlib
import random
import re

import pytest

from edge_rows import docs, no_docs, rows  # noqa: F401
from rampart.llm import minhash as M


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_messy_rows(spark, docs, rows):
    got = M.edited_fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = {}
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[:len(t) - h] + nxt[:h]
        want.setdefault((r[0], len(t), hashlib.sha256(e.encode()).hexdigest()), []).append((jaccard(t, e), jaccard(t, nxt)))
    assert len(got) == len(rows)
    for r in got:
        pairs = want[(r["doc_id"], r["n_chars"], r["edited_sha256"])]
        assert any(abs(r["near_edited"] - a) < 0.2 and abs(r["near_next"] - b) < 0.2 for a, b in pairs)
    by_text = {}
    for r, text in [(r, {x[0]: x[1] for x in rows}.get(r["doc_id"])) for r in got if r["doc_id"] is not None]:
        by_text.setdefault(text or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[""] == {""}


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8, 0.95])
def test_estimates_follow_similarity(spark, share):
    from pyspark.sql import functions as F
    rnd = random.Random(int(share * 100))
    pairs = []
    for i in range(60):
        a = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([15, 60, 400]))]
        cut = max(1, int(len(a) * share))
        pairs.append((" ".join(a), " ".join(a[:cut] + [f"v{rnd.randrange(10**6)}" for _ in a[cut:]])))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("e", M.likeness(M.signature(F.col("a")), M.signature(F.col("b"))))
    errors = [r["e"] - jaccard(r["a"], r["b"]) for r in df.collect()]
    assert abs(sum(errors) / len(errors)) < 0.04 and max(map(abs, errors)) < 0.2


def test_single_document_and_empty_table(spark, no_docs):
    one = spark.createDataFrame([(7, "alpha beta gamma delta")], "doc_id bigint, text string")
    r = M.edited_fingerprints(one).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"alpha beta alpha beta ").hexdigest()[:64] or r["n_chars"] == 22
    assert M.edited_fingerprints(no_docs).collect() == []
