"""op5 and op6: features against plain Python, held-out accuracy, edge rows."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from edge_rows import docs, no_docs, rows  # noqa: F401
from rampart.llm import langid as L
from rampart.llm import quality as Q
from rampart.llm.common import table


def test_features_equal_plain_counts():
    text = "Été noir, 12 chats!\nÉté"
    (_, x, seen), = L.ngram_features(pa.array([text, None, "12 ++"]))
    assert seen.tolist() == [True, False, False]
    b = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in text.lower().encode())
    want = np.zeros(L.BUCKETS)
    for n in L.ORDERS:
        for i in range(len(b) - n + 1):
            if b[i] == 32 and b[i + n - 1] == 32:
                continue
            h = 0
            for c in b[i:i + n]:
                h = (h * 257 + c + 1) % 2**64
            want[(h + n) * int(L.MULT) % 2**64 >> 51] += 1
    want = np.sqrt(want)
    assert np.allclose(x[0], want / np.linalg.norm(want), atol=1e-6)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 30])
def test_codewords_are_apart(n):
    code = L.codewords(n)
    gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert not gaps or min(gaps) >= (1 if n == 2 else 2)


def test_language_held_out_accuracy(spark):
    docs = table(spark, SF_CHECK, "documents")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where(L.held_out()).collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_rows(spark, docs, rows, no_docs):
    got = L.identify(docs, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or (r["score"] == 0 and r["ambiguous"]))
    per_text = {}
    for r in got:
        per_text.setdefault(r["text"], set()).add((r["lang_pred"], r["score"]))
    assert all(len(v) == 1 for v in per_text.values())
    assert L.identify(no_docs).collect() == []
    unlabelled = L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_units_and_pooling_equal_plain_python():
    texts = ["The THE the cat\ncat cat!! 12", None, "", "Été ÉTÉ ***", "a"]
    word, shape, begin = Q.units(pa.array(texts))
    for i, t in enumerate(texts):                     # a document's units do not depend on its neighbours
        w, s, b = Q.units(pa.array([t], pa.string()))
        assert word[begin[i]:begin[i + 1]].tolist() == w.tolist() and shape[begin[i]:begin[i + 1]].tolist() == s.tolist()
    rng = np.random.default_rng(0)
    model = {"word": rng.normal(size=(Q.WORDS, Q.WIDTH)).astype(np.float32),
             "shape": rng.normal(size=(Q.SHAPES, Q.WIDTH)).astype(np.float32)}
    got = Q.pool(word, shape, begin, model)
    for i in range(len(texts)):
        own = slice(begin[i], begin[i + 1])
        n = begin[i + 1] - begin[i]
        want = np.concatenate([model["word"][word[own]].mean(0), model["shape"][shape[own]].mean(0)]) if n else np.zeros(2 * Q.WIDTH)
        assert np.allclose(got[i, :-1], want, atol=1e-5) and got[i, -1] == pytest.approx(np.log1p(n))


def test_quality_held_out(spark):
    docs, labels = table(spark, SF_CHECK, "documents"), table(spark, SF_CHECK, "labels")
    got = Q.score(docs, labels).join(labels, "doc_id").where(Q.held_out()).collect()
    right = np.mean([r["predicted"] == r["quality"] for r in got])
    kept = np.mean([r["predicted"] for r in got if r["quality"] == 1])
    assert len(got) > 50 and right > 0.95 and kept > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_quality_edge_rows(spark, docs, rows, no_docs):
    rnd = random.Random(1)
    labels = spark.createDataFrame([(i, rnd.randint(0, 1), 0) for i in range(60)] + [(3, 0, None), (None, 1, 0), (5, None, 0), (7, 9, 0)],
                                   "doc_id bigint, quality int, toxic int")
    got = Q.score(docs, labels, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    per_text = {}
    for r in got:
        per_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(v) == 1 for v in per_text.values())
    assert Q.score(no_docs, labels).collect() == []
    assert {r["score"] for r in Q.score(docs, labels.limit(0)).collect()} == {0.5}


def test_temperature_improves_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    m = Q.train_network(x, y)
    z = Q.logits((x - m["mean"]) / m["sd"], m["net"])
    assert Q.log_loss(z / m["heat"], y) <= Q.log_loss(z, y) + 1e-3
