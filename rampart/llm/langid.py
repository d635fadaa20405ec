"""Language identification with error-correcting output codes.

Each language has a codeword of +1/-1 bits.  One linear classifier a bit,
over hashed byte n-grams of a text's letters, predicts that bit; decoding
sums each codeword's logistic losses, weighted by how well its bits were
learned, and takes the codeword of least loss.  A small lead over the next
codeword marks the prediction as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import LETTER, MULT, block_classes, release, text_chunks, utf8

UNKNOWN = "und"
SAMPLE_DOCS = 4096          # expected training documents, shared evenly by the languages
BUCKETS = 1 << 13           # hashed n-grams
ORDERS = (1, 2, 3)
ROWS = 128                  # documents whose dense counts are held at once
BLOCK = 1 << 18             # bytes whose n-grams are hashed at once
AMBIGUOUS = 0.2             # a lead in probability below this is ambiguous


def ngram_features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, features, has a letter) for blocks of whole texts.

    Letters are lower-cased, everything else is a blank; a feature is the
    square root of an n-gram's count, scaled to unit length.  Counts are
    gathered over blocks of ``BLOCK`` bytes, so that a text of any length
    takes little more memory than its bytes.
    """
    off, data = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    for lo in range(0, len(off) - 1, ROWS):
        hi = min(lo + ROWS, len(off) - 1)
        x = np.zeros((hi - lo) * BUCKETS)
        seen = np.zeros(hi - lo, bool)
        for at in range(int(off[lo]), int(off[hi]), BLOCK):
            cells, letters = block_ngrams(data, off[lo:hi + 1], at, min(at + BLOCK, int(off[hi])))
            x += np.bincount(cells, minlength=len(x))
            seen[letters] = True
        x = np.sqrt(x, out=x).reshape(hi - lo, BUCKETS)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        yield lo, x.astype(np.float32), seen


def block_ngrams(data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(document * BUCKETS + hash of each n-gram that starts in ``data[lo:hi]``,
    documents with a letter there); an n-gram may end behind the block."""
    end = min(hi + max(ORDERS) - 1, int(off[-1]))
    letter = block_classes(data, lo, end) == LETTER
    b = np.where(letter, data[lo:end], 0x20).astype(np.uint64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(np.clip(off, lo, end)))
    cells = []
    h = np.zeros(len(b), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = max(len(b) - n + 1, 0)
        h = h[:m] * np.uint64(257) + b[n - 1:] + np.uint64(1)
        if n not in ORDERS:
            continue
        own = min(m, hi - lo)
        ok = (doc[:own] == doc[n - 1:n - 1 + own]) & (letter[:own] | letter[n - 1:n - 1 + own])
        cells.append(doc[:own][ok] * BUCKETS + ((h[:own][ok] + np.uint64(n)) * MULT >> np.uint64(64 - 13)).astype(np.int64))
    return np.concatenate(cells), np.unique(doc[:hi - lo][letter[:hi - lo]])


def codewords(n: int) -> np.ndarray:
    """Codewords of ``n`` languages as rows of +1/-1: every distinct split of
    up to five languages, else the best of random codes by least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        k = 2 ** (n - 1) - 1
        cols = [[1 if i == 0 else (1 if (c >> (i - 1)) & 1 else -1) for i in range(n)] for c in range(k)]
        return np.array(cols, float).T
    rng = np.random.default_rng(n)
    best, far = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, 4 * int(np.ceil(np.log2(n))) + 7))
        gap = (m.shape[1] - m @ m.T + 2 * m.shape[1] * np.eye(n)).min()
        if gap > far and (np.abs(m.sum(0)) < n).all():
            best, far = m, gap
    return best


def train_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 80) -> dict:
    """Logistic classifiers of all bits (Adam on the whole sample), and each bit's weight."""
    t = code[y]
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    bias = np.zeros(code.shape[1], np.float32)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        f = x @ w + bias
        g = -t / (1 + np.exp(np.clip(t * f, -30, 30))) / len(x)
        gw = x.T @ g.astype(np.float32) + 1e-6 * w
        bias -= 2.0 * g.sum(0).astype(np.float32)
        m1 = 0.9 * m1 + 0.1 * gw
        m2 = 0.99 * m2 + 0.01 * gw * gw
        w -= 0.3 * (m1 / (1 - 0.9 ** i)) / (np.sqrt(m2 / (1 - 0.99 ** i)) + 1e-8)
    right = (np.sign(x @ w + bias) == t).mean(0)
    return {"w": w, "b": bias, "weight": np.maximum(right - 0.5, 0.01) * 2}


def decode(f: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Probability of each language: softmax of minus its codeword's weighted logistic loss."""
    loss = np.logaddexp(0, -f[:, None, :] * code[None]) @ weight
    z = np.exp(-(loss - loss.min(1, keepdims=True)))
    return z / z.sum(1, keepdims=True)


def held_out(doc_id="doc_id"):
    """Rows the model never learns from: crc32 of the id's text is 1 modulo 3."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def fit(docs: DataFrame, may_learn, sample_docs: int = SAMPLE_DOCS) -> dict | None:
    """Train on a hash sample of the rows where ``may_learn`` holds.

    Each language gives all its rows or, beyond its even share of
    ``sample_docs``, a share chosen by a hash of the id; whole texts count.
    Returns None if there is nothing to learn from.
    """
    rows = docs.where(may_learn & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    share = sample_docs / len(langs)
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, share / counts[k])))]),
                        F.col("lang"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            lang = b.column("lang").to_pylist()
            ids = b.column("doc_id").to_pylist()
            for lo, x, seen in ngram_features(b.column("text")):
                keep = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[lo + i] for i in keep], pa.int64()),
                     pa.array([lang[lo + i] for i in keep], pa.string()),
                     pa.array([np.flatnonzero(x[i]).astype("<u2").tobytes() for i in keep], pa.binary()),
                     pa.array([x[i][x[i] > 0].astype("<f2").tobytes() for i in keep], pa.binary())],
                    ["doc_id", "lang", "at", "value"])

    got = (rows.where(u < rate).select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")
           .mapInArrow(features, "doc_id bigint, lang string, at binary, value binary").toArrow())
    got = got.sort_by([("doc_id", "ascending"), ("at", "ascending")])
    if got.num_rows == 0:
        return None
    x = np.zeros((got.num_rows, BUCKETS), np.float32)
    for i, (at, v) in enumerate(zip(got["at"], got["value"])):
        x[i, np.frombuffer(at.as_py(), "<u2")] = np.frombuffer(v.as_py(), "<f2")
    y = np.searchsorted(langs, got["lang"].to_pylist())
    del got
    code = codewords(len(langs))
    return {"langs": langs, "code": code, **train_bits(x, y, code)}


def predict(docs: DataFrame, model: dict | None, keep: tuple = ("doc_id",)) -> DataFrame:
    """Predict every whole text's language from the text alone.

    Adds to the columns of ``keep``: lang_pred, score (probability of the
    prediction, 0 to 1), lang_next (the runner-up, null if there is none) and
    ambiguous (its lead is below ``AMBIGUOUS``).  A null text, a text
    without a letter, and any text when nothing was learned are ``und`` with
    score 0, ambiguous.  Equal texts get equal predictions; other columns
    play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = shared.value
        for b in text_chunks(batches):
            n = b.num_rows
            lang = np.full(n, UNKNOWN, object)
            then = np.full(n, None, object)
            score, unsure = np.zeros(n), np.ones(n, bool)
            if m is not None:
                names = np.array(m["langs"], object)
                for lo, x, seen in ngram_features(b.column("text")):
                    # rounded, since a matrix product's last bits depend on its other rows
                    f = np.round(x.astype(float) @ m["w"] + m["b"], 8)
                    p = decode(f, m["code"], m["weight"])
                    order = np.argsort(-p, axis=1, kind="stable")
                    rows = np.arange(len(p))
                    at = lo + rows[seen]
                    best = p[rows, order[:, 0]]
                    lang[at] = names[order[seen, 0]]
                    score[at] = best[seen]
                    unsure[at] = False
                    if len(names) > 1:
                        then[at] = names[order[seen, 1]]
                        unsure[at] = (best - p[rows, order[:, 1]])[seen] < AMBIGUOUS
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score),
                 pa.array(then, pa.string()), pa.array(unsure)],
                [*keep, "lang_pred", "score", "lang_next", "ambiguous"])

    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, lang_next string, ambiguous boolean")


def identify(docs: DataFrame, keep: tuple = ("doc_id",)) -> DataFrame:
    """Fit on the rows that are not held out and predict all rows."""
    return predict(docs, fit(docs, ~held_out()), keep)
