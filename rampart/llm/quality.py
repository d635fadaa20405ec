"""Quality scores: random-indexing word vectors and a small calibrated network.

A text is read as a sequence of units: letter runs, number runs, runs of
other signs and line breaks.  A unit counts as a word (a hash of its bytes)
and as a shape (kind, length, letter case, whether it repeats one of the two
letter runs before).  Every word and shape has a sparse random index vector;
its context vector is the sum of its neighbours' index vectors over all
documents, labelled or not: tasks sum over their texts, and the sums merge by
key.  A document is the frequency-damped mean of its units' context vectors,
once for words and once for shapes.  A two-layer network, fitted on a bounded
sample of the labelled documents' vectors, scores it, and a temperature fitted
on rows the network has not seen turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import LETTER, MULT, OTHER, SPACE, block_classes, long_hash, release, slice_hashes, text_chunks, utf8

SAMPLE_DOCS = 6000          # expected labelled training documents
WORDS = 1 << 14             # hashed words
SHAPES = 1 << 10            # hashed shapes
WIDTH = 32                  # length of index and context vectors
SPARSE = 4                  # non-zero entries of an index vector
WINDOW = 2                  # neighbours on each side
HIDDEN = 32
THRESHOLD = 0.7
BLOCK = 1 << 18             # bytes cut into units at once
GATHER = 1 << 14            # units pooled at once
PIECE = 1 << 17             # units whose neighbours are summed at once
GRAIN = 2.0 ** -20          # step of the values in the tables


def units(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, shape number, units before each document) of whole texts.

    The bytes are read in blocks that end where a unit does, so that memory
    beyond the texts and the 4 bytes a unit stays the same whatever a text's
    length; one unit longer than a block is hashed piece by piece.
    """
    off, data = utf8(texts)
    words, shapes = [], []
    count = np.zeros(len(off) - 1, np.int64)
    last = np.zeros(0, np.uint64), np.zeros(0, np.int64)       # the last two letter runs: hash, document
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        got, nxt = block_units(data, off, at, end)
        if nxt == at:                                          # one run fills the block
            got, nxt = long_unit(data, off, at)
        h, kind, size, case, doc = got
        letters = kind == LETTER
        rep = np.zeros(len(h), np.int64)
        every = np.r_[last[0], h[letters]], np.r_[last[1], doc[letters]]
        new = np.flatnonzero(letters)
        for back, mark in ((2, 2), (1, 1)):
            place = np.arange(len(last[0]), len(every[0]))
            ok = place >= back
            p = place[ok]
            same = (every[0][p] == every[0][p - back]) & (every[1][p] == every[1][p - back])
            rep[new[ok][same]] = mark
        last = every[0][-2:], every[1][-2:]
        sign = np.where(kind == OTHER, (h >> np.uint64(40)).astype(np.int64) % 64, 0)
        code = (((kind * 16 + np.minimum(size, 15)) * 4 + case) * 3 + rep) * 64 + sign
        words.append((h >> np.uint64(50)).astype(np.uint16))
        shapes.append((code.astype(np.uint64) * MULT >> np.uint64(54)).astype(np.uint16))
        if len(doc):
            count[doc[0]:doc[-1] + 1] += np.bincount(doc - doc[0])
        at = nxt
    none = np.zeros(0, np.uint16)
    return np.concatenate([none, *words]), np.concatenate([none, *shapes]), np.r_[0, np.cumsum(count)]


def _case(size, big, first):
    """0 no capital, 1 the first letter only, 2 all of several, 3 otherwise."""
    return np.where(big == 0, 0, np.where((big == size) & (size > 1), 2, np.where(first & (big == 1), 1, 3)))


def _capitals(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """A-Z, and the two-byte Latin-1 capitals, of ``data[lo:hi]``."""
    d = data[lo:hi]
    cap = (d >= 0x41) & (d <= 0x5A)
    nxt = data[lo + 1:hi + 1]
    cap[:len(nxt)] |= (d[:len(nxt)] == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E)
    return cap


def block_units(data: np.ndarray, off: np.ndarray, lo: int, hi: int):
    """((hash, kind, characters, case, document) of the units that end in
    ``data[lo:hi]``, place of the run that does not); ``lo`` starts a run."""
    cls = block_classes(data, lo, hi)
    edge = np.ones(hi - lo + 1, bool)
    edge[1:-1] = cls[1:] != cls[:-1]
    inside = off[np.searchsorted(off, lo):np.searchsorted(off, hi, "right")]
    edge[inside - lo] = True
    edge[-1] = hi == len(data)
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    stop = lo + int(at[-1])
    if not len(start):
        return None, stop
    kind = cls[start]
    breaks = np.r_[0, np.cumsum(data[lo:hi] == 0x0A, dtype=np.int32)]
    keep = (kind != SPACE) | (breaks[end] > breaks[start])
    start, end, kind = start[keep], end[keep], kind[keep].astype(np.int64)
    h = slice_hashes(data[lo:hi], start, end)
    h[kind == SPACE] = np.uint64(7)
    cap = _capitals(data, lo, hi)
    lead = np.r_[0, np.cumsum((data[lo:hi] & 0xC0) != 0x80, dtype=np.int32)]
    caps = np.r_[0, np.cumsum(cap, dtype=np.int32)]
    size = (lead[end] - lead[start]).astype(np.int64)
    case = _case(size, caps[end] - caps[start], cap[start])
    return (h, kind, size, case, np.searchsorted(off, start + lo, "right") - 1), stop


def long_unit(data: np.ndarray, off: np.ndarray, lo: int):
    """The one unit that starts at ``lo`` and fills more than a block."""
    kind = int(block_classes(data, lo, lo + 1)[0])
    doc = int(np.searchsorted(off, lo, "right")) - 1
    stop, size, big, broken = lo, 0, 0, False
    while stop < off[doc + 1]:
        hi = min(stop + BLOCK, int(off[doc + 1]))
        other = np.flatnonzero(block_classes(data, stop, hi) != kind)
        cut = stop + int(other[0]) if len(other) else hi
        part = data[stop:cut]
        size += int(np.count_nonzero((part & 0xC0) != 0x80))
        big += int(np.count_nonzero(_capitals(data, stop, cut)))
        broken |= bool((part == 0x0A).any())
        stop = cut
        if len(other):
            break
    one = [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64)]
    if kind != SPACE or broken:
        h = np.uint64(7) if kind == SPACE else long_hash(data[lo:stop], BLOCK)
        case = int(_case(size, big, _capitals(data, lo, lo + 2)[0]))
        one = [np.array([v], a.dtype) for v, a in zip((h, kind, size, case, doc), one)]
    return tuple(one), stop


def index_vectors(n: int, seed: int) -> np.ndarray:
    """(places, signs) of the sparse index vectors, by seed."""
    rng = np.random.default_rng(seed)
    place = np.array([rng.choice(WIDTH, SPARSE, replace=False) for _ in range(n)])
    return place, rng.choice([-1.0, 1.0], (n, SPARSE))


def context_sums(number: np.ndarray, begin: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Sums of the index vectors of the units within ``WINDOW`` of each type's
    units in the same document, as n rows of integers."""
    place, sign = index_vectors(n, seed)
    c = np.zeros(n * WIDTH)
    for lo in range(0, len(number), PIECE):
        part = number[lo:lo + PIECE + WINDOW].astype(np.int64)
        doc = np.searchsorted(begin, np.arange(lo, lo + len(part)), "right")
        for step in range(1, WINDOW + 1):
            left = min(PIECE, len(part) - step)
            if left <= 0:
                continue
            ok = doc[:left] == doc[step:step + left]
            a, b = part[:left][ok], part[step:step + left][ok]
            for own, other in ((a, b), (b, a)):
                for k in range(SPARSE):
                    c += np.bincount(own * WIDTH + place[other, k], weights=sign[other, k], minlength=len(c))
    return c.reshape(n, WIDTH).astype(np.int64)


KINDS = (("word", WORDS, 1), ("shape", SHAPES, 2))


def corpus_tables(docs: DataFrame) -> dict:
    """Damped context vectors of all words and shapes, from the texts of all documents.

    A task sums over its texts and emits a row for each type it met; only the
    merged table, ``WORDS`` + ``SHAPES`` rows at most, reaches the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums = {k: np.zeros((n, WIDTH), np.int64) for k, n, _ in KINDS}
        counts = {k: np.zeros(n, np.int64) for k, n, _ in KINDS}
        for b in text_chunks(batches):
            word, shape, begin = units(b.column("text"))
            for (k, n, seed), number in zip(KINDS, (word, shape)):
                sums[k] += context_sums(number, begin, n, seed)
                counts[k] += np.bincount(number, minlength=n)
        for k, _, _ in KINDS:
            at = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[k][at]),
                 *[pa.array(np.ascontiguousarray(sums[k][at, i])) for i in range(WIDTH)]], names)

    names = ["kind", "number", "n", *[f"v{i}" for i in range(WIDTH)]]
    schema = "kind string, " + ", ".join(f"{c} bigint" for c in names[1:])
    merged = docs.select("text").mapInArrow(run, schema).groupBy("kind", "number").agg(*[F.sum(c).alias(c) for c in names[2:]])
    got = merged.toArrow()
    model = {}
    for k, n, _ in KINDS:
        own = got.filter(pc.equal(got["kind"], k))
        at = own["number"].to_numpy()
        c, count = np.zeros((n, WIDTH)), np.zeros(n)
        c[at] = np.stack([own[f"v{i}"].to_numpy() for i in range(WIDTH)], 1) if len(at) else 0
        count[at] = own["n"].to_numpy()
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        # frequent words say little: a word's weight falls with its share of all units
        damp = 1e-3 / (1e-3 + count / max(count.sum(), 1)) if k == "word" else np.ones(n)
        model[k] = np.round(c * damp[:, None] / GRAIN) * GRAIN
    return model


def pool(word: np.ndarray, shape: np.ndarray, begin: np.ndarray, model: dict) -> np.ndarray:
    """Document vectors: damped means over words and over shapes, and the log length.

    The tables hold multiples of ``GRAIN``, so their sums are exact in any
    order and the units can be taken ``GATHER`` at a time.
    """
    out = np.zeros((len(begin) - 1, 2 * WIDTH + 1))
    size = np.diff(begin)
    full = np.flatnonzero(size > 0)
    out[:, -1] = np.log1p(size)
    starts = begin[full]
    for lo in range(0, len(word), GATHER):
        hi = min(lo + GATHER, len(word))
        i, j = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi)
        at = np.maximum(starts[i:j], lo) - lo
        for number, key, col in ((word, "word", 0), (shape, "shape", WIDTH)):
            out[full[i:j], col:col + WIDTH] += np.add.reduceat(model[key][number[lo:hi]], at, axis=0)
    out[:, :-1] /= np.maximum(size, 1)[:, None]
    return out


def train_network(x: np.ndarray, y: np.ndarray, steps: int = 600, seed: int = 1) -> dict:
    """Two-layer network by Adam on four fifths of the rows; the rest sets the
    temperature and, among the checkpoints passed, the one kept."""
    mean, sd = x.mean(0), x.std(0) + 1e-4
    x = (x - mean) / sd
    rng = np.random.default_rng(seed)
    check = np.arange(len(x)) % 5 == 0
    if check.all() or not check.any() or len(x) < 20:
        check = np.zeros(len(x), bool)
    xt, yt = x[~check], y[~check]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    best, kept = np.inf, [a.copy() for a in p]
    for i in range(1, steps + 1):
        pick = rng.integers(0, len(xt), min(512, len(xt)))
        h = np.maximum(xt[pick] @ p[0] + p[1], 0)
        z = h @ p[2] + p[3]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yt[pick]) / len(pick)
        dh = np.outer(d, p[2]) * (h > 0)
        g = [xt[pick].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
        for j in range(4):
            m[j] = 0.9 * m[j] + 0.1 * g[j]
            v[j] = 0.99 * v[j] + 0.01 * g[j] ** 2
            p[j] = p[j] - 0.01 * (m[j] / (1 - 0.9 ** i)) / (np.sqrt(v[j] / (1 - 0.99 ** i)) + 1e-8)
        if i % 50 == 0:
            now = log_loss(logits(x[check], p), y[check]) if check.any() else -i
            if now < best:
                best, kept = now, [a.copy() for a in p]
    heat = 1.0
    if check.any():
        z = logits(x[check], kept)
        heat = min(np.geomspace(0.25, 8, 61), key=lambda t: log_loss(z / t, y[check]))
    return {"mean": mean, "sd": sd, "net": kept, "heat": float(heat)}


def logits(x: np.ndarray, p: list) -> np.ndarray:
    return np.maximum(x @ p[0] + p[1], 0) @ p[2] + p[3]


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def held_out(doc_id="doc_id"):
    """Rows the model never learns from: crc32 of the id's text is 2 modulo 4."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict | None:
    """Word vectors of all documents, and a network trained on a hash sample
    of the labelled rows that are not held out.

    ``labels`` has doc_id and quality (0 or 1; null rows are left out, of
    several labels of one document the smallest counts).  Returns None if no
    document has a label.
    """
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    n = known.count()
    if n == 0:
        return None
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    # at most about sample_docs rows of two numbers
    chosen = F.broadcast(known.where(u < min(1.0, sample_docs / n)))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")

    tables = corpus_tables(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in text_chunks(batches):
            x = pool(*units(b.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"), pa.array([v.astype("<f8").tobytes() for v in x], pa.binary())],
                ["doc_id", "quality", "x"])

    got = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"),
                      "text").mapInArrow(vectors, "doc_id bigint, quality int, x binary").toArrow()
    shared.unpersist()
    if got.num_rows == 0:
        return None
    got = got.sort_by([("doc_id", "ascending"), ("x", "ascending")])
    y = np.array(got["quality"].to_pylist(), float)
    x = np.stack([np.frombuffer(v.as_py(), "<f8") for v in got["x"]])
    return {**tables, **train_network(x, y)}


def predict(docs: DataFrame, model: dict | None, keep: tuple = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text from the text alone.

    Adds to the columns of ``keep``: score (0 to 1, higher is better) and
    predicted (1 from ``threshold`` on).  A null text counts as empty; an
    empty text is scored from its length alone; when nothing was learned all
    scores are 0.5.  Equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = shared.value
        for b in text_chunks(batches):
            score = np.full(b.num_rows, 0.5)
            if m is not None:
                x = pool(*units(b.column("text")), m)
                # rounded, since a matrix product's last bits depend on its other rows
                z = np.round(logits((x - m["mean"]) / m["sd"], m["net"]) / m["heat"], 8)
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                [*keep, "score", "predicted"])

    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{schema}, score double, predicted int")


def score(docs: DataFrame, labels: DataFrame, keep: tuple = ("doc_id",)) -> DataFrame:
    """Fit on the labelled rows that are not held out and score all rows."""
    return predict(docs, fit(docs, labels), keep)
