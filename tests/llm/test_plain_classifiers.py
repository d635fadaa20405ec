"""op5 and op6 step by step against plain Python versions."""
import math
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from edge_rows import sentence
from rampart.llm import common, langid, quality

M64 = (1 << 64) - 1
TEXTS = ["The cat sat. the the cat", "", None, "ÉÀ ab AB Ab aB\n\n12 ++ --\t", " \n x", "漢字 漢字 漢字!", "a b a b a", sentence(2, 90), "Zz\r\nzz  \n 7"]


def mix(h):
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = ((h ^ (h >> shift)) * mult) & M64
    return h ^ (h >> 31)


def plain_units(text):
    """[(word number, shape number)] of one text."""
    kind_of = lambda c: common.SPACE if ord(c) in common.WHITE else {"L": common.LETTER, "N": common.NUMBER}.get(unicodedata.category(c)[0], common.OTHER)
    runs = []
    for c in text or "":
        if runs and kind_of(c) == runs[-1][0]:
            runs[-1][1].append(c)
        else:
            runs.append((kind_of(c), [c]))
    out, before = [], []
    for kind, chars in runs:
        run = "".join(chars)
        if kind == common.SPACE and "\n" not in run:
            continue
        raw = run.encode()
        h = sum((b + 1) * pow(common._BASE, i, 1 << 64) for i, b in enumerate(raw)) & M64
        h = 7 if kind == common.SPACE else mix(h ^ (len(raw) * int(common.MULT) & M64))
        big = [("A" <= c <= "Z") or 0xC0 <= ord(c) <= 0xDE for c in run]
        case = 0 if not any(big) else 2 if all(big) and len(run) > 1 else 1 if big[0] and sum(big) == 1 else 3
        rep = 0
        if kind == common.LETTER:
            rep = 1 if before[-1:] == [h] else 2 if before[-2:-1] == [h] else 0
            before.append(h)
        sign = (h >> 40) % 64 if kind == common.OTHER else 0
        code = (((kind * 16 + min(len(run), 15)) * 4 + case) * 3 + rep) * 64 + sign
        out.append((h >> 50, (code * int(common.MULT) & M64) >> 54))
    return out


def test_units():
    word, shape, begin = quality.units(pa.array(TEXTS, pa.string()))
    for i, t in enumerate(TEXTS):
        got = list(zip(word[begin[i]:begin[i + 1]].tolist(), shape[begin[i]:begin[i + 1]].tolist()))
        assert got == plain_units(t), t


def plain_sums(texts):
    """kind -> (sums of neighbours' index vectors, counts)."""
    out = {}
    for col, (k, n, seed) in enumerate(quality.KINDS):
        place, sign = quality.index_vectors(n, seed)
        sums, count = np.zeros((n, quality.WIDTH)), np.zeros(n)
        for t in texts:
            seq = [u[col] for u in plain_units(t)]
            for i, a in enumerate(seq):
                count[a] += 1
                for j in range(max(0, i - quality.WINDOW), min(len(seq), i + quality.WINDOW + 1)):
                    if j != i:
                        for p, s in zip(place[seq[j]], sign[seq[j]]):
                            sums[a, p] += s
        out[k] = sums, count
    return out


@pytest.mark.parametrize("piece", [3, 1 << 17])
def test_context_sums(piece, monkeypatch):
    monkeypatch.setattr(quality, "PIECE", piece)
    want = plain_sums(TEXTS)
    word, shape, begin = quality.units(pa.array(TEXTS, pa.string()))
    for (k, n, seed), number in zip(quality.KINDS, (word, shape)):
        assert (quality.context_sums(number, begin, n, seed) == want[k][0]).all()


def test_corpus_tables_cover_all_documents(spark):
    """Unlabelled documents count, whatever partition they are in."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id bigint, text string").repartition(4)
    got, want = quality.corpus_tables(df), plain_sums(TEXTS * 3)
    for k, n, _ in quality.KINDS:
        sums, count = want[k]
        v = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        damp = 1e-3 / (1e-3 + count / count.sum()) if k == "word" else np.ones(n)
        assert np.abs(got[k] - v * damp[:, None]).max() <= quality.GRAIN
    empty = quality.corpus_tables(df.limit(0))
    assert all(not empty[k].any() and len(empty[k]) == n for k, n, _ in quality.KINDS)


def test_network_output():
    rng = np.random.default_rng(0)
    p = [rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]
    x = rng.normal(size=(4, 5))
    for row, z in zip(x, quality.logits(x, p)):
        hidden = [max(0.0, sum(a * w for a, w in zip(row, p[0][:, j])) + p[1][j]) for j in range(3)]
        assert z == pytest.approx(sum(h * w for h, w in zip(hidden, p[2])) + p[3][0])


@pytest.mark.parametrize("n", [2, 4, 5, 9])
def test_decoding(n):
    code = langid.codewords(n)
    assert len({tuple(c) for c in code}) == n
    rng = np.random.default_rng(n)
    f, weight = rng.normal(0, 2, (6, code.shape[1])), rng.uniform(0.1, 1, code.shape[1])
    for row, got in zip(f, langid.decode(f, code, weight)):
        loss = [sum(w * math.log1p(math.exp(-c * v)) for c, v, w in zip(word, row, weight)) for word in code]
        z = [math.exp(min(loss) - x) for x in loss]
        assert got == pytest.approx([x / sum(z) for x in z])
    # a codeword's own signs decode to it, also with one bit flipped
    for i, word in enumerate(code):
        assert langid.decode(word[None] * 4, code, np.ones(len(word))).argmax() == i
        if n > 3:
            flipped = word * 4
            flipped[0] *= -1
            assert langid.decode(flipped[None], code, np.ones(len(word))).argmax() == i


def test_bits_are_learned():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(0, 0.1, (300, 30))).astype(np.float32)
    y = np.arange(300) % 3
    x[np.arange(300), y * 5] += 1
    code = langid.codewords(3)
    model = langid.train_bits(x, y, code)
    p = langid.decode(x.astype(float) @ model["w"] + model["b"], code, model["weight"])
    assert (p.argmax(1) == y).mean() > 0.98 and (model["weight"] > 0.9).all()
