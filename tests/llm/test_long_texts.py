"""Very long texts and words: results do not depend on the block size, memory and time stay bounded."""
import random
import subprocess
import sys
import time

import numpy as np
import pyarrow as pa
import pytest

from rampart.llm import bpe, langid, quality
from rampart.llm.common import long_hash, slice_hashes
from tests.llm.edge_rows import sentence

TEXTS = ["", " \n ", "a" * 900, "é" * 700 + "x", "Ab Ab ab AB ÉÀ\n\n12 ++ 12", None, "漢字" * 300, "zz zz zz", "\n" * 500, " " * 400,
         sentence(3, 800), "x"]


@pytest.mark.parametrize("block", [64, 97, 1000])
def test_blocks_change_nothing(block, monkeypatch):
    texts = pa.array(TEXTS, pa.string())
    words, grams = quality.units(texts), [(lo, x.copy(), seen) for lo, x, seen in langid.ngram_features(texts)]
    monkeypatch.setattr(quality, "BLOCK", block)
    monkeypatch.setattr(langid, "BLOCK", block)
    assert all((a == b).all() for a, b in zip(words, quality.units(texts)))
    for a, b in zip(grams, langid.ngram_features(texts)):
        assert a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all()


def test_ngram_counts_equal_plain_python():
    for i, t in enumerate(TEXTS):
        (_, x, seen), = langid.ngram_features(pa.array([t], pa.string()))
        t = (t or "").lower()
        blank = np.array([not c.isalpha() for c in t for _ in c.encode()], bool)
        n = sum(1 for k in langid.ORDERS for j in range(len(blank) - k + 1) if not (blank[j] and blank[j + k - 1]))
        assert seen[0] == any(c.isalpha() for c in t)
        # squared and rescaled, the features are the counts of the n-grams
        got = x[0].astype(float) ** 2
        if n:
            assert abs(got.sum() - 1) < 1e-3
            assert np.allclose(got * n, np.round(got * n), atol=n * 1e-4 + 1e-3)


def test_pieces_of_a_pool_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    model = {k: np.round(rng.normal(size=(n, quality.WIDTH)) / quality.GRAIN) * quality.GRAIN
             for k, n in (("word", quality.WORDS), ("shape", quality.SHAPES))}
    word, shape, begin = quality.units(pa.array(TEXTS, pa.string()))
    whole = quality.pool(word, shape, begin, model)
    monkeypatch.setattr(quality, "GATHER", 7)
    assert (quality.pool(word, shape, begin, model) == whole).all()
    for i in range(len(TEXTS)):
        w = word[begin[i]:begin[i + 1]]
        if len(w):
            assert np.allclose(whole[i, :quality.WIDTH], np.mean([model["word"][j] for j in w], axis=0))


def test_long_hash_equals_slice_hash():
    data = np.frombuffer(random.Random(2).randbytes(5000), np.uint8)
    assert long_hash(data, 64) == slice_hashes(data, np.array([0]), np.array([5000]))[0]


def test_64_mb_text_in_one_worker():
    code = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np, pyarrow as pa
from rampart.llm import langid, quality
text = pa.array([("Lorem ipsum dolor sit amet été 12\\n" * (2 << 20))[:64 << 20]], pa.string())
model = {{k: np.zeros((n, quality.WIDTH)) for k, n in (("word", quality.WORDS), ("shape", quality.SHAPES))}}
quality.pool(*quality.units(text), model)
list(langid.ngram_features(text))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    root = __file__.rsplit("/tests/", 1)[0]
    got = subprocess.run([sys.executable, "-c", code.format(root=root)], capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) < 1 << 20                 # kB, the interpreter and its libraries included


def test_long_words_merge_as_the_library_does():
    from tokenizers import Tokenizer
    own = bpe.WordBPE(open(bpe.default_path(), encoding="utf-8").read())
    library = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(4)
    for n, letters in ((63, "ab"), (64, "ab"), (300, "acgt"), (20_000, "acgt"), (20_000, "abcdefghijklm"), (3000, "aé"), (4000, "a")):
        word = "".join(rng.choice(letters) for _ in range(n))
        assert own.merge(word.encode()) == library.encode(word, add_special_tokens=False).ids
    for _ in range(500):
        word = "".join(rng.choice("abcdeénot") for _ in range(rng.randint(1, 60)))
        parts = [own.symbols[b] for b in word.encode()]
        parts[-1] += own.suffix
        assert [own.vocab[p] for p in own.merge_long(parts)] == own.merge(word.encode())
    t0 = time.perf_counter()
    own.merge("".join(rng.choice("acgt") for _ in range(200_000)).encode())
    assert time.perf_counter() - t0 < 30
