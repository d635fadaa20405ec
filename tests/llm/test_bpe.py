"""op2: against the tokenizers library, token by token."""
import random

import numpy as np
import pyarrow as pa
import pytest

from edge_rows import docs, no_docs, rows  # noqa: F401
from rampart.llm import bpe as B


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(B.default_path())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_automaton_numbers_words_in_order(tmp_path):
    words = sorted({bytes(random.Random(i).choices(b"abcz", k=1 + i % 6)) for i in range(400)})
    B.write_lexicon(str(tmp_path / "l"), words, [[i] for i in range(len(words))])
    lex = B.Lexicon(str(tmp_path / "l"))
    probe = [w.decode() for w in words] + ["", "abczabcz", "q"]
    assert lex.numbers(pa.array(probe)).tolist() == [*range(len(words)), -1, -1, -1]
    suffixes = {w[i:] for w in words for i in range(len(w) + 1)}
    assert len(lex.final) <= len(suffixes) and len(lex.ids) == len(words)


def test_minimal_automaton_shares_suffixes():
    words = sorted(a + b"ation" for a in (b"n", b"r", b"st", b"form"))
    built = B.build_automaton(words)
    # equal right languages are one state: the end, a-t-i-o-n once, and the beginnings
    assert len(built["final"]) == 11 and built["final"].sum() == 1


def test_encode_and_decode_fuzz(library, tmp_path):
    spec = open(B.default_path()).read()
    bpe = B.WordBPE(spec)
    words = sorted({w.encode() for w in ["the", "it", "st", "é", "a", "ing"]})
    B.write_lexicon(str(tmp_path / "l"), words, [bpe.merge(w) for w in words])
    lex = B.Lexicon(str(tmp_path / "l"))
    rnd = random.Random(5)
    alphabet = "aeiou'sstmdrvl  \n\t.,!?0123éÉßÇñΣςσİıǅ²½Ⅷ漢字한́​\xa0\x1c_-<|>’ﬁ🙂"
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 50))) for _ in range(800)] + ["", None, "'s 're'll'lx <|endoftext|>"]
    ids, at = B.encode_texts(pa.array(texts), bpe, lex, {})
    decoded = B.decode_ids(ids, at, bpe).to_pylist()
    for i, t in enumerate(texts):
        assert (ids[at[i]:at[i + 1]].tolist(), decoded[i]) == expected(library, t), repr(t)


def test_operator_on_messy_rows(docs, rows, library):
    got = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in B.encode(docs, words=16).collect()), key=str)
    assert got == sorted(((r[0], *expected(library, r[1])) for r in rows), key=str)


def test_empty_table(no_docs):
    assert B.digests(B.encode(no_docs)).collect() == []
