"""op10: Elias-Fano round trips, and files against the tokenizers library."""
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edge_rows import docs, no_docs, rows  # noqa: F401
from rampart.llm import tokenstore as T


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 10**9), max_size=1500))
def test_elias_fano_round_trip(values):
    v = sorted(values)
    e, _ = T.EliasFano.read(np.frombuffer(T.EliasFano.build(np.array(v, np.int64)).to_bytes(), np.uint8), 0)
    assert e.values().tolist() == v
    for i in range(0, len(v), 37):
        assert e.select(i) == v[i]
    for lo, hi in ((0, 0), (0, 1), (5, 40), (len(v) // 3, len(v)), (len(v) - 1, len(v))):
        lo, hi = max(min(lo, len(v)), 0), min(hi, len(v))
        assert e.block(lo, hi).tolist() == v[lo:hi]
    with pytest.raises(IndexError):
        e.select(len(v))


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(0).integers(0, 2000, 50_000))
    size = len(T.EliasFano.build(v).to_bytes())
    assert size * 8 < len(v) * (2 + np.ceil(np.log2(v[-1] / len(v))) + 0.2)


def test_files_are_read_in_blocks(spark, docs, rows, monkeypatch):
    folder, index = T.write_tokens(docs)
    whole = sorted(map(str, T.read_tokens(folder, index).collect()))
    monkeypatch.setattr(T, "READ_DOCS", 3)
    assert sorted(map(str, T.read_tokens(folder, index).collect())) == whole and len(whole) == len(rows)


def check(spark, docs, rows):
    enc = T.Encoder(open(T.default_path()).read()).tok
    folder, index = T.write_tokens(docs)
    got = sorted(T.read_tokens(folder, index).collect(), key=lambda r: r["start"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    assert len(got) == len(order)
    for r, row in zip(got, order):
        ids = np.array(enc.encode(row[1] or "", add_special_tokens=False).ids + [T.END_ID], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (row[0], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return folder, index


def test_files_of_messy_rows(spark, docs, rows):
    folder, index = check(spark, docs, rows)
    # random access into a shard
    name = index.orderBy("bucket").first()["name"]
    s = T.Shard(folder, name)
    at = s.bounds.values()
    assert all(s[i].tolist() == s.ids[at[i]:at[i + 1]].tolist() for i in range(s.n_docs))


def test_sparse_and_negative_ids(spark):
    rows = [(i, f"word {i} <|endoftext|>  two\n\n x", "en", "s", 1) for i in (-5, 0, 3, 2**62, -2**62, 77)]
    check(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), rows)


def test_empty_table(no_docs):
    folder, index = T.write_tokens(no_docs)
    assert T.read_tokens(folder, index).collect() == []
