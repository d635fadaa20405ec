"""Token-id files: one concatenated id array with Elias-Fano document boundaries.

A data set is a folder of shards in ascending document order.  A shard is
two files that can be memory-mapped: ``<name>.ids`` (the ids of its documents
one after the other, 2 bytes each where the vocabulary allows, else 4) and
``<name>.idx`` (a header and two Elias-Fano sequences: document boundaries
and document ids).  A sequence of n values below u takes about
2 + log2(u / n) bits a value; sampled select gives any value in place.

Shards are written by Spark tasks under a temporary name and then moved, and
a shard's content depends only on its documents, so a task that runs again
after a lost executor leaves the same files.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampart.llm.bpe import expand, split_contractions
from rampart.llm.common import SPACE, byte_classes, partitions, range_buckets, run_starts, strings, text_chunks, utf8
from rampart.session import shared_dir, write_table

END_ID = 2
MEMO_PIECES = 1 << 19         # encoded pieces a worker remembers between chunks
MAGIC = b"RTOKEF01"
SAMPLE = 512                    # one select sample for so many values
READ_DOCS = 1 << 12           # documents whose boundaries are decoded at once


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# --- Elias-Fano ---------------------------------------------------------------------

class EliasFano:
    """A monotone sequence of non-negative integers in near-minimal space.

    The low ``width`` bits of each value are packed; the high parts are one
    bit vector with a one at (value >> width) + rank.  ``select`` finds the
    i-th one from the nearest sample.
    """

    HEAD = struct.Struct("<QQBxxxxxxxQQQ")      # n, universe, width, bytes of low, high, samples

    def __init__(self, n: int, universe: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.width, self.low, self.high, self.samples = n, universe, width, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n = len(v)
        universe = int(v[-1]) + 1 if n else 0
        width = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, universe, width, low, np.packbits(flags, bitorder="little"),
                   ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        parts = [x.tobytes() for x in (self.low, self.high, self.samples)]
        body = b"".join(p.ljust(-(-len(p) // 8) * 8, b"\0") for p in parts)
        return self.HEAD.pack(self.n, self.universe, self.width, *map(len, parts)) + body

    @classmethod
    def read(cls, buf: np.ndarray, at: int) -> tuple["EliasFano", int]:
        n, universe, width, *sizes = cls.HEAD.unpack(buf[at:at + cls.HEAD.size].tobytes())
        at += cls.HEAD.size
        parts = []
        for s in sizes:
            parts.append(buf[at:at + s])
            at += -(-s // 8) * 8
        return cls(n, universe, width, parts[0], parts[1], parts[2].view(np.uint32)), at

    def _place(self, i: int) -> int:
        """Bit number of the one of value ``i``, from the nearest sample."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        pos = int(self.samples[i // SAMPLE])
        want = i % SAMPLE                       # ones to pass after the sampled one
        byte = pos >> 3
        skip = pos & 7
        while True:
            bits = np.unpackbits(self.high[byte:byte + 256], bitorder="little")
            bits[:skip] = 0
            ones = np.flatnonzero(bits)
            if want < len(ones):
                return byte * 8 + int(ones[want])
            want -= len(ones)
            byte, skip = byte + 256, 0

    def select(self, i: int) -> int:
        """Value ``i`` without decoding the others."""
        return (self._place(i) - i) << self.width | self._low(i)

    def block(self, lo: int, hi: int) -> np.ndarray:
        """Values ``lo`` .. ``hi`` - 1 as int64, decoding no others: select
        finds the first and the last, and the bits between hold the rest."""
        if hi <= lo:
            return np.zeros(0, np.int64)
        first, last = self._place(lo), self._place(hi - 1)
        bits = np.unpackbits(self.high[first >> 3:(last >> 3) + 1], bitorder="little")
        bits[:first & 7] = 0
        ones = np.flatnonzero(bits)[:hi - lo] + (first >> 3) * 8
        high = (ones - np.arange(lo, hi)).astype(np.int64) << self.width
        if not self.width:
            return high
        a, z = lo * self.width, hi * self.width
        low = np.unpackbits(self.low[a >> 3:(z + 7) >> 3], bitorder="little")[a & 7:][:z - a].reshape(hi - lo, self.width)
        return high | low.astype(np.int64) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))

    def _low(self, i: int) -> int:
        if not self.width:
            return 0
        a = i * self.width
        raw = int.from_bytes(self.low[a >> 3:(a + self.width + 7) >> 3].tobytes(), "little")
        return raw >> (a & 7) & ((1 << self.width) - 1)

    def values(self) -> np.ndarray:
        """All values as int64."""
        return self.block(0, self.n)


# --- byte-level pieces ---------------------------------------------------------------

def piece_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start mask of the byte-level pre-tokenizer's pieces.

    Runs of letters, numbers or other signs, each with the one space before
    it; contractions where a lone apostrophe without a space before begins
    one; a white space run gives its last sign to the next piece if that is a
    space, and otherwise splits it off.
    """
    cls = byte_classes(data)
    m = run_starts(cls, off)
    n = len(data)
    doc = np.zeros(n + 1, bool)
    doc[off] = True
    space_before = np.zeros(n, bool)
    space_before[1:] = data[:-1] == 0x20
    space_before &= ~doc[:-1]
    split_contractions(data, off, m, ~space_before)
    # white space runs that text of the same document follows
    run = np.flatnonzero(run_starts(cls, off)[:-1])
    end = np.r_[run[1:], n]
    ws = (cls[run] == SPACE) & (end < n)
    run, end = run[ws], end[ws]
    inner = ~doc[end]
    run, end = run[inner], end[inner]
    last = end - 1
    for _ in range(3):                          # first byte of the run's last code point
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    plain = data[last] == 0x20
    m[end[plain]] = False
    m[last] = True
    return m


class Encoder:
    """Whole texts through the tokenizers library, one call per new distinct piece.

    The library's pre-tokenizer cuts a text into pieces that are encoded one
    by one, so encoding the distinct pieces of a chunk gives the same ids.
    Texts that hold a special token's string go through the library whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [a["content"] for a in json.loads(spec)["added_tokens"]]
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.memo: dict[str, bytes] = {}

    def pieces(self, found: list[str]) -> list[bytes]:
        """Ids of each piece as unsigned 32-bit integers."""
        memo = self.memo
        new = [p for p in found if p not in memo]
        got = ({p: array("I", e.ids).tobytes() for p, e in
                zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False))} if new else {})
        out = [got[p] if p in got else memo[p] for p in found]
        if len(memo) + len(got) > MEMO_PIECES:
            memo.clear()
        if len(got) <= MEMO_PIECES:
            memo.update(got)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each text and after the last)."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        apart = {int(i): np.array(self.tok.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
                 for i in np.flatnonzero(whole)}
        if apart:
            texts = pc.if_else(pa.array(whole), "", texts)
        off, data = utf8(texts)
        starts = np.flatnonzero(piece_starts(data, off)[:-1]) if len(data) else np.zeros(0, np.int64)
        enc = strings(np.r_[starts, len(data)], data).dictionary_encode()
        number = enc.indices.to_numpy(zero_copy_only=False)
        lists = self.pieces(enc.dictionary.to_pylist())
        size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        pool = np.frombuffer(b"".join(lists), np.uint32)
        per = size[number]
        ids = pool[expand((np.cumsum(size) - size)[number], per)]
        at = np.r_[0, np.cumsum(per)][np.searchsorted(starts, off)]
        if apart:
            parts = [apart.get(i, ids[at[i]:at[i + 1]]) for i in range(len(texts))]
            ids, at = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return ids, at


_ENCODERS: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    key = zlib.crc32(spec.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


# --- shard files ----------------------------------------------------------------------

def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that Spark names by URI or plain path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class ShardWriter:
    """Streams one shard's ids to storage; boundaries and ids follow at the end."""

    def __init__(self, folder: str, name: str, width: int):
        self.fs, self.dir = open_fs(folder)
        self.name, self.width = name, width
        self.tmp = f"{self.dir}/_tmp-{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.tmp + ".ids")
        self.n_ids, self.ends, self.doc_ids = 0, [], []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray) -> None:
        self.out.write(np.ascontiguousarray(ids, f"<u{self.width}"))
        self.ends.append(at[1:] - at[0] + self.n_ids)
        self.doc_ids.append(doc_ids)
        self.n_ids += len(ids)

    def close(self) -> dict:
        self.out.close()
        docs = pa.concat_arrays(self.doc_ids)
        given = docs.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        first = int(given[0]) if len(given) else 0
        ends = np.concatenate(self.ends)
        index = (MAGIC + struct.pack("<QQQQq", self.width, len(docs), self.n_ids, docs.null_count, first)
                 + EliasFano.build(np.r_[0, ends]).to_bytes()
                 + EliasFano.build(given.astype(np.uint64) - np.uint64(first % (1 << 64))).to_bytes())
        with self.fs.open_output_stream(self.tmp + ".idx") as f:
            f.write(index)
        for kind in ("ids", "idx"):
            self.fs.move(f"{self.tmp}.{kind}", f"{self.dir}/{self.name}.{kind}")
        return {"name": self.name, "n_docs": len(docs), "n_ids": self.n_ids, "index_bytes": len(index)}


class Shard:
    """Random access to a written shard; local files are memory-mapped."""

    def __init__(self, folder: str, name: str):
        fs, path = open_fs(folder)
        with fs.open_input_file(f"{path}/{name}.idx") as f:
            raw = np.frombuffer(f.read(), np.uint8)
        if raw[:8].tobytes() != MAGIC:
            raise ValueError(f"not a token index: {name}")
        self.width, self.n_docs, self.n_ids, self.nulls, self.first = struct.unpack("<QQQQq", raw[8:48].tobytes())
        self.bounds, at = EliasFano.read(raw, 48)
        self.docs, _ = EliasFano.read(raw, at)
        if isinstance(fs, pafs.LocalFileSystem):
            self.ids = (np.memmap(f"{path}/{name}.ids", f"<u{self.width}", "r", shape=(self.n_ids,))
                        if self.n_ids else np.zeros(0, f"<u{self.width}"))
        else:
            with fs.open_input_file(f"{path}/{name}.ids") as f:
                self.ids = np.frombuffer(f.read(), f"<u{self.width}")

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i):self.bounds.select(i + 1)]

    def doc_ids(self, lo: int = 0, hi: int | None = None) -> list:
        """Ids of the documents ``lo`` .. ``hi`` - 1; null ones come first."""
        hi = self.n_docs if hi is None else hi
        given = self.docs.block(max(lo - self.nulls, 0), max(hi - self.nulls, 0)).view(np.uint64) + np.uint64(self.first % (1 << 64))
        return [None] * (min(hi, self.nulls) - min(lo, self.nulls)) + given.view(np.int64).tolist()


# --- Spark operators -------------------------------------------------------------------

INDEX = "bucket int, name string, n_docs bigint, n_ids bigint, index_bytes bigint"


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int | None = END_ID, text: str = "text",
                 doc_id: str = "doc_id", folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode every whole text into shards of ascending ``doc_id``.

    Returns the folder and its shard table (bucket, name, n_docs, n_ids,
    index_bytes), itself written there as Parquet.  Documents are dealt to
    shards by quantiles of their id and sorted within each shard (equal ids:
    by text); null ids come first, null texts are empty.  An empty table
    writes no shard.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    with open(path or default_path(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    fs, place = open_fs(folder)
    fs.create_dir(place, recursive=True)
    n = partitions(spark)
    dealt, _ = range_buckets(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")),
                             "doc_id", n)
    ordered = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(spec.value)
        width = 2 if max(enc.size, (end_id or 0) + 1) <= 1 << 16 else 4
        writer, now = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"bucket": now, **writer.close()}], schema=pa.schema(
                [("bucket", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                 ("index_bytes", pa.int64())]))

        for b in text_chunks(batches):
            bucket = b.column("bucket").to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if now != bucket[lo]:
                    if writer is not None:
                        yield done()
                    now = int(bucket[lo])
                    writer = ShardWriter(folder, f"shard-{now:08d}", width)
                part = b.slice(int(lo), int(hi - lo))
                ids, at = enc.encode(part.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, at[1:], end_id)
                    at = at + np.arange(len(at))
                writer.add(part.column("doc_id"), ids, at)
        if writer is not None:
            yield done()

    index = write_table(ordered.select("bucket", "doc_id", "text").mapInArrow(run, INDEX), "token-index")
    return folder, index


def read_tokens(folder: str, index: DataFrame) -> DataFrame:
    """Documents of the written shards: doc_id, start (ids of all documents
    before it), n_tokens, and the CRC-32 of its ids as unsigned 32-bit
    little-endian integers, all taken from the files."""
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard, so the running total is over a small table
    base = index.select("bucket", "name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = Shard(folder, row["name"])
                for lo in range(0, s.n_docs, READ_DOCS):
                    hi = min(lo + READ_DOCS, s.n_docs)
                    at = s.bounds.block(lo, hi + 1)
                    crc = [zlib.crc32(s.ids[i:j].astype("<u4")) for i, j in zip(at[:-1], at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.doc_ids(lo, hi), pa.int64()), pa.array(at[:-1] + row["base"], pa.int64()),
                         pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = partitions(index.sparkSession)
    return base.repartition(n, "bucket").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
