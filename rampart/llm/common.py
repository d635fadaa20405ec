"""Helpers shared by the training-data operators.

Text work that Spark's functions cannot state is done on whole Arrow batches:
a batch is cut into chunks of a few megabytes (always whole documents), the
chunk's UTF-8 buffer becomes one NumPy array, and every step is a vector
operation over its bytes.
"""

from __future__ import annotations

import ctypes
import gc
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.session import CORE_CONF, ship_package

CHUNK_BYTES = 4 << 20

# Rows of an id table that may be broadcast (about 32 MB); beyond it the same
# join runs as a shuffle.
BROADCAST_ROWS = 1 << 20

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def prepare(spark: SparkSession) -> None:
    """Session settings and worker imports that the operators rely on."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        spark.conf.set(k, CORE_CONF[k])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows.

    ``df`` must be a written table (its count reads only footers).  Beyond
    the bound the caller's join is a plain shuffle join with the same result.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def range_buckets(df: DataFrame, col: str, n: int, out: str = "bucket") -> tuple[DataFrame, list]:
    """Add ``out``: the number of cut points that are <= ``col``.

    The cuts are approximate quantiles of ``col`` (one scan of that column),
    so that buckets hold about equally many rows and bucket order is ``col``
    order; any cuts give the same results downstream.  Nulls go to bucket 0.
    The search is two steps of about sqrt(n) comparisons.
    """
    probs = [i / n for i in range(1, n)]
    cuts = []
    if probs:
        got = df.select(F.percentile_approx(col, probs, 20 * n).alias("q")).first()["q"]
        cuts = sorted(set(got or []))
    if not cuts:
        return df.withColumn(out, F.lit(0)), []
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.array(*[F.lit(int(c)).cast("bigint") for c in cuts[::step]])
    fine = F.array(*[F.array(*[F.lit(int(c)).cast("bigint") for c in cuts[i:i + step]])
                     for i in range(0, len(cuts), step)])
    x = F.col(col)
    block = F.size(F.filter(coarse, lambda c: c <= x))
    inner = F.size(F.filter(F.element_at(fine, block), lambda c: c <= x))
    bucket = F.when(x.isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * step + inner)
    return df.withColumn(out, bucket.cast("int")), cuts


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a written table whose successor is written; frames on it end here."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# --- worker memory ----------------------------------------------------------------

# What one operator keeps in a reused Python worker: its key and its value.
_HELD: dict = {}


def hold(key, build):
    """``build()`` once a worker for ``key``; what another key left there goes."""
    if _HELD.get("key") != key:
        release()
        _HELD.update(key=key, value=build())
    return _HELD["value"]


def release() -> None:
    """Drop what earlier operators keep in this worker and give free memory back."""
    _HELD.clear()
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):            # not every C library has it
        pass


# --- Arrow chunks ---------------------------------------------------------------

def text_chunks(batches: Iterator[pa.RecordBatch], col: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows holding about ``limit`` bytes of
    ``col``; one longer text is a chunk of its own."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(b.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]):
            yield b.slice(int(lo), int(hi - lo))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of length n + 1 from 0, bytes) of a string array; null is empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    arr = pa.concat_arrays([arr.cast(pa.large_string())]) if arr.offset else arr.cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1 + arr.offset)[arr.offset:]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0]:off[-1]]


def strings(off: np.ndarray, data: np.ndarray) -> pa.Array:
    """String array whose values are the consecutive slices of ``data``."""
    o = np.ascontiguousarray(off, dtype=np.int64)
    return pa.LargeStringArray.from_buffers(len(o) - 1, pa.py_buffer(o), pa.py_buffer(np.ascontiguousarray(data)))


# --- character classes over UTF-8 bytes -------------------------------------------

# White space of the tokenizers' split patterns (Unicode White_Space).
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_CLASSES: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """Class of each code point, built once per process."""
    if not _CLASSES:
        t = np.zeros(0x110000, np.uint8)
        kind = {"L": LETTER, "N": NUMBER}
        for cp in range(0x110000):
            k = kind.get(unicodedata.category(chr(cp))[0])
            if k:
                t[cp] = k
        t[WHITE] = SPACE
        _CLASSES.append(t)
    return _CLASSES[0]


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of every byte's code point (continuation bytes repeat their lead's)."""
    t = class_table()
    cls = t[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        d = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
        b0 = d[lead]
        c1, c2, c3 = (d[lead + i] & 0x3F for i in (1, 2, 3))
        two, three = b0 < 0xE0, b0 < 0xF0
        cp = np.where(two, (b0 & 0x1F) << 6 | c1,
                      np.where(three, (b0 & 0x0F) << 12 | c1 << 6 | c2,
                               (b0 & 0x07) << 18 | c1 << 12 | c2 << 6 | c3))
        k = t[np.minimum(cp, 0x10FFFF)]
        cls[lead] = k
        cls[lead + 1] = k
        cls[lead[~two] + 2] = k[~two]
        cls[lead[~three] + 3] = k[~three]
    return cls


def block_classes(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """``byte_classes`` of ``data[lo:hi]``, which may cut characters."""
    first, last = lo, hi
    while first > 0 and data[first] & 0xC0 == 0x80:
        first -= 1
    while last < len(data) and data[last] & 0xC0 == 0x80:
        last += 1
    return byte_classes(data[first:last])[lo - first:hi - first]


def run_starts(cls: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mask (one longer than ``cls``) of the first bytes of class runs and documents."""
    m = np.ones(len(cls) + 1, bool)
    m[1:-1] = cls[1:] != cls[:-1]
    m[off] = True
    return m


# --- hashing ---------------------------------------------------------------------

MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit (public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: list[np.ndarray] = []
_BASE = 0x5851F42D4C957F2D                   # odd, so invertible modulo 2**64


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def long_hash(data: np.ndarray, block: int) -> np.uint64:
    """The hash ``slice_hashes`` gives the whole of ``data``, block by block."""
    up, _ = powers(block)
    total = 0
    for lo in range(0, len(data), block):
        part = data[lo:lo + block].astype(np.uint64) + np.uint64(1)
        total += int((part * up[:len(part)]).sum()) * pow(_BASE, lo, 1 << 64)
    length = np.array([len(data)], np.uint64)
    return mix64(np.array([total % (1 << 64)], np.uint64) ^ (length * MULT))[0]


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte slice, whatever its place: a polynomial over
    the slice's bytes from prefix sums, mixed with its length."""
    up, down = powers(len(data))
    pre = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=pre[1:])
    h = (pre[end] - pre[start]) * down[start]
    return mix64(h ^ ((end - start).astype(np.uint64) * MULT))
