"""Vector code compression: product codebooks trained by Ball k-means.

A vector of integer components is cut into equal parts; every part position
has a small codebook, and a part is stored as the index of its nearest
entry.  An entry and the parts assigned to it form a ball whose radius is the
distance of its farthest part.  Three facts, all tested in exact integers,
spare most distances:

* only entries nearer to the ball's centre than twice its radius can take a
  part from it: these are its neighbours;
* a part nearer to its entry than half the way to the nearest neighbour stays
  (the ball's stable core), as does every part of a ball that has not moved
  among neighbours that have not;
* any other part lies in a ring between half the ways to two successive
  neighbours and is compared only with the neighbours inside that ring.

Each round is one pass in Spark: tasks assign parts, write the new
assignment and the partial sums, counts and radii of their balls, and the
sums merge by key.  The driver holds the codebooks only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import bounded_broadcast, drop_folder, prepare
from rampart.llm.vectors import batches_of, finite, integer_code, matrix
from rampart.session import shared_dir, write_table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LIMIT = 1 << 24             # components are held within it, so that distances fit 64 bits
BATCH = 8192                # vectors worked on at once

SUMS = "part int, entry int, n bigint, radius bigint, total array<bigint>"


class Balls:
    """The codebook of one part position with its balls' neighbours.

    ``entries`` are integer rows.  ``radius2`` holds, for each entry, the
    greatest squared distance of its parts before its last move and ``shift2``
    the squared length of that move; without them (the first round) every
    other entry is a neighbour.
    """

    def __init__(self, entries: np.ndarray, radius2: list | None = None, shift2: list | None = None):
        self.entries = entries
        gap = ((entries[:, None, :] - entries[None]) ** 2).sum(-1)
        self.near: list[np.ndarray] = []
        self.ways: list[np.ndarray] = []
        for e in range(len(entries)):
            order = np.lexsort((np.arange(len(entries)), gap[e]))
            order = order[order != e]
            if radius2 is not None:
                # rounding up both lengths can only add neighbours
                reach = 2 * (_root(radius2[e]) + _root(shift2[e]))
                order = order[np.array([int(g) <= reach * reach for g in gap[e, order]], bool)]
            self.near.append(order)
            self.ways.append(gap[e, order])
        moved = np.array([shift2 is None or shift2[e] > 0 for e in range(len(entries))], bool)
        self.still = [not moved[e] and not moved[self.near[e]].any() for e in range(len(entries))]

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance to it) of the parts ``x``, which
        belong to the balls ``own``; ties go to the smaller index."""
        best = own.astype(np.int64)
        dist = ((x - self.entries[best]) ** 2).sum(1)
        for e in np.unique(own):
            if self.still[e] or not len(self.near[e]):
                continue
            member = np.flatnonzero(own == e)
            # the entry at way w can be as near as this one only if w <= (2 d)**2
            ring = np.searchsorted(self.ways[e], 4 * dist[member], "right")
            for j in range(int(ring.max(initial=0))):
                at = member[ring > j]
                other = int(self.near[e][j])
                d = ((x[at] - self.entries[other]) ** 2).sum(1)
                better = (d < dist[at]) | ((d == dist[at]) & (other < best[at]))
                best[at[better]] = other
                dist[at[better]] = d[better]
        return best, dist


def _root(v: int) -> int:
    """Square root of an integer, rounded up."""
    return math.isqrt(v - 1) + 1 if v > 0 else 0


def kept_vectors(vectors: DataFrame, parts: int, vec_id: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """((vec_id, label, code), length): integer vectors of the length of the
    smallest vec_id's whose length is a positive multiple of ``parts``."""
    v = F.col(vector)
    fit = finite(v) & (F.size(v) > 0) & (F.size(v) % parts == 0)
    rows = write_table(vectors.where(fit).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"),
                                                 integer_code(v, SCALE, LIMIT).alias("code")), "codes")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "code").select(F.size("code").alias("n")).first()
    return rows, 0 if first is None else first["n"]


def assign_round(state: DataFrame, books: list[Balls], first: bool, final: bool) -> str:
    """One pass: folder with the new ``state`` and the balls' partial ``sums``."""
    parts = len(books)
    schema = f"{state_schema(state)}, {SUMS}, kind string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books[0].entries.shape[1]
        entries = len(books[0].entries)
        n = np.zeros((parts, entries), np.int64)
        radius = np.full((parts, entries), -1, np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        label = pa.null()
        for t in batches_of(batches, BATCH):
            label = t.column("label").type
            x = matrix(t.column("code"), parts * width)
            before = (np.zeros((len(x), parts), np.uint8) if first else
                      np.frombuffer(b"".join(t.column("own").to_pylist()), np.uint8).reshape(len(x), parts))
            own = np.empty((len(x), parts), np.uint8)
            error = np.zeros(len(x), np.int64)
            for p, ball in enumerate(books):
                part = x[:, p * width:(p + 1) * width]
                best, dist = ball.assign(part, before[:, p])
                own[:, p] = best
                error += dist
                n[p] += np.bincount(best, minlength=entries)
                np.maximum.at(radius[p], best, dist)
                for e in np.unique(best):
                    total[p, e] += part[best == e].sum(0)
            raw = own.tobytes()
            cols = {"vec_id": t.column("vec_id"), "label": t.column("label"), "code": t.column("code"),
                    "own": pa.array([raw[i * parts:(i + 1) * parts] for i in range(len(x))], pa.binary()),
                    "error": pa.array(error), "kind": pa.array(["state"] * len(x))}
            yield _batch(cols, len(x), label)
        at = np.argwhere(n > 0)
        if len(at) and not final:
            cols = {"part": pa.array(at[:, 0], pa.int32()), "entry": pa.array(at[:, 1], pa.int32()),
                    "n": pa.array(n[n > 0]), "radius": pa.array(radius[n > 0]),
                    "total": pa.array([total[p, e].tolist() for p, e in at], pa.list_(pa.int64())),
                    "kind": pa.array(["sums"] * len(at))}
            yield _batch(cols, len(at), label)

    path = shared_dir(state.sparkSession, "balls")
    state.mapInArrow(run, schema).write.partitionBy("kind").parquet(path)
    return path


# Columns of a pass's output besides the label.
_TYPES = {"vec_id": pa.int64(), "label": None, "code": pa.list_(pa.int64()), "own": pa.binary(), "error": pa.int64(),
          "part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "radius": pa.int64(), "total": pa.list_(pa.int64()),
          "kind": pa.string()}


def _batch(cols: dict, n: int, label: pa.DataType) -> pa.RecordBatch:
    types = {**_TYPES, "label": label}
    return pa.RecordBatch.from_arrays([cols[c].cast(t) if c in cols else pa.nulls(n, t) for c, t in types.items()], list(types))


def state_schema(state: DataFrame) -> str:
    return f"vec_id bigint, label {state.schema['label'].dataType.simpleString()}, code array<bigint>, own binary, error bigint"


def read_kind(spark, path: str, kind: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/kind={kind}")


def merged_sums(sums: DataFrame) -> dict:
    """(part, entry) -> (count, radius, component sums); at most parts * entries keys."""
    one = sums.select("part", "entry", "n", "radius", F.posexplode("total").alias("i", "s"))
    got = one.groupBy("part", "entry", "i").agg(
        F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict = {}
    for r in got.orderBy("part", "entry", "i").collect():
        out.setdefault((r["part"], r["entry"]), (r["n"], r["radius"], []))[2].append(int(r["s"]))
    return out


def train(state: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list, DataFrame]:
    """(codebooks, final state) of integer vectors of one length, at least one."""
    spark = state.sparkSession
    width = length // parts
    seeds = np.array([r["code"] for r in state.where(F.col("vec_id").isNotNull()).orderBy("vec_id", "code")
                      .select("code").limit(entries).collect()], np.int64).reshape(-1, length)
    if not len(seeds):                          # nothing but rows without an id
        seeds = np.array([r["code"] for r in state.orderBy("code").select("code").limit(1).collect()], np.int64)
    books = [Balls(seeds[:, p * width:(p + 1) * width].copy()) for p in range(parts)]
    schema = state_schema(state)
    last = None
    for r in range(rounds + 1):
        path = assign_round(state, books, first=r == 0, final=r == rounds)
        state = read_kind(spark, path, "state", schema)
        if last:
            drop_folder(spark, last)
        last = path
        if r == rounds:
            break
        sums = merged_sums(read_kind(spark, path, "sums", SUMS))
        fresh = []
        for p, ball in enumerate(books):
            now = ball.entries.copy()
            radius, shift = [0] * len(now), [0] * len(now)
            for e in range(len(now)):
                if (p, e) in sums:
                    n, radius[e], total = sums[p, e]
                    now[e] = [s // n for s in total]
                    shift[e] = int(((now[e] - ball.entries[e]) ** 2).sum())
            fresh.append(Balls(now, radius, shift))
        books = fresh
    return [b.entries for b in books], state


def books_text(books: list) -> str:
    return ",".join(str(int(v)) for b in books for e in b for v in e)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vec_id: str = "vec_id",
             vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list]:
    """Codes of all vectors, and the codebooks.

    Rows whose vector is null, or holds a null or non-finite component, are
    left out, and so are empty vectors and those whose length is not that of
    the first vector that ``parts`` divides evenly.  Components become
    floor(4096 * x); beyond 2**24 they are held there, so that all distances
    are exact.  A codebook starts as that part of the smallest vec_ids (equal
    ids: smaller vector first; null ids come in only if there is no other),
    fewer than ``entries`` if there are fewer rows.  Returns (vec_id, label,
    code: binary with one byte a part, error) for every row kept, repeated
    rows as often as they come; other columns play no part.  An empty table
    gives an empty result and no codebook.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows, length = kept_vectors(vectors, parts, vec_id, vector, label)
    if not length:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("bigint").alias("error")).limit(0), []
    state = (rows.where(F.size("code") == length)
             .select("vec_id", "label", "code", F.lit(None).cast("binary").alias("own"), F.lit(None).cast("bigint").alias("error")))
    books, done = train(state, length, parts, entries, rounds)
    return done.select("vec_id", "label", F.col("own").alias("code"), "error"), books


def digest(coded: DataFrame, books: list) -> DataFrame:
    """Codes as hex text, with each label's error and the codebooks' SHA-256."""
    by_label = write_table(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    by_label = bounded_broadcast(by_label.withColumnRenamed("label", "_label"))
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["_label"]))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                         F.lit(hashlib.sha256(books_text(books).encode()).hexdigest()).alias("codebooks_sha256"))
