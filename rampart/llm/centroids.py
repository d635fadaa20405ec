"""Centroid clustering with the threshold algorithm as nearest-centroid search.

Every dimension keeps its centroids sorted by their value there.  For a
vector, each dimension's list is walked outward from the vector's own value;
at every depth the centroids met for the first time get their exact distance,
and the squared gaps at the walk's frontier add up to a bound that no
centroid still unmet can beat.  The walk stops when this bound strictly
exceeds the best exact distance, so ties are all met.  Vectors of a batch walk
together; everything is in exact integers.

A round is one pass in Spark: tasks emit each centroid's count and component
sums, which merge by key; the driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import prepare
from rampart.llm.vectors import batches_of, finite, integer_code, matrix
from rampart.session import write_table

CENTROIDS = 8
ROUNDS = 10
WIDTH = 64
SCALE = 1024
SEED = 3
LIMIT = 1 << 27             # components are held within it, so that distances fit 64 bits
BATCH = 4096                # vectors that walk together


class SortedLists:
    """Centroids (rows of integers) with each dimension's order."""

    def __init__(self, centroids: np.ndarray):
        self.rows = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.value = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest centroid, squared distance, exact distances taken) of each row; ties: smaller number."""
        k, width = self.rows.shape
        n, taken = len(x), 0
        best = np.zeros(n, np.int64)
        dist = np.full(n, np.iinfo(np.int64).max)
        met = np.zeros((n, k), bool)
        high = np.zeros((n, width), np.int64)       # the next list place above each value; below it: low
        for row in self.value:
            high += row < x
        low = high - 1
        live = np.arange(n)
        dims = np.arange(width)
        for _ in range(k):
            lo, hi, own = low[live], high[live], x[live]
            down = np.where(lo >= 0, own - self.value[np.maximum(lo, 0), dims], np.iinfo(np.int64).max)
            up = np.where(hi < k, self.value[np.minimum(hi, k - 1), dims] - own, np.iinfo(np.int64).max)
            back = down <= up
            gap = np.where(back, down, up)
            seen = self.order[np.where(back, np.maximum(lo, 0), np.minimum(hi, k - 1)), dims]
            low[live], high[live] = lo - back, hi + ~back
            for c in range(k):
                new = live[(seen == c).any(1) & ~met[live, c]]
                if not len(new):
                    continue
                met[new, c] = True
                taken += len(new)
                d = ((x[new] - self.rows[c]) ** 2).sum(1)
                better = (d < dist[new]) | ((d == dist[new]) & (c < best[new]))
                best[new[better]], dist[new[better]] = c, d[better]
            live = live[(gap * gap).sum(1) <= dist[live]]
            if not len(live):
                break
        return best, dist, taken


def kept_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", width: int = WIDTH) -> DataFrame:
    v = F.col(vector)
    return write_table(vectors.where(finite(v) & (F.size(v) == width)).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), integer_code(v, SCALE, LIMIT).alias("code")), "codes")


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose ``seed:vec_id`` has the smallest SHA-256; at most ``k``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = rows.where(F.col("vec_id").isNotNull()).select("code", key.alias("key")).orderBy("key", "code").limit(k).collect()
    if not got:                                  # nothing but rows without an id
        got = rows.orderBy("code").limit(1).collect()
    return np.array([r["code"] for r in got], np.int64)


def round_sums(rows: DataFrame, centroids: np.ndarray) -> dict:
    """centroid -> (count, component sums); at most as many keys as centroids."""
    lists = SortedLists(centroids)
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches_of(batches, BATCH):
            x = matrix(b.column("code"), width)
            best, _, _ = lists.nearest(x)
            n += np.bincount(best, minlength=k)
            for c in np.unique(best):
                total[c] += x[best == c].sum(0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]),
                                          pa.array(total[at].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    part = rows.select("code").mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    got = (part.select("cluster", "n", F.posexplode("total").alias("i", "s")).groupBy("cluster", "i")
           .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
    out: dict = {}
    for r in got.orderBy("cluster", "i").collect():
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["s"]))
    return out


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every row."""
    lists = SortedLists(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, BATCH):
            best, dist, _ = lists.nearest(matrix(b.column("code"), lists.rows.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(dist)],
                                             ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def centroid_hash(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, vec_id: str = "vec_id",
            vector: str = "embedding", width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """Clusters of all vectors of ``width`` finite components, and the centroids.

    Components become floor(1024 * x); beyond 2**27 they are held there, so
    that all distances are exact.  Vectors of another length, null ones (empty
    ones included) and those with a null or non-finite component are left out.
    The first centroids are the vectors whose ids hash smallest (equal ids:
    smaller vector first; null ids only if there is no other); with fewer rows
    there are fewer.  Each of ``rounds`` rounds assigns all vectors and moves
    every non-empty centroid to its vectors' floored mean; then vectors are
    assigned once more.  Returns (vec_id, cluster, distance), repeated rows as
    often as they come; other columns play no part; an empty table gives an
    empty result.
    """
    prepare(vectors.sparkSession)
    rows = kept_vectors(vectors, vec_id, vector, width)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), centroids
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, total) in round_sums(rows, centroids).items():
            moved[c] = [s // n for s in total]
        if (moved == centroids).all():           # every further round repeats this one
            break
        centroids = moved
    return assign(rows, centroids), centroids


def summary(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds each cluster's and the whole inertia (null beyond 64 bits) and the centroid's SHA-256."""
    spark = clustered.sparkSession
    rows = write_table(clustered, "clusters")
    # one row a centroid
    each = rows.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    whole = rows.agg(F.try_sum("distance").alias("inertia")).first()["inertia"]
    names = spark.createDataFrame([(i, centroid_hash(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    per = F.broadcast(each.join(F.broadcast(names), "cluster"))
    return rows.join(per, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia",
                                            F.lit(whole).cast("bigint").alias("inertia"), "centroid_sha256")
