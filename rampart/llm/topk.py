"""Exact top-k inner-product search: tiled matrix products and tree merging.

Vectors become integer codes.  Queries and candidates are packed into tiles
of a bounded number of rows; every pair of a query tile and a candidate tile
is one matrix product in one task, which keeps each query's best k of that
tile.  The kept lists merge in a tree, a bounded number of lists a node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.common import partitions

TOP = 5
QUERY_TILE = 512            # rows
CANDIDATE_TILE = 4096       # rows
FAN_IN = 64                 # lists merged by one node of the tree
CODE = "array<bigint>"


def codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, code, copies): floor(scale * x) of each component, x as double.

    Vectors that are null, empty, or hold a null or non-finite component take
    no part, nor does a null id.  Rows of one id and code are one row with
    their number.
    """
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.where(F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite)
            .select(F.col(vec_id).cast("bigint").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale)).cast(CODE).alias("code"))
            .groupBy("vec_id", "code").agg(F.count(F.lit(1)).alias("copies")))


def packed_ints(mat: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them all; ``unpacked`` reads them back."""
    low, high = int(mat.min()), int(mat.max())
    width = next(w for w in (1, 2, 4, 8) if -1 << 8 * w - 1 <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + mat.astype(f"<i{width}").tobytes()


def unpacked(buf: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(buf, f"<i{buf[0]}", offset=1).reshape(rows, -1).astype(np.int64)


def tiles(coded: DataFrame, rows: int, out: str, n: int) -> DataFrame:
    """Pack codes into tiles of at most ``rows`` rows of one dimension; ids and
    copies are the two columns of a tile's ``ids``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def tile(dim: int) -> pa.RecordBatch:
            ids, mats = zip(*held.pop(dim))
            ids, mat = np.concatenate(ids), np.concatenate(mats)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                 pa.array([packed_ints(mat)], pa.binary())], ["dim", f"{out}_ids", out])

        for b in batches:
            ids = np.stack([b.column("vec_id").to_numpy(), b.column("copies").to_numpy()], 1)
            col = b.column("code")
            dims = np.diff(col.offsets.to_numpy())
            for dim in np.unique(dims):
                pick = np.flatnonzero(dims == dim)
                flat = col.take(pa.array(pick)).flatten().to_numpy()
                mat = flat.reshape(len(pick), dim)
                for lo in range(0, len(pick), rows):
                    own = held.setdefault(int(dim), [])
                    have = sum(len(x) for x, _ in own)
                    if have and have + len(pick[lo:lo + rows]) > rows:
                        yield tile(int(dim))
                        own = held.setdefault(int(dim), [])
                    own.append((ids[pick[lo:lo + rows]], mat[lo:lo + rows]))
        for dim in list(held):
            yield tile(dim)

    # sorted, so that a task that runs again packs the same tiles
    packed = coded.repartition(n, "vec_id", "code").sortWithinPartitions("vec_id", "code").mapInArrow(pack, f"dim int, {out}_ids binary, {out} binary")
    return packed.withColumn(f"{out}_tile", F.monotonically_increasing_id())


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple:
    """(query places, candidate ids, scores): the best k of one tile for each query.

    Ids come with copies in a second column.  The product runs in floating
    point while every sum stays below 2**53, which is exact, and in 64-bit
    integers otherwise.  A candidate of the query's own id and code has one
    copy less, the query's own row; ties go to the smaller id.
    """
    order = np.argsort(c_ids[:, 0], kind="stable")
    c_ids, c = c_ids[order], c[order]
    bound = float(np.abs(q.astype(float)).max()) * float(np.abs(c.astype(float)).max()) * q.shape[1]
    s = (q.astype(float) @ c.T.astype(float)).astype(np.int64) if bound < 2.0 ** 53 else q @ c.T
    near = np.flatnonzero(np.isin(c_ids[:, 0], q_ids[:, 0]))
    place = {(c_ids[j, 0], c[j].tobytes()): j for j in near}
    own = np.array([place.get((i, v.tobytes()), -1) for i, v in zip(q_ids[:, 0], q)], np.int64)
    alone = np.flatnonzero((own >= 0) & (c_ids[own, 1] == 1))
    valid = np.ones(s.shape, bool)
    valid[alone, own[alone]] = False
    s[~valid] = np.iinfo(np.int64).min
    m = min(k, len(c_ids))
    cut = np.partition(s, len(c_ids) - m, axis=1)[:, len(c_ids) - m]
    rows, cols = np.nonzero((s >= cut[:, None]) & valid)
    copies = np.minimum(c_ids[cols, 1] - (own[rows] == cols), k)
    rows, cols = np.repeat(rows, copies), np.repeat(cols, copies)
    score = s[rows, cols]
    by = np.lexsort((cols, -score, rows))
    rows, cols, score = rows[by], cols[by], score[by]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], c_ids[cols[keep], 0], score[keep]


def search(vectors: DataFrame, is_query, k: int = TOP, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest scores over all other rows.

    ``is_query`` is a condition on ``vec_id``.  Returns query_id, rank (from
    1), vec_id and score; a query with fewer candidates has fewer rows, and
    vectors of different dimension do not meet.  Every row is a candidate for
    all queries but itself, and rows that share an id are queries of their
    own, each with its ranks.  Scores are exact while they
    fit 64-bit integers.  An empty table gives an empty result.
    """
    n = partitions(vectors.sparkSession)
    coded = codes(vectors, vec_id, vector)
    q = tiles(coded.where(is_query), QUERY_TILE, "q", max(1, n // 4))
    c = tiles(coded, CANDIDATE_TILE, "c", n)
    # every candidate tile carries a lane; a query tile is copied to each lane,
    # so the blocks of a query tile run in n tasks
    lanes = c.withColumn("lane", F.pmod(F.xxhash64("c_tile"), F.lit(n)).cast("int"))
    copies = q.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(j)[i].as_py() for j, name in enumerate(b.schema.names)}
                q_ids, c_ids = (np.frombuffer(row[x], "<i8").reshape(-1, 2) for x in ("q_ids", "c_ids"))
                a, x, s = best_of_tile(q_ids, unpacked(row["q"], len(q_ids)), c_ids, unpacked(row["c"], len(c_ids)), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(a), row["q_tile"], np.int64)), pa.array(a, pa.int64()), pa.array(q_ids[a, 0]),
                     pa.array(q_ids[a, 1]), pa.array(np.full(len(a), row["c_tile"], np.int64)), pa.array(x), pa.array(s)],
                    ["q_tile", "place", "query_id", "copies", "node", "vec_id", "score"])

    # a merge join: the planner sees the size of the query tiles before they are
    # copied to the lanes, and would broadcast all copies through the driver
    blocks = lanes.hint("merge").join(copies, ["dim", "lane"]).select("q_tile", "q_ids", "q", "c_tile", "c_ids", "c")
    best = blocks.mapInArrow(product, "q_tile bigint, place bigint, query_id bigint, copies bigint, node bigint, "
                                      "vec_id bigint, score bigint")
    return merge_tree(best, k, n)


def merge_tree(best: DataFrame, k: int, n: int) -> DataFrame:
    """Merge lists of (query, node, vec_id, score) to one ranked list a query,
    which is a place in a query tile with its id and copies.

    Two levels: lists first meet in nodes of about the square root of their
    number (at least ``FAN_IN``), then the nodes' lists meet.
    """
    entry = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))
    top = F.slice(F.array_sort(F.collect_list(entry)), 1, k)
    width = max(FAN_IN, int(n ** 0.5))
    query = ["q_tile", "place", "query_id", "copies"]
    part = (best.groupBy(*query, F.pmod(F.xxhash64("node"), F.lit(width)).alias("node")).agg(top.alias("t"))
            .select(*query, F.explode("t").alias("e")))
    whole = part.groupBy(*query).agg(F.slice(F.array_sort(F.collect_list("e")), 1, k).alias("t"))
    # repeated rows of one vector are as many queries
    each = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return (each.select("query_id", F.posexplode("t").alias("p", "e"))
            .select("query_id", (F.col("p") + 1).alias("rank"), F.col("e.v").alias("vec_id"),
                    (-F.col("e.s")).alias("score")))
