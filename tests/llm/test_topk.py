"""op8: against a full sort, with ties, bad vectors and small tiles."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampart.llm import topk as K


def brute(rows, k=5):
    code = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, own) in enumerate(code):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(own, v)), c) for j, (c, v) in enumerate(code)
                          if j != at and len(v) == len(own))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(i, [float(x) for x in np.float32(rng.normal(0, 0.3, 8))]) for i in range(400)]
    same = out[0][1]
    out += [(1000 + i, same) for i in range(60)]                       # ties
    out += [(500, None), (550, [1.0, None] + [0.0] * 6), (600, [float("nan")] + [0.0] * 7), (650, [float("inf")] + [0.0] * 7),
            (700, []), (None, same), (750, [1.0, 2.0]), (751, [0.5, 0.5]), (800, [1e6] * 8), (801, [-1e6] * 8)]
    # repeated rows, one id with two vectors, a query that comes three times, a vector that comes often
    return out + out[5:9] + [(50, [9.0] * 8)] + [out[100]] * 2 + [(50, [9.0] * 8)] + [(77, [8.0] * 8)] * 9


def test_equals_full_sort(spark, rows, monkeypatch):
    monkeypatch.setattr(K, "QUERY_TILE", 3)
    monkeypatch.setattr(K, "CANDIDATE_TILE", 37)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("code", F.lit(1)).withColumn("lane", F.lit(2))
    got = sorted(map(tuple, K.search(df, F.pmod("vec_id", F.lit(50)) == 0).collect()))
    assert got == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert K.search(df, F.col("vec_id") % 50 == 0).collect() == []


def test_query_tiles_are_not_broadcast(spark, rows):
    """The copies of the query tiles go to the lanes by a shuffle, never through the driver."""
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = K.search(df, F.pmod("vec_id", F.lit(50)) == 0)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("values, width", [([-128, 127], 1), ([-129, 0], 2), ([0, 128], 2), ([40000, -1], 4), ([2 ** 31, 0], 8),
                                           ([2 ** 63 - 1, -2 ** 63], 8)])
def test_tiles_keep_every_integer(values, width):
    mat = np.array([values, values[::-1]], np.int64)
    buf = K.packed_ints(mat)
    assert len(buf) == 1 + 4 * width and (K.unpacked(buf, 2) == mat).all()
