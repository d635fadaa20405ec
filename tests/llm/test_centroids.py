"""op13: against Lloyd rounds that try every centroid, with ties, bad vectors and few rows."""
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampart.llm import centroids as C

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, k=8, rounds=10, width=64):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows
          if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    if not ok:
        return []
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in ok if i is not None)[:k]
    cents = [v for _, v in first] or [min(v for _, v in ok)]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in ok:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    got = [(i, *near(v)[::-1]) for i, v in ok]
    whole = sum(d for _, _, d in got)
    return [(i, j, d, sum(e for _, c, e in got if c == j), whole,
             hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, j, d in got]


def spark_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("code", F.lit("x")).withColumn("cluster", F.lit(9))
    return [tuple(r) for r in C.summary(*C.cluster(df)).collect()]


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.1, 64) + (i % 5) * 0.1], i % 3) for i in range(150)]
    out += [(500 + i, [float(x) / 4 for x in rng.integers(-1, 2, 64)], None) for i in range(60)]       # ties
    return out + [(700 + i, out[0][1], 1) for i in range(20)]                                          # copies


def test_equals_trying_every_centroid(spark, rows):
    bad = [(900, None, 1), (901, [], 1), (902, [1.0] * 63, 1), (903, [1.0] * 63 + [None], 1), (904, [float("nan")] * 64, 1),
           (905, [float("-inf")] * 64, 1), (906, [0.5] * 128, 1)]
    given = rows + bad + rows[4:6] + [(None, rows[8][1], 1), (11, rows[12][1], 1)]
    assert sorted(spark_rows(spark, given), key=key) == sorted(plain(given), key=key)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, rows, n):
    assert sorted(spark_rows(spark, rows[:n]), key=key) == sorted(plain(rows[:n]), key=key)


def test_only_null_ids_and_huge_components(spark, rows):
    got = spark_rows(spark, [(None, r[1], 1) for r in rows[:10]] + [(1, [3e38] * 64, 1)])
    assert len(got) == 11 and all(r[2] >= 0 for r in got)


def test_the_walk_stops_early_and_meets_ties():
    rng = np.random.default_rng(1)
    cents = np.repeat(np.arange(8)[:, None] * 1000, 64, 1) + rng.integers(-5, 6, (8, 64))
    cents[6] = cents[2]                                       # equal centroids: the smaller number wins
    x = np.concatenate([cents[rng.integers(0, 8, 500)] + rng.integers(-20, 21, (500, 64)), rng.integers(-1, 2, (200, 64)) * 500])
    best, dist, taken = C.SortedLists(cents).nearest(x)
    full = ((x[:, None] - cents[None]) ** 2).sum(-1)
    assert (best == full.argmin(1)).all() and (dist == full.min(1)).all()
    assert taken < 8 * len(x)                                 # not every exact distance was taken
    for k in (1, 2):
        best, dist, _ = C.SortedLists(cents[:k]).nearest(x)
        assert (best == full[:, :k].argmin(1)).all() and (dist == full[:, :k].min(1)).all()
