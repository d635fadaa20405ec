"""op11: against Lloyd rounds that try every entry, with ties, bad vectors and few rows."""
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampart.llm import ballcodes as B

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """[(vec_id, code, error, label_error)], codebook text, by trying every entry for every part."""
    ok = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
          if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not ok:
        return [], ""
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    w = len(ok[0][1]) // parts
    cut = lambda v, p: tuple(v[p * w:(p + 1) * w])
    seeds = [r for r in ok if r[0] is not None][:entries] or ok[:1]
    books = [[cut(r[1], p) for r in seeds] for p in range(parts)]

    def near(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in ok:
                groups.setdefault(near(books[p], cut(v, p))[1], []).append(cut(v, p))
            books[p] = [tuple(sum(c) // len(groups[j]) for c in zip(*groups[j])) if j in groups else e
                        for j, e in enumerate(books[p])]
    got = []
    for i, v, lab in ok:
        best = [near(books[p], cut(v, p)) for p in range(parts)]
        got.append((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), lab))
    total = {}
    for _, _, e, lab in got:
        total[lab] = total.get(lab, 0) + e
    return ([(i, c, e, total[lab]) for i, c, e, lab in got],
            ",".join(str(x) for book in books for e in book for x in e))


def spark_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("code", F.lit("x")).withColumn("own", F.lit(1)).withColumn("kind", F.lit(2))
    coded, books = B.compress(df)
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in B.digest(coded, books).collect()]
    return got


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 16))
    out = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(0, 0.05, 16)], (None, 1, 2)[i % 3]) for i in range(300)]
    out += [(1000 + i, out[0][1], 5) for i in range(40)]                            # copies
    out += [(2000 + i, [round(float(x)) / 4.0 for x in rng.integers(-2, 3, 16)], 3) for i in range(150)]   # ties
    return out


def test_equals_trying_every_entry(spark, rows):
    bad = [(5000, None, 1), (5001, [], 1), (5002, [1.0] * 15 + [None], 1), (5003, [float("nan")] * 16, 1),
           (5004, [float("inf")] * 16, 1), (5005, [1.0] * 8, 1), (5006, [1.0] * 3, 1)]
    given = rows + bad + rows[3:6] + [(None, rows[7][1], None), (3, rows[9][1], 2)]
    want, books = plain(given)
    got = spark_rows(spark, given)
    assert {r[4] for r in got} == {hashlib.sha256(books.encode()).hexdigest()}
    assert sorted((r[:4] for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, rows, n):
    want, books = plain(rows[:n])
    got = spark_rows(spark, rows[:n])
    assert sorted((r[:4] for r in got), key=key) == sorted(want, key=key)


def test_only_null_ids_and_huge_components(spark, rows):
    got = spark_rows(spark, [(None, r[1], 1) for r in rows[:20]] + [(None, [3e38] * 16, 2)])
    assert len(got) == 21 and all(r[0] is None and len(r[1]) == 16 and r[2] >= 0 for r in got)


def test_balls_spare_distances_and_change_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(-3000, 3000, (16, 8))
    x = np.concatenate([centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 61, (4000, 8)), rng.integers(-2, 3, (500, 8)) * 1000])
    entries = x[:16].copy()
    own = np.zeros(len(x), np.int64)
    radius = shift = None
    skipped = 0
    for _ in range(8):
        ball = B.Balls(entries, radius, shift)
        full = ((x[:, None] - entries[None]) ** 2).sum(-1)
        own, dist = ball.assign(x, own)
        assert (own == full.argmin(1)).all() and (dist == full.min(1)).all()
        skipped += sum(len(entries) - 1 - len(a) for a in ball.near)
        new = np.array([x[own == e].sum(0) // (own == e).sum() if (own == e).any() else entries[e] for e in range(16)])
        radius = [int(dist[own == e].max(initial=0)) for e in range(16)]
        shift = [int(((a - b) ** 2).sum()) for a, b in zip(new, entries)]
        entries = new
    assert skipped > 0                    # some entries were no neighbours
    settled = B.Balls(entries, [int(((x[own == e] - entries[e]) ** 2).sum(1).max(initial=0)) for e in range(16)], [0] * 16)
    assert all(settled.still)             # nothing has moved, so no part is looked at
    best, dist = settled.assign(x, own)
    assert (best == own).all() and (dist == ((x - entries[own]) ** 2).sum(1)).all()
