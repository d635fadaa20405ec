import numpy as np

from rampart.operators import forest as FR
from rampart.operators import threshold as TH


def _frame(spark, n=3000, outliers=5, seed=1):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 3))
    X[:outliers] += 12.0
    rows = [(i, *map(float, X[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id BIGINT, f0 DOUBLE, f1 DOUBLE, f2 DOUBLE"), X


def test_sample_sizes_and_determinism(spark):
    df, _ = _frame(spark)
    sample, psi = FR.sample_trees(df, 3000, 20, 64, 42)
    counts = {r["tree"]: r["count"] for r in sample.groupBy("tree").count().collect()}
    assert psi == 64 and len(counts) == 20 and set(counts.values()) == {64}
    a = FR.fit_forest(spark, df, n_trees=20, psi=64, seed=42)
    b = FR.fit_forest(spark, df.repartition(7), n_trees=20, psi=64, seed=42)
    pd_a = a.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    pd_b = b.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    assert pd_a.equals(pd_b)


def _brute_path(forest, x, t):
    node, depth = 0, 0
    nodes = forest.nodes[forest.nodes.tree == t].set_index("node")
    while nodes.loc[node, "feat"] >= 0:
        r = nodes.loc[node]
        node = int(r["l"]) if x[int(r["feat"])] <= r["thr"] else int(r["r"])
        depth += 1
    return nodes.loc[node, "path"], depth


def test_udf_scores_equal_brute_force(spark):
    df, X = _frame(spark, n=500)
    forest = FR.fit_forest(spark, df, n_trees=10, psi=32, seed=3)
    got = {r["id"]: r["raw_score"] for r in FR.score(df, forest).collect()}
    for i in (0, 1, 17, 250, 499):
        paths = [_brute_path(forest, X[i], t)[0] for t in range(10)]
        want = -2 ** (-np.mean(paths) / FR.c_factor(32))
        assert abs(got[i] - want) < 1e-12


def test_planted_outliers_rank_first_and_contamination(spark):
    df, _ = _frame(spark, n=3000, outliers=5)
    forest = FR.fit_forest(spark, df, n_trees=100, psi=256, seed=42)
    raw = FR.score(df, forest)
    offset = FR.fit_offset(raw, 0.002)
    dec = FR.decide(raw, offset)
    worst = [r["id"] for r in dec.orderBy("anomaly_score").limit(5).collect()]
    assert sorted(worst) == [0, 1, 2, 3, 4]
    flagged = FR.anomalies(dec).count()
    assert 4 <= flagged <= 8


def test_exact_quantile_matches_numpy(spark):
    vals = np.random.default_rng(0).normal(size=20000)
    df = spark.createDataFrame([(float(v),) for v in vals], "x DOUBLE")
    for q in (0.0007, 0.5, 0.99):
        got = TH.exact_quantile(df, "x", q)
        assert abs(got - float(np.percentile(vals, q * 100))) < 1e-12


def test_adaptive_filter_matches_pandas(spark):
    rng = np.random.default_rng(4)
    rows = [(int(b), float(s)) for b, s in zip(rng.integers(0, 5, 400), rng.normal(-0.05, 0.05, 400))]
    df = spark.createDataFrame(rows, "batch_id BIGINT, anomaly_score DOUBLE")
    got = sorted((r[0], r[1]) for r in TH.adaptive_filter(df).collect())
    import pandas as pd
    p = pd.DataFrame(rows, columns=["batch_id", "anomaly_score"])
    g = p.groupby("batch_id")["anomaly_score"]
    m, s = g.transform("mean"), g.transform(lambda x: x.std(ddof=0))
    want = sorted(map(tuple, p[(p.anomaly_score < m * (1 - 10 * s)) & (p.anomaly_score < 0.09)].values.tolist()))
    assert [(int(a), b) for a, b in want] == [(int(a), b) for a, b in got] or \
        all(abs(a[1] - b[1]) < 1e-12 for a, b in zip(want, got))


def test_sample_is_each_trees_smallest_hashes(spark):
    """The hash cut only saves work: the sample is the bottom psi of all rows."""
    df, _ = _frame(spark, n=3000)
    cut, psi = FR.sample_trees(df, 3000, 5, 50, 42)
    full, _ = FR.sample_trees(df, 3000, 5, 50, 42, oversample=60.0)
    got = sorted((r["tree"], r["id"]) for r in cut.collect())
    assert psi == 50 and len(got) == 250
    assert got == sorted((r["tree"], r["id"]) for r in full.collect())


def test_score_checks_features_and_refit_options(spark):
    import pytest

    from rampart.plans import detect as DT
    rows = [(i, f"10.0.0.{i % 5}", f"/p{i % 7}", "t" * (i % 4 + 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id BIGINT, RemoteAddress STRING, URL STRING, token STRING")
    model, scored = DT.train(spark, df, n_trees=10, psi=32)
    assert scored.count() == 300
    again = DT.score(df, model)
    assert again.count() == 300
    refit = DT.score(df, model, refit_labels=True, refit_scaler=True)
    assert refit.count() == 300
    with pytest.raises(ValueError):
        DT.score(df.drop("token", "URL"), model)


def test_scores_walk_every_tree_in_blocks_of_rows(monkeypatch):
    """Rows in blocks, NaN and single-leaf trees: the scores of a walk node by node."""
    rng = np.random.default_rng(4)
    feat, thr, left, right, path = (np.zeros((3, 5), t) for t in ("i4", "f8", "i4", "i4", "f8"))
    feat[:] = -1
    feat[0, 0], left[0, 0], right[0, 0], path[0, 1:3] = 1, 1, 2, (1.5, 2.5)
    feat[1, [0, 2]], thr[1, [0, 2]], left[1, [0, 2]], right[1, [0, 2]], path[1] = (0, 1), (0.3, -0.2), (1, 3), (2, 4), (0, 1, 0, 4, 2)
    path[2, 0] = 3.25
    forest = FR.Forest(feat, thr, left, right, path, 150, 0, ["a", "b"])
    X = rng.normal(size=(10, 2))
    X[3, 1] = np.nan

    def leaf(tree, x):
        node = 0
        while feat[tree, node] >= 0:
            node = (left if x[feat[tree, node]] <= thr[tree, node] else right)[tree, node]
        return path[tree, node]

    want = [-2.0 ** (-np.mean([leaf(t, x) for t in range(3)]) / FR.c_factor(150)) for x in X]
    walked = []
    monkeypatch.setattr(FR, "SCORE_ROWS", 4)
    monkeypatch.setattr(FR.np, "repeat", lambda a, k, axis: walked.append(k) or np.tile(a, (1, k)))
    assert np.allclose(forest.raw_scores(X), want, rtol=1e-14, atol=0)
    assert walked == [4, 4, 2]
