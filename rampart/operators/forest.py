"""Isolation forest (Liu, Ting and Zhou, 2008) on Spark.

* M1 sampling: tree ``t`` takes the ``psi`` rows with the smallest
  ``xxhash64(id, t, seed)``, a uniform sample without replacement that does
  not depend on how the data is partitioned.  A hash threshold keeps only a
  few times ``psi`` candidates per tree before the per-tree ranking, so
  only ``T * ~4 * psi`` rows are shuffled, whatever the input's size.
* M2 build: ``groupBy(tree).applyInPandas``; each group holds ``psi`` rows.
* The model is a node table of at most ``T * (2 * psi - 1)`` rows: bounded
  by the parameters, not by the data, so it is collected and broadcast.
* M4 scoring: an Arrow-batched pandas UDF walks all trees with NumPy.
* M3 offset: exact percentile of the training scores, computed without
  gathering the scores in one task (``rampart.operators.threshold``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rampart.operators.threshold import exact_quantile, sketch_quantile
from rampart.schemas import FOREST_NODES, FOREST_PARAMS

EULER_GAMMA = 0.5772156649015329
HASH_SPACE = float(2 ** 63)


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def _unit_hash(*cols: Column) -> Column:
    """A uniform number in [0, 1) from a 64-bit hash of the columns."""
    h = F.xxhash64(*cols)
    return F.abs(h.cast("double")) / F.lit(HASH_SPACE)


def sample_trees(features: DataFrame, n_rows: int, n_trees: int, psi: int, seed: int,
                 id_col: str = "id", oversample: float = 4.0) -> tuple[DataFrame, int]:
    """M1: rows of every tree's sample, as ``(tree, id, f0..fk)``.

    Tree ``t`` takes the ``psi`` rows with the smallest ``h_t(id)``, whatever
    the input's size.  A row is a candidate of the trees whose hash of it is
    below ``oversample * psi / n``, so about ``oversample * psi`` rows a tree
    leave the scan.  A tree left short (the caller checks) asks for a larger
    ``oversample``; at ``n / psi`` every row is a candidate.

    Returns the sample frame and the effective ``psi = min(psi, n)``.
    """
    psi_eff = int(min(psi, n_rows))
    fcols = [c for c in features.columns if c.startswith("f") and c[1:].isdigit()]
    tau = oversample * psi / max(n_rows, 1)
    hits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.struct(
        t.alias("tree"), _unit_hash(F.col("id"), t, F.lit(seed)).alias("_u"))), lambda x: x["_u"] < tau)
    cands = features.select(F.col(id_col).alias("id"), *fcols).select("id", *fcols, F.inline(hits))
    w = F.row_number().over(_tree_window())
    ranked = cands.withColumn("_rn", w).where(F.col("_rn") <= psi_eff).drop("_rn")
    return ranked, psi_eff


def _tree_window():
    from pyspark.sql import Window
    return Window.partitionBy("tree").orderBy("_u", "id")


def _build_one(pdf: pd.DataFrame, fcols: list[str], psi: int, seed: int) -> pd.DataFrame:
    """Grow one isolation tree on its sample (rows ordered by id)."""
    pdf = pdf.sort_values("id", kind="mergesort")
    tree = int(pdf["tree"].iloc[0])
    X = pdf[fcols].to_numpy(dtype=np.float64)
    rng = np.random.default_rng([int(seed) & 0xFFFFFFFF, tree])
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    rows = []  # node, feat, thr, l, r, path
    stack = [(np.arange(len(X)), 0, 0)]
    next_id = 1
    while stack:
        idx, depth, node = stack.pop()
        n = len(idx)
        split = None
        if depth < max_depth and n > 1:
            sub = X[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if len(usable):
                f = int(usable[rng.integers(len(usable))])
                thr = float(rng.uniform(lo[f], hi[f]))
                go_left = sub[:, f] <= thr
                split = (f, thr, idx[go_left], idx[~go_left])
        if split is None:
            rows.append((node, -1, 0.0, -1, -1, depth + c_factor(n)))
            continue
        f, thr, li, ri = split
        left, right = next_id, next_id + 1
        next_id += 2
        rows.append((node, f, thr, left, right, float("nan")))
        stack.append((ri, depth + 1, right))
        stack.append((li, depth + 1, left))
    out = pd.DataFrame(rows, columns=["node", "feat", "thr", "l", "r", "path"])
    out.insert(0, "tree", tree)
    return out.astype({"tree": "int32", "node": "int32", "feat": "int32", "l": "int32", "r": "int32"})


# Rows that walk all trees at once: their places fit the processor's cache.
SCORE_ROWS = 256


@dataclass
class Forest:
    """Node arrays ``(T, max_nodes)`` plus the fit parameters."""
    feat: np.ndarray
    thr: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    psi: int
    seed: int
    features: list[str]
    offset: float = 0.0
    contamination: float | None = None
    nodes: pd.DataFrame = field(default_factory=pd.DataFrame, repr=False)

    @property
    def n_trees(self) -> int:
        return self.feat.shape[0]

    @classmethod
    def from_nodes(cls, nodes: pd.DataFrame, psi: int, seed: int, features: list[str],
                   offset: float = 0.0, contamination: float | None = None) -> "Forest":
        n_trees = int(nodes["tree"].max()) + 1
        width = int(nodes["node"].max()) + 1
        feat = np.full((n_trees, width), -1, dtype=np.int32)
        thr = np.zeros((n_trees, width))
        left = np.zeros((n_trees, width), dtype=np.int32)
        right = np.zeros((n_trees, width), dtype=np.int32)
        path = np.zeros((n_trees, width))
        t, n = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        feat[t, n] = nodes["feat"].to_numpy()
        thr[t, n] = nodes["thr"].to_numpy()
        left[t, n] = np.maximum(nodes["l"].to_numpy(), 0)
        right[t, n] = np.maximum(nodes["r"].to_numpy(), 0)
        path[t, n] = np.nan_to_num(nodes["path"].to_numpy())
        keep = nodes[["tree", "node", "feat", "thr", "l", "r", "path"]].reset_index(drop=True)
        return cls(feat, thr, left, right, path, psi, seed, features, offset, contamination, keep)

    def nodes_frame(self) -> pd.DataFrame:
        return self.nodes

    def broadcast(self, sc):
        """A broadcast of this forest, created on first use."""
        bc = self.__dict__.get("_bc")
        if bc is None:
            bc = sc.broadcast(self)
            self.__dict__["_bc"] = bc
        return bc

    def __getstate__(self):
        state = dict(self.__dict__)
        state.pop("_bc", None)
        state.pop("_flat", None)
        state.pop("nodes", None)          # executors need only the arrays
        return state

    def __setstate__(self, state):
        state.setdefault("nodes", pd.DataFrame())
        self.__dict__.update(state)

    def _flat_nodes(self) -> tuple:
        """Features, thresholds, children, paths over all trees in one array each,
        and the depth; a leaf is its own child, ``kids`` are (right, left) pairs."""
        flat = self.__dict__.get("_flat")
        if flat is None:
            inner = self.feat >= 0
            here = np.arange(self.feat.size).reshape(self.feat.shape)
            first = here[:, :1]
            kids = np.stack([np.where(inner, first + self.right, here), np.where(inner, first + self.left, here)], -1).ravel()
            depth, node = 0, here[:, 0]
            while inner.ravel()[node].any():
                depth, node = depth + 1, np.unique(kids.reshape(-1, 2)[node])
            flat = (np.where(inner, self.feat, 0).ravel(), self.thr.ravel(), kids, self.path.ravel(), depth)
            self.__dict__["_flat"] = flat
        return flat

    def raw_scores(self, X: np.ndarray) -> np.ndarray:
        """``-2 ** (-mean path / c(psi))`` for the rows of ``X``."""
        feat, thr, kids, path, depth = self._flat_nodes()
        n, width = X.shape
        values = np.ascontiguousarray(X).ravel()
        roots = (np.arange(self.n_trees) * self.feat.shape[1])[:, None]
        paths = np.empty((self.n_trees, n))
        for lo in range(0, n, SCORE_ROWS):
            row = (np.arange(lo, min(n, lo + SCORE_ROWS)) * width)[None, :]
            node = np.repeat(roots, row.shape[1], axis=1)
            for _ in range(depth):
                down = values.take(row + feat.take(node)) <= thr.take(node)
                node = kids.take(2 * node + down)
            paths[:, lo:lo + SCORE_ROWS] = path.take(node)
        mean_path = paths.mean(axis=0)
        return -np.power(2.0, -mean_path / c_factor(self.psi))


def fit_forest(spark: SparkSession, features: DataFrame, n_trees: int = 100, psi: int = 256,
               seed: int = 42, id_col: str = "id", n_rows: int | None = None,
               feature_names: list[str] | None = None) -> Forest:
    """M1 + M2: sample, grow the trees in parallel, collect the node table."""
    fcols = [c for c in features.columns if c.startswith("f") and c[1:].isdigit()]
    n = n_rows if n_rows is not None else features.count()
    if n == 0:
        raise ValueError("cannot fit a forest on no rows")
    schema = T.StructType([f for f in FOREST_NODES.fields])
    oversample = 4.0
    while True:
        sample, psi_eff = sample_trees(features, n, n_trees, psi, seed, id_col, oversample)
        sample = sample.persist()          # T * psi rows at most
        sizes = {r["tree"]: r["count"] for r in sample.groupBy("tree").count().collect()}
        if len(sizes) == n_trees and min(sizes.values()) >= psi_eff or oversample * psi >= n:
            break
        sample.unpersist()
        oversample *= 4

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return _build_one(pdf, fcols, psi_eff, seed)

    try:
        nodes = sample.groupBy("tree").applyInPandas(build, schema=schema).toPandas()
    finally:
        sample.unpersist()
    if nodes["tree"].nunique() != n_trees:
        raise RuntimeError(f"forest has {nodes['tree'].nunique()} trees, expected {n_trees}")
    return Forest.from_nodes(nodes, psi_eff, seed, feature_names or fcols)


def score(df: DataFrame, forest: Forest, out: str = "raw_score") -> DataFrame:
    """M4 (raw part): Arrow-batched scoring of ``f0..fk`` with all trees.

    The forest is broadcast once and the handle reused, so a streaming query
    that scores every micro-batch ships the model to each executor once.
    """
    bc = forest.broadcast(df.sparkSession.sparkContext)
    fcols = [f"f{i}" for i in range(len(forest.features))]

    @F.pandas_udf(T.DoubleType())
    def _score(*cols: pd.Series) -> pd.Series:
        X = np.column_stack([c.to_numpy(dtype=np.float64) for c in cols])
        return pd.Series(bc.value.raw_scores(X))

    return df.withColumn(out, _score(*[F.col(c) for c in fcols]))


def fit_offset(scored: DataFrame, contamination: float, col: str = "raw_score",
               n: int | None = None, error: float | None = None) -> float:
    """M3: the ``contamination`` percentile of the training scores: exact, or
    in one pass with a rank off by at most ``error`` of the rows."""
    if error is not None:
        return sketch_quantile(scored, col, contamination, error)
    return exact_quantile(scored, col, contamination, n)


def decide(scored: DataFrame, offset: float, raw: str = "raw_score") -> DataFrame:
    """M4 + M5: ``anomaly_score = raw - offset``; ``anomaly`` is -1 below 0."""
    dec = F.col(raw) - F.lit(offset)
    return (scored.withColumn("anomaly_score", dec)
            .withColumn("anomaly", F.when(F.col("anomaly_score") < 0, F.lit(-1)).otherwise(F.lit(1)))
            .drop(raw))


def anomalies(decided: DataFrame) -> DataFrame:
    """M6: rows labelled -1."""
    return decided.where(F.col("anomaly") == -1)


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    """SNK8: node table and parameter row as parquet."""
    nodes = spark.createDataFrame(forest.nodes_frame(), FOREST_NODES)
    nodes.write.mode("overwrite").parquet(path.rstrip("/") + "/forest_nodes")
    params = spark.createDataFrame([(forest.psi, forest.n_trees, float(forest.offset), int(forest.seed),
                                     list(forest.features), forest.contamination)], FOREST_PARAMS)
    params.write.mode("overwrite").parquet(path.rstrip("/") + "/forest_params")


def load_forest(spark: SparkSession, path: str) -> Forest:
    """SNK9: read a saved forest back (bounded node table → driver)."""
    nodes = spark.read.parquet(path.rstrip("/") + "/forest_nodes").toPandas()
    p = spark.read.parquet(path.rstrip("/") + "/forest_params").collect()[0]
    return Forest.from_nodes(nodes, p["psi"], p["seed"], list(p["features"]), p["offset"], p["contamination"])
