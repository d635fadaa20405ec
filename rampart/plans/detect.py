"""Training (E2) and scoring (E1) jobs over the normalized table.

Fit once, save, reuse: the label dictionary, the scaler and the forest are
fitted on the training data and saved as tables; scoring reads them back.
Unseen labels get code -1 at scoring time (``refit`` extends the dictionary
instead, as the reference does, at the price of shifting codes).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.operators import features as FT
from rampart.operators import forest as FR
from rampart.operators import threshold as TH
from rampart.session import write_table

# Fixed values of the reference's training run: contamination and sample
# size per tree; the experiment used contamination 0.0005 with seed 42.
TRAIN_CONTAMINATION = 0.0007
TRAIN_MAX_SAMPLES = 150
EXPERIMENT_CONTAMINATION = 0.0005
N_TREES = 100
DEFAULT_SEED = 42


@dataclass
class Model:
    labels: DataFrame
    scaler: DataFrame
    forest: FR.Forest
    features: list[str]


def _encoded_names(df: DataFrame, features: list[str]) -> list[str]:
    import pyspark.sql.types as T
    return [c + "_code" if isinstance(df.schema[c].dataType, T.StringType) else c for c in features]


def _encoded(df: DataFrame, features: list[str], labels: DataFrame | None, small_input: bool = False):
    """Lengths and label codes; returns ``(encoded, labels, names, columns)``."""
    base = FT.add_lengths(df)
    cats = [c for c in features if c in FT.string_columns(base)]
    if labels is None:
        labels = FT.fit_labels(base, cats)
    enc = FT.encode(base, labels, cats, small_input=small_input)
    return enc, labels, _encoded_names(base, features), base.columns


def _scaled(enc: DataFrame, scaler: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    scaled = FT.scale(enc, scaler, names, suffix="_s")
    return scaled.select(*[F.col(f"`{c}`") for c in keep],
                         *[F.col(f"`{n}_s`").alias(f"f{i}") for i, n in enumerate(names)])


def prepare(df: DataFrame, features: list[str], labels: DataFrame | None = None,
            scaler: DataFrame | None = None, small_input: bool = False
            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """FT1–FT9: lengths, codes and scaled ``f0..fk`` beside the originals.

    Returns ``(frame, labels, scaler)``, fitting what is not given.
    """
    enc, labels, names, keep = _encoded(df, features, labels, small_input)
    if scaler is None:
        scaler = write_table(FT.fit_scaler(enc, names), "scaler")
    return _scaled(enc, scaler, names, keep), labels, scaler


def train(spark: SparkSession, normalized: DataFrame, features: list[str] | None = None,
          n_trees: int = N_TREES, psi: int = TRAIN_MAX_SAMPLES,
          contamination: float = TRAIN_CONTAMINATION, seed: int = DEFAULT_SEED,
          offset_error: float | None = None) -> tuple[Model, DataFrame]:
    """Fit encoders, scaler and forest; return the model and the
    training rows scored (``anomaly``, ``anomaly_score``).

    Only ids and features are cached while the scaler and the forest are
    fitted (a lost block is recomputed from lineage); the rows with all their
    columns are scored straight from the input.  The raw scores are written
    to the shared folder: the offset and the final labels read that, so the
    scoring UDF runs once per row.  With ``offset_error`` the offset comes from
    one pass, its rank off by at most that share of the rows.
    """
    features = features or FT.SCORE_FEATURES
    enc, labels, names, keep = _encoded(normalized, features, None)
    narrow = enc.select("id", *[F.col(f"`{c}`") for c in names]).persist()
    try:
        scaler = write_table(FT.fit_scaler(narrow, names), "scaler")
        n = scaler.first()["n"]
        forest = FR.fit_forest(spark, _scaled(narrow, scaler, names, ["id"]), n_trees=n_trees, psi=psi, seed=seed,
                               n_rows=n, feature_names=features)
    finally:
        narrow.unpersist()
    raw = write_table(FR.score(_scaled(enc, scaler, names, keep), forest), "raw-scores")
    offset = FR.fit_offset(raw, contamination, n=n, error=offset_error)
    forest.offset, forest.contamination = float(offset), contamination
    scored = FR.decide(raw, offset)
    return Model(labels, scaler, forest, features), scored


def score(normalized: DataFrame, model: Model, refit_labels: bool = False,
          refit_scaler: bool = False, small_input: bool = False) -> DataFrame:
    """E1 scoring step: features with the saved model → ``anomaly`` and
    ``anomaly_score``; original columns kept, feature columns dropped.

    The features saved with the model must all be present (a model fitted
    on five features cannot score three).  ``refit_labels`` / ``refit_scaler``
    reproduce the reference, which re-sorted its dictionary and refitted
    the scaler on every scored batch.  ``small_input`` marks a micro-batch
    (see ``features.encode``).
    """
    have = set(FT.add_lengths(normalized).columns)
    missing = [c for c in model.features if c not in have]
    if missing:
        raise ValueError(f"input lacks the model's features {missing}")
    labels = model.labels
    if refit_labels:
        cats = [c for c in model.features if c in FT.string_columns(normalized)]
        labels = FT.update_labels(labels, normalized, cats, refit=True)
    if refit_scaler:
        scaler = None
    else:                                # read once per model, not once per micro-batch
        if "_stats" not in model.__dict__:
            model.__dict__["_stats"] = FT.scaler_stats(model.scaler)
        scaler = model.__dict__["_stats"]
    frame, _, _ = prepare(normalized, model.features, labels, scaler, small_input=small_input)
    raw = FR.score(frame, model.forest)
    out = FR.decide(raw, model.forest.offset)
    return out.drop(*[f"f{i}" for i in range(len(model.features))])


def suspicious(scored: DataFrame, batch: str = "batch_id") -> DataFrame:
    """A1–A3 on scored rows (one batch per ``batch`` value)."""
    return TH.adaptive_filter(scored, "anomaly_score", batch)


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    base = path.rstrip("/")
    model.labels.write.mode("overwrite").parquet(base + "/labels")
    model.scaler.write.mode("overwrite").parquet(base + "/scaler")
    FR.save_forest(spark, model.forest, base)


def load_model(spark: SparkSession, path: str) -> Model:
    base = path.rstrip("/")
    forest = FR.load_forest(spark, base)
    return Model(spark.read.parquet(base + "/labels"), spark.read.parquet(base + "/scaler"),
                 forest, list(forest.features))


def load_or_create_labels(spark: SparkSession, path: str) -> DataFrame:
    """SNK9: the saved label dictionary, or an empty one (first run)."""
    from rampart.schemas import LABELS
    from rampart.sources.files import path_exists
    if path_exists(spark, path):
        return spark.read.schema(LABELS).parquet(path)
    return spark.createDataFrame([], LABELS)


def load_or_create_scaler(spark: SparkSession, path: str) -> DataFrame | None:
    """SNK9: the saved scaler statistics, or ``None`` (fit on first use)."""
    from rampart.schemas import SCALER
    from rampart.sources.files import path_exists
    return spark.read.schema(SCALER).parquet(path) if path_exists(spark, path) else None


def encode_with_store(spark: SparkSession, df: DataFrame, columns: list[str], path: str,
                      refit: bool = False) -> DataFrame:
    """FT5/FT6 with a saved dictionary: load or start empty, add the new
    labels, save, and encode (the reference's encode-from-CSV step)."""
    base = path.rstrip("/")
    n = latest_version(spark, base)
    known = load_or_create_labels(spark, f"{base}/v{n}") if n else load_or_create_labels(spark, base + "/none")
    # a new version is a new folder, complete once its writer has committed;
    # until then readers and the next run still see the one before
    here = f"{base}/v{n + 1}"
    FT.update_labels(known, df, columns, refit=refit, materialize=False).write.mode("overwrite").parquet(here)
    return FT.encode(df, load_or_create_labels(spark, here), columns)


def latest_version(spark: SparkSession, base: str) -> int:
    """Number of the newest complete version folder, 0 if there is none."""
    from rampart.sources.files import path_exists
    n = 0
    while path_exists(spark, f"{base}/v{n + 1}/_SUCCESS"):
        n += 1
    return n
