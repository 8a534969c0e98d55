"""The training job: all series at once, from history to registered models."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import fixed_values as V
from pulsegrid.functions.scalars import deterministic_id, time_literal
from pulsegrid.operators.evaluation import chrono_split, evaluate_predictions, inject_anomalies, n_train
from pulsegrid.operators.registry import register
from pulsegrid.operators.rollup import as_datetime, in_range
from pulsegrid.operators.scoring import fit_isolation_forest, pin_surfaces, score_events, surface_offsets
from pulsegrid.operators.selection import GroupSizes
from pulsegrid.session import broadcast_if_small

SERIES = ("service", "metric")


@dataclass(frozen=True)
class Split:
    """Readings of the training window in two parts, with the rows per series of each part."""

    rows: DataFrame
    train_sizes: GroupSizes
    holdout_sizes: GroupSizes

    @property
    def train(self) -> DataFrame:
        return self.rows.where(F.col("part") == "train")

    @property
    def holdout(self) -> DataFrame:
        return self.rows.where(F.col("part") == "holdout")


@dataclass(frozen=True)
class TrainingRun:
    """Rows one run appends: registry versions, pointer events and score surfaces."""

    versions: DataFrame
    pointers: DataFrame
    surfaces: DataFrame
    evaluation: DataFrame


def split_window(
    metrics: DataFrame, as_of: datetime | str, days: int = V.TRAINING_DAYS, min_samples: int = V.MIN_SAMPLES
) -> Split:
    """Training window of the series with enough rows. The series are counted once for all later steps."""
    end = as_datetime(as_of)
    rows = in_range(metrics, end - timedelta(days=days), end).select("event_id", *SERIES, "timestamp", "value")
    sizes = GroupSizes.of(rows, SERIES).at_least(min_samples)
    n = F.col("n")
    return Split(chrono_split(rows, sizes=sizes), sizes.part(n_train(n)), sizes.part(n - n_train(n)))


def fit_models(split: Split, as_of: datetime | str) -> DataFrame:
    """Surfaces with offset for every series of a split window."""
    model_id = deterministic_id("model", *SERIES, F.lit(str(as_of)))
    fitted = fit_isolation_forest(split.train, sizes=split.train_sizes)
    raw = pin_surfaces(fitted.withColumn("model_id", model_id))
    ids = broadcast_if_small(raw.select(*SERIES, "model_id"))
    offsets = surface_offsets(split.train.join(ids, list(SERIES)), raw)
    return raw.join(broadcast_if_small(offsets), "model_id")


def evaluate_holdout(split: Split, surfaces: DataFrame, seed: int = V.FOREST_SEED) -> DataFrame:
    """Injected holdout rows scored by the fresh models."""
    holdout = inject_anomalies(split.holdout, seed, sizes=split.holdout_sizes)
    ids = broadcast_if_small(surfaces.select(*SERIES, "model_id"))
    return evaluate_predictions(score_events(holdout.join(ids, list(SERIES)), surfaces))


def train_all(
    metrics: DataFrame, as_of: datetime | str, days: int = V.TRAINING_DAYS, seq: int = 0
) -> TrainingRun:
    """Window, gate, split, fit, evaluate, register. A window without enough data gives an empty run."""
    split = split_window(metrics, as_of, days)
    if split.train_sizes.is_empty():
        return _empty_run(metrics)
    surfaces = fit_models(split, as_of)
    # One row per series each, computed once: the run's outcome is read again by whoever stores it.
    evaluation = broadcast_if_small(evaluate_holdout(split, surfaces))
    end = time_literal(metrics, "timestamp", as_of)
    start = time_literal(metrics, "timestamp", as_datetime(as_of) - timedelta(days=days))
    path = F.concat_ws("/", F.lit("models"), "service", "metric", "model_id")

    def scored(name: str):
        return F.coalesce(name, F.lit(-1.0)).alias(f"eval_{name}")

    versions = (
        surfaces.select("model_id", *SERIES, "fit_seconds")
        .join(split.train_sizes.table.withColumnRenamed("n", "n_samples"), list(SERIES))
        .join(evaluation, list(SERIES), "left")
        .select(
            "model_id", *SERIES, F.lit("isolation_forest").alias("algorithm"), end.alias("trained_at"),
            start.alias("window_start"), end.alias("window_end"), "n_samples", "fit_seconds",
            scored("precision"), scored("recall"), scored("f1"), path.alias("artifact_path"),
        )
    )
    surfaces = surfaces.select("model_id", *SERIES, "edges", "scores", "offset")
    return TrainingRun(versions, register(versions, seq), surfaces, evaluation)


def _empty_run(metrics: DataFrame) -> TrainingRun:
    spark, like = metrics.sparkSession, metrics.schema["timestamp"].dataType.simpleString()
    versions = spark.createDataFrame(
        [],
        "model_id string, service string, metric string, algorithm string, "
        f"trained_at {like}, window_start {like}, window_end {like}, n_samples bigint, fit_seconds double, "
        "eval_precision double, eval_recall double, eval_f1 double, artifact_path string",
    )
    surfaces = spark.createDataFrame(
        [], "model_id string, service string, metric string, edges array<double>, scores array<double>, offset double"
    )
    evaluation = spark.createDataFrame(
        [], "service string, metric string, tp bigint, fp bigint, fn bigint, precision double, recall double, f1 double"
    )
    return TrainingRun(versions, register(versions), surfaces, evaluation)
