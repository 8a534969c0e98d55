"""Split, gate, injection and holdout scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import fixed_values as V
from pulsegrid.functions.scalars import hash60, micros, predict, remap_prediction, time_literal
from pulsegrid.operators.rollup import in_range, of_series
from pulsegrid.operators.selection import GroupSizes, mark_first_k

SERIES = ("service", "metric")


def load_series(metrics: DataFrame, service: str, metric: str, start, end) -> DataFrame:
    """Training frame of one series in [start, end), oldest first; no rows give an empty frame."""
    rows = in_range(of_series(metrics, service, metric), start, end)
    return rows.select("timestamp", F.col("value").cast("double").alias("value")).orderBy("timestamp")


def discover_pairs(metrics: DataFrame, since) -> DataFrame:
    recent = metrics.where(F.col("timestamp") >= time_literal(metrics, "timestamp", since))
    return recent.select(*SERIES).distinct().orderBy(*SERIES)


def min_sample_gate(metrics: DataFrame, min_samples: int = V.MIN_SAMPLES) -> DataFrame:
    """Only rows of series with at least ``min_samples`` rows."""
    sizes = GroupSizes.of(metrics, SERIES).at_least(min_samples)
    return metrics.join(sizes.table.select(*SERIES), list(SERIES), "left_semi")


def _order(text: str) -> list[Column]:
    """By the md5 of a text, in two halves."""
    return [hash60(text), hash60(text, 15)]


def n_train(n: Column, holdout: float = V.HOLDOUT_FRACTION) -> Column:
    return F.ceil(n * F.lit(1.0 - holdout))


def chrono_split(
    metrics: DataFrame, holdout: float = V.HOLDOUT_FRACTION, sizes: GroupSizes | None = None,
    direct_rows: int | None = None,
) -> DataFrame:
    """``part`` = train for the first ceil(n * (1 - holdout)) rows of a series by time, else holdout.

    Equal times are ordered by the md5 of the event id.
    """
    order = [micros("timestamp"), *_order("event_id")]
    marked = mark_first_k(metrics, SERIES, order, lambda n: n_train(n, holdout), "_train", sizes, direct_rows)
    return marked.withColumn("part", F.when(F.col("_train"), "train").otherwise("holdout")).drop("_train")


def sample_rows(
    df: DataFrame, seed: int, fraction: float = V.INJECT_FRACTION, flag: str = "sampled",
    sizes: GroupSizes | None = None, direct_rows: int | None = None,
) -> DataFrame:
    """Flag max(1, floor(n * fraction)) rows per series, in md5 order of seed and event id."""
    keyed = df.withColumn("_key", F.concat_ws(":", F.lit(str(seed)), "event_id"))
    marked = mark_first_k(
        keyed, SERIES, _order("_key"), lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(fraction))), flag, sizes, direct_rows
    )
    return marked.drop("_key")


def inject_anomalies(
    df: DataFrame, seed: int, fraction: float = V.INJECT_FRACTION, sizes: GroupSizes | None = None
) -> DataFrame:
    """Multiply the sampled rows by a factor in [5, 10); ``truth`` marks them. The input is unchanged."""
    share = hash60(F.concat_ws(":", F.lit("factor"), F.lit(str(seed)), F.col("event_id"))) / F.lit(float(2**60))
    factor = F.lit(V.SPIKE_LOW) + F.lit(V.SPIKE_HIGH - V.SPIKE_LOW) * share
    return (
        sample_rows(df, seed, fraction, "_hit", sizes)
        .withColumn("value", F.when(F.col("_hit"), F.col("value") * factor).otherwise(F.col("value")))
        .withColumn("truth", F.when(F.col("_hit"), 1).otherwise(0))
        .drop("_hit")
    )


def confusion_scores(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Precision, recall and F1 from 0/1 columns ``truth`` and ``predicted``.

    A zero denominator gives 0; a group without positives gives -1 everywhere (not evaluated).
    """
    truth, predicted = F.col("truth") == 1, F.col("predicted") == 1
    counts = df.groupBy(*keys).agg(
        F.count_if(truth & predicted).alias("tp"),
        F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"),
    )
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))

    def guarded(top: Column, bottom: Column) -> Column:
        ratio = F.when(bottom == 0, 0.0).otherwise(top / F.when(bottom != 0, bottom))
        return F.when(tp + fn == 0, -1.0).otherwise(ratio)

    return counts.withColumns(
        {
            "precision": guarded(tp, tp + fp),
            "recall": guarded(tp, tp + fn),
            "f1": guarded(2 * tp, 2 * tp + fp + fn),
        }
    )


def evaluate_predictions(scored: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Holdout scores from decision scores and ``truth``."""
    return confusion_scores(scored.withColumn("predicted", remap_prediction(predict("score"))), keys)
