"""Scheduled perturbations and ground truth.

The schedule becomes one array of windows per series. A reading finds its window inside that array,
so readings are joined on (service, metric) once and never multiplied.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import micros, perturb, shift_seconds
from pulsegrid.operators.evaluation import confusion_scores
from pulsegrid.session import broadcast_if_small

SERIES = ("service", "metric")


def offset_to_window(schedule: DataFrame, sim_start: datetime | str, like: str = "timestamp") -> DataFrame:
    """Offsets to absolute windows; minutes win over hours, and a row with neither is an error."""
    seconds = F.coalesce(F.col("duration_minutes") * 60.0, F.col("duration_hours") * 3600.0)
    message = F.concat(F.lit("no duration for "), F.col("service"), F.lit("/"), F.col("metric"))
    checked = F.when(seconds.isNull(), F.raise_error(message).cast("double")).otherwise(seconds)
    origin = F.lit(str(sim_start)).cast(like)
    return (
        schedule.withColumn("duration_seconds", checked)
        .withColumn("start", shift_seconds(origin, F.col("start_offset_hours") * 3600.0))
        .withColumn("end", shift_seconds(F.col("start"), F.col("duration_seconds")))
        .select("spec_idx", *SERIES, "anomaly_type", "start", "end", "duration_seconds", "magnitude")
    )


def ground_truth_windows(windows: DataFrame) -> DataFrame:
    return windows.select(*SERIES, "anomaly_type", "start", "end", "duration_seconds", "magnitude")


def _per_series(windows: DataFrame) -> DataFrame:
    spec = F.struct(
        "spec_idx", micros("start").alias("start_us"), micros("end").alias("end_us"), "anomaly_type", "magnitude"
    )
    # A series has as many windows as somebody scheduled for it, whatever the volume of readings.
    grouped = windows.groupBy(*SERIES).agg(F.sort_array(F.collect_list(spec)).alias("specs"))
    return broadcast_if_small(grouped)


def _covers(spec: Column, ts: Column) -> Column:
    return (spec["start_us"] <= micros(ts)) & (micros(ts) < spec["end_us"])


def apply_anomaly_schedule(metrics: DataFrame, windows: DataFrame) -> DataFrame:
    """Perturb each reading by the first schedule row that covers it; other readings stay as they are."""
    ts = F.col("timestamp")
    first = F.get(F.filter("specs", lambda s: _covers(s, ts)), F.lit(0))
    joined = metrics.join(_per_series(windows), list(SERIES), "left").withColumn("spec", first)
    hit = F.col("spec").isNotNull()
    return (
        joined.withColumn("base_value", F.col("value"))
        .withColumn("value", F.when(hit, perturb(F.col("value"), ts, F.col("spec"))).otherwise(F.col("value")))
        .withColumn("spec_idx", F.col("spec.spec_idx"))
        .withColumn("is_anomalous", hit)
        .drop("specs", "spec")
    )


def injected_count(perturbed: DataFrame) -> DataFrame:
    return perturbed.groupBy(*SERIES).agg(F.count_if("is_anomalous").alias("n_injected"), F.count(F.lit(1)).alias("n"))


def label_by_truth(metrics: DataFrame, windows: DataFrame) -> DataFrame:
    """``truth`` = 1 inside any scheduled window of the series."""
    ts = F.col("timestamp")
    inside = F.coalesce(F.exists("specs", lambda s: _covers(s, ts)), F.lit(False))
    return (
        metrics.join(_per_series(windows), list(SERIES), "left")
        .withColumn("truth", F.when(inside, 1).otherwise(0)).drop("specs")
    )


def score_against_truth(readings: DataFrame, windows: DataFrame, flag: str) -> DataFrame:
    """Detections (boolean column ``flag``) against the scheduled windows, per series."""
    labelled = label_by_truth(readings, windows)
    return confusion_scores(labelled.withColumn("predicted", F.when(F.col(flag), 1).otherwise(0)))
