"""Bucketed rollups, series reads and the chart joins."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import fixed_values as V
from pulsegrid.functions.scalars import time_bucket, time_literal
from pulsegrid.session import broadcast_if_small

SERIES = ("service", "metric")


def as_datetime(when: datetime | str) -> datetime:
    return datetime.fromisoformat(when) if isinstance(when, str) else when


def in_range(df: DataFrame, start: datetime | str, end: datetime | str, column: str = "timestamp") -> DataFrame:
    """Half-open range [start, end). A partitioned table also gets the date filter."""
    ts = F.col(column)
    out = df.where((ts >= time_literal(df, column, start)) & (ts < time_literal(df, column, end)))
    if "event_date" in df.columns:
        days = (as_datetime(start).date(), as_datetime(end).date())
        out = out.where(F.col("event_date").between(F.lit(days[0]), F.lit(days[1])))
    return out


def of_series(df: DataFrame, service: str, metric: str) -> DataFrame:
    return df.where((F.col("service") == service) & (F.col("metric") == metric))


def rollup(metrics: DataFrame, width: str) -> DataFrame:
    """avg, min, max and count per bucket and series; combined inside each task before the shuffle."""
    return (
        metrics.groupBy(F.window("timestamp", width).alias("w"), *SERIES)
        .agg(
            F.avg("value").alias("avg_value"), F.min("value").alias("min_value"),
            F.max("value").alias("max_value"), F.count(F.lit(1)).alias("sample_count"),
        )
        .select(F.col("w.start").alias("bucket"), *SERIES, "avg_value", "min_value", "max_value", "sample_count")
    )


def rollup_1min(metrics: DataFrame) -> DataFrame:
    return rollup(metrics, "1 minute")


def rollup_10s(
    metrics: DataFrame, service: str, metric: str, start, end, max_points: int = V.MAX_POINTS
) -> DataFrame:
    """One series in a range in 10-second buckets, earliest buckets first."""
    rows = in_range(of_series(metrics, service, metric), start, end)
    return series_points(rollup(rows, "10 seconds"), max_points)


def rebuild_rollup(metrics: DataFrame, start, end) -> DataFrame:
    """Batch rollup of a past range, for backfills that the streamed rollup ignored as too late."""
    return rollup_1min(in_range(metrics, start, end))


def series_points(points: DataFrame, max_points: int = V.MAX_POINTS) -> DataFrame:
    """The earliest ``max_points`` buckets: a long range loses its newest ones, as the reports expect."""
    return points.orderBy("bucket").limit(max_points).select(
        "bucket", "avg_value", "min_value", "max_value", "sample_count"
    )


def series_points_auto(
    metrics: DataFrame, rollup_table: DataFrame, service: str, metric: str, start, end,
    route_hours: float = V.ROLLUP_ROUTE_HOURS, max_points: int = V.MAX_POINTS,
) -> DataFrame:
    """More than ``route_hours`` reads the 1-minute rollup, otherwise raw readings in 10-second buckets."""
    span = as_datetime(end) - as_datetime(start)
    if span > timedelta(hours=route_hours):
        rows = in_range(of_series(rollup_table, service, metric), start, end, "bucket")
        return series_points(rows, max_points)
    return rollup_10s(metrics, service, metric, start, end, max_points)


def anomaly_markers(anomalies: DataFrame, service: str, metric: str, start, end) -> DataFrame:
    """All anomalies of one series in a range, oldest first, without a limit."""
    return (
        in_range(of_series(anomalies, service, metric), start, end)
        .select("timestamp", "value", "score").orderBy("timestamp")
    )


def anomalies_in_window(anomalies: DataFrame, start, end) -> DataFrame:
    return in_range(anomalies, start, end).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_anomalies"))


def annotate_buckets(points: DataFrame, anomalies: DataFrame, width: str = "1 minute", align: bool = False) -> DataFrame:
    """Attach to each bucket the anomaly whose time equals it; the last of equals wins.

    ``align`` buckets the anomaly time first, so that anomalies off the bucket boundary show too.
    """
    at = time_bucket("timestamp", width) if align else F.col("timestamp")
    newest = F.struct("timestamp", "anomaly_id")
    marks = (
        anomalies.select(*SERIES, at.alias("bucket"), "timestamp", "anomaly_id", "value", "score")
        .groupBy(*SERIES, "bucket")
        .agg(
            F.max_by("value", newest).alias("anomaly_value"),
            F.max_by("score", newest).alias("anomaly_score"),
        )
    )
    return points.join(marks, [*SERIES, "bucket"], "left")


def out_of_range_readings(
    metrics: DataFrame, as_of, max_days: int = V.MAX_WINDOW_DAYS,
    default_hours: int = V.DEFAULT_WINDOW_HOURS, slack_seconds: int = V.FUTURE_SLACK_SECONDS,
) -> DataFrame:
    """Readings from the future, older than the window, and inside the default look-back, per series."""
    now = as_datetime(as_of)
    ts = F.col("timestamp")

    def at(delta: timedelta) -> Column:
        return time_literal(metrics, "timestamp", now + delta)

    return metrics.groupBy(*SERIES).agg(
        F.count_if(ts > at(timedelta(seconds=slack_seconds))).alias("n_future"),
        F.count_if(ts < at(-timedelta(days=max_days))).alias("n_too_old"),
        F.count_if((ts >= at(-timedelta(hours=default_hours))) & (ts < at(timedelta(0)))).alias("n_default_window"),
        F.count(F.lit(1)).alias("n_total"),
    )


def relative_window(df: DataFrame, preset: str, as_of, column: str = "timestamp") -> DataFrame:
    """Rows of a look-back preset ending at ``as_of``."""
    if preset not in V.WINDOW_PRESETS:
        raise ValueError(f"window must be one of {sorted(V.WINDOW_PRESETS)}")
    end = as_datetime(as_of)
    return in_range(df, end - timedelta(hours=V.WINDOW_PRESETS[preset]), end, column)


def seasonal_profile(metrics: DataFrame) -> DataFrame:
    """How a series moves over the day and the week: its mean (part ``all``) and, by hour and by weekday
    (0 is Monday), the mean of those readings over the mean of all.

    Readings are summed per hour of the week first, at most 168 rows a series.
    """
    hour, weekday = F.hour("timestamp"), F.weekday("timestamp")
    cells = metrics.groupBy("service", "metric", hour.alias("hour"), weekday.alias("weekday")).agg(
        F.sum("value").alias("total"), F.count("value").alias("n")
    )
    parts = F.array(
        F.struct(F.lit("all").alias("part"), F.lit(0).alias("step")),
        F.struct(F.lit("hour").alias("part"), F.col("hour").alias("step")),
        F.struct(F.lit("weekday").alias("part"), F.col("weekday").alias("step")),
    )
    means = cells.withColumn("p", F.explode(parts)).groupBy("service", "metric", "p.part", "p.step").agg(
        (F.sum("total") / F.sum("n")).alias("mean")
    )
    whole = F.max(F.when(F.col("part") == "all", F.col("mean"))).over(Window.partitionBy("service", "metric"))
    factor = F.when(F.col("part") == "all", F.col("mean")).otherwise(F.col("mean") / F.nullif("whole", F.lit(0.0)))
    return means.withColumn("whole", whole).select("service", "metric", "part", "step", factor.alias("factor"))


def expected_baseline(metrics: DataFrame, profile: DataFrame) -> DataFrame:
    """Readings with what their series usually shows at that hour and weekday (``baseline``)."""
    profile = broadcast_if_small(profile)
    out = metrics.withColumns({"_all": F.lit(0), "_hour": F.hour("timestamp"), "_weekday": F.weekday("timestamp")})
    for part in ("all", "hour", "weekday"):
        one = profile.where(F.col("part") == part).select("service", "metric", F.col("step").alias(f"_{part}"), F.col("factor").alias(f"_f_{part}"))
        out = out.join(one, ["service", "metric", f"_{part}"], "left")
    baseline = F.col("_f_all") * F.coalesce("_f_hour", F.lit(1.0)) * F.coalesce("_f_weekday", F.lit(1.0))
    return out.withColumn("baseline", baseline).select(*metrics.columns, "baseline")
