"""Scalar column functions. All of them stay inside the JVM."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import fixed_values as V

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- time ---------------------------------------------------------------------------------------


def time_literal(df: DataFrame, column: str, when: datetime | str) -> Column:
    """Literal of the column's own time type, so that a comparison with it reaches the file scan."""
    text = when if isinstance(when, str) else when.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast(df.schema[column].dataType)


def time_bucket(ts: ColumnOrName, width: str) -> Column:
    """Start of the tumbling bucket that holds ``ts``."""
    return F.window(ts, width)["start"]


def micros(ts: ColumnOrName) -> Column:
    """Microseconds since the epoch, for either timestamp type."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def from_micros(us: Column, like) -> Column:
    """Inverse of ``micros``; ``like`` is the wanted timestamp type."""
    return F.timestamp_micros(us).cast(like)


def shift_seconds(ts: Column, seconds: Column) -> Column:
    """``ts`` plus a number of seconds that may have a fraction."""
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def parse_iso_utc(text: ColumnOrName) -> Column:
    """ISO-8601 text to a timestamp. No offset means UTC (the session zone); bad text gives NULL.

    A number alone is not ISO-8601, and neither is a bare year or a time without a date.
    """
    raw = F.trim(_c(text))
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|z|[+-]\d{2}(:?\d{2})?)?)?$"
    return F.when(raw.rlike(shape), F.try_to_timestamp(F.regexp_replace(raw, ",", ".")))


def parse_event_time(text: ColumnOrName) -> Column:
    """Event time on the wire: ISO-8601, or a number of seconds (milliseconds beyond 2e10)."""
    raw = F.trim(_c(text))
    number = F.when(raw.rlike(r"^-?\d+(\.\d+)?$"), raw.try_cast("double"))
    seconds = F.when(F.abs(number) > 2e10, number / 1000).otherwise(number)
    return F.coalesce(parse_iso_utc(raw), F.timestamp_micros(F.round(seconds * 1e6).try_cast("bigint")))


# --- ids and hashes -----------------------------------------------------------------------------


def deterministic_id(kind: str, *parts: ColumnOrName) -> Column:
    """Id of natural keys: a retried write produces the same id again."""
    return F.md5(F.concat_ws(":", F.lit(kind), *[_c(p).cast("string") for p in parts]))


def hash60(text: ColumnOrName, offset: int = 0) -> Column:
    """60 bits of the md5 of ``text`` as a non-negative number, from hex digit ``offset`` on."""
    return F.conv(F.substring(F.md5(_c(text)), offset + 1, 15), 16, 10).cast("bigint")


def labels_to_map(text: ColumnOrName) -> Column:
    """JSON object to map; no labels means an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(_c(text), "map<string,string>"), empty)


def labels_to_json(labels: ColumnOrName) -> Column:
    return F.to_json(_c(labels))


# --- predicates and tiers -----------------------------------------------------------------------


def is_anomaly(score: ColumnOrName, threshold: ColumnOrName | float) -> Column:
    """Strictly below the threshold; a score equal to it is normal."""
    limit = _c(threshold) if isinstance(threshold, (str, Column)) else F.lit(float(threshold))
    return _c(score) < limit


def resolved_flag(status: ColumnOrName) -> Column:
    return _c(status) != "open"


def health_status(open_incidents: ColumnOrName) -> Column:
    n = _c(open_incidents)
    return F.when(n == 0, "healthy").when(n <= 2, "degraded").otherwise("critical")


def score_tier(score: ColumnOrName) -> Column:
    s = _c(score)
    return F.when(s < 0, "not evaluated").when(s >= 0.8, "good").when(s >= 0.6, "fair").otherwise("poor")


def predict(score: ColumnOrName) -> Column:
    """Decision score to -1 (anomaly) or +1 (normal)."""
    return F.when(_c(score) < 0, -1).otherwise(1)


def remap_prediction(prediction: ColumnOrName) -> Column:
    """-1 becomes 1 (anomaly), +1 becomes 0 (normal)."""
    return F.when(_c(prediction) == -1, 1).otherwise(0)


# --- signal model -------------------------------------------------------------------------------


def perturb(value: Column, ts: Column, spec: Column) -> Column:
    """Value changed by one schedule row (a struct with anomaly_type, start_us, end_us, magnitude)."""
    m = spec["magnitude"]
    span = spec["end_us"] - spec["start_us"]
    progress = F.when(span > 0, (micros(ts) - spec["start_us"]) / span).otherwise(F.lit(1.0))
    kind = spec["anomaly_type"]
    changed = (
        F.when(kind == "spike", value * m)
        .when(kind == "dip", value * (F.lit(1.0) - m))
        .when(kind == "level_shift", value + m)
        .when(kind == "gradual_drift", value + m * progress)
    )
    return F.round(changed, 4)
