"""Explicit schemas of the stored tables and of the wire form of an event."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, TS, B = (
    T.StringType(),
    T.DoubleType(),
    T.IntegerType(),
    T.LongType(),
    T.TimestampType(),
    T.BooleanType(),
)


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in fields])


LABELS = T.MapType(S, S)

METRIC_EVENT = _table(
    ("event_id", S, False), ("service", S, False), ("metric", S, False),
    ("value", D, False), ("timestamp", TS, False), ("labels", LABELS, False),
)

# Most fields arrive as text and are cast afterwards: a quoted number is accepted,
# and a bad one is rejected with a reason instead of silently becoming NULL.
# The names keep their JSON type, as a number or an object is no name.
WIRE_EVENT = _table(
    ("event_id", S, True), ("service", T.VariantType(), True), ("metric", T.VariantType(), True),
    ("value", S, True), ("timestamp", S, True), ("labels", S, True), ("_corrupt", S, True),
)

ANOMALY = _table(
    ("anomaly_id", S, False), ("event_id", S, False), ("timestamp", TS, False),
    ("service", S, False), ("metric", S, False), ("value", D, False),
    ("score", D, False), ("threshold", D, False), ("model_id", S, False), ("status", S, False),
)

INCIDENT = _table(
    ("incident_id", S, False), ("service", S, False), ("metric", S, False),
    ("status", S, False), ("started_at", TS, False), ("resolved_at", TS, True),
)

INCIDENT_MEMBER = _table(("anomaly_id", S, False), ("incident_id", S, False))

INCIDENT_STATUS_EVENT = _table(
    ("incident_id", S, False), ("status", S, False), ("event_ts", TS, False), ("seq", L, False),
)

MODEL_VERSION = _table(
    ("model_id", S, False), ("service", S, False), ("metric", S, False), ("algorithm", S, False),
    ("trained_at", TS, False), ("window_start", TS, False), ("window_end", TS, False),
    ("n_samples", L, False), ("fit_seconds", D, False),
    ("eval_precision", D, False), ("eval_recall", D, False), ("eval_f1", D, False),
    ("artifact_path", S, False),
)

POINTER_EVENT = _table(
    ("service", S, False), ("metric", S, False), ("model_id", S, False),
    ("kind", S, False), ("event_ts", TS, False), ("seq", L, False),
)

SCORE_SURFACE = _table(
    ("model_id", S, False), ("service", S, False), ("metric", S, False),
    ("edges", T.ArrayType(D), False), ("scores", T.ArrayType(D), False), ("offset", D, False),
)

SCHEDULE = _table(
    ("spec_idx", I, False), ("service", S, False), ("metric", S, False), ("anomaly_type", S, False),
    ("start_offset_hours", D, False), ("duration_minutes", D, True), ("duration_hours", D, True),
    ("magnitude", D, False),
)
