"""Small inputs shared by the tests."""

from __future__ import annotations

from datetime import datetime, timedelta

BASE = datetime(2025, 1, 15, 12, 0, 0)


def anomalies(spark, minutes, service="payment-api", metric="cpu_percent", seconds=False):
    step = (lambda m: timedelta(seconds=m)) if seconds else (lambda m: timedelta(minutes=m))
    rows = [
        (f"{service}-{metric}-{i}", f"e-{service}-{metric}-{i}", BASE + step(m), service, metric, 500.0, -0.3, 0.0, "model-1", "open")
        for i, m in enumerate(minutes)
    ]
    return spark.createDataFrame(
        rows,
        "anomaly_id string, event_id string, timestamp timestamp, service string, metric string, "
        "value double, score double, threshold double, model_id string, status string",
    )


def readings(spark, values, service="s", metric="m", start=BASE, step=60):
    rows = [
        (f"{service}-{metric}-{i}", service, metric, float(v), start + timedelta(seconds=step * i)) for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "event_id string, service string, metric string, value double, timestamp timestamp")


def no_members(spark):
    return spark.createDataFrame([], "anomaly_id string, incident_id string")


def no_fired(spark):
    return spark.createDataFrame([], "service string, metric string, last_fired timestamp")
