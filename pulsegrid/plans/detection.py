"""Readings to anomalies to incidents to the overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import fixed_values as V
from pulsegrid.functions.scalars import deterministic_id
from pulsegrid.operators.incidents import group_incidents
from pulsegrid.operators.overview import service_overview
from pulsegrid.operators.registry import current_models
from pulsegrid.operators.scoring import LoadedSurfaces, attach_current_model, score_anomalies
from pulsegrid.plans.training import train_all
from pulsegrid.session import cut_lineage


def detect(
    events: DataFrame, current: DataFrame, surfaces: DataFrame, threshold: float = V.ANOMALY_THRESHOLD,
    loaded: LoadedSurfaces | None = None, max_edges: int | None = None,
) -> DataFrame:
    """Anomaly rows of the readings that have a current model."""
    return as_anomalies(score_anomalies(attach_current_model(events, current), surfaces, threshold, loaded, max_edges))


def as_anomalies(kept: DataFrame) -> DataFrame:
    return kept.select(
        deterministic_id("anomaly", "event_id").alias("anomaly_id"), "event_id", "timestamp",
        "service", "metric", "value", "score", "threshold", "model_id", F.lit("open").alias("status"),
    )


def history_to_overview(metrics: DataFrame, as_of: str) -> DataFrame:
    """Train on the window, score it, group what is anomalous and report the health of each service."""
    run = train_all(metrics, as_of)
    # Grouping and the overview both read the anomalies, a few per cent of the readings: store them once.
    anomalies = cut_lineage(detect(metrics, current_models(run.pointers), run.surfaces))
    incidents = group_incidents(anomalies)
    return service_overview(metrics, incidents, anomalies)
