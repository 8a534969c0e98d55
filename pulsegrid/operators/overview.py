"""Reports over services and incidents. Every side is reduced before it is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import fixed_values as V
from pulsegrid.functions.scalars import health_status
from pulsegrid.session import broadcast_if_small


def optional_filter(df: DataFrame, column: str, value) -> DataFrame:
    """No value means no filter; the plan then has none."""
    return df if value is None else df.where(F.col(column) == value)


def open_incident_counts(incidents: DataFrame) -> DataFrame:
    opened = incidents.where(F.col("status") == "open")
    return opened.groupBy("service").agg(F.count(F.lit(1)).alias("open_incidents"))


def last_anomaly_at(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("service").agg(F.max("timestamp").alias("last_anomaly_at"))


def service_overview(metrics: DataFrame, incidents: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row per known service: open incidents, last anomaly and health."""
    services = metrics.select("service").distinct()
    n = F.coalesce("open_incidents", F.lit(0))
    return (
        services.join(open_incident_counts(incidents), "service", "left")
        .join(last_anomaly_at(anomalies), "service", "left")
        .select("service", n.alias("open_incidents"), "last_anomaly_at", health_status(n).alias("health"))
        .orderBy("service")
    )


def incident_anomaly_count(incidents: DataFrame, members: DataFrame) -> DataFrame:
    """Incidents with their number of anomalies, 0 for an empty one."""
    counts = members.groupBy("incident_id").agg(F.count("anomaly_id").alias("anomaly_count"))
    return incidents.join(counts, "incident_id", "left").withColumn(
        "anomaly_count", F.coalesce("anomaly_count", F.lit(0))
    )


def incident_page(
    incidents: DataFrame, status: str | None = None, limit: int = V.FEED_LIMIT, offset: int = 0
) -> DataFrame:
    """Newest first; incident_id orders equal starts."""
    if status is not None and status not in V.STATUSES:
        raise ValueError(f"no incidents can have status {status!r}; ask for None or one of {', '.join(V.STATUSES)}")
    if not 1 <= limit <= V.FEED_LIMIT_MAX or offset < 0:
        raise ValueError(f"limit must be 1..{V.FEED_LIMIT_MAX} and offset must not be negative")
    rows = optional_filter(incidents, "status", status)
    return rows.orderBy(F.desc("started_at"), "incident_id").offset(offset).limit(limit)


def incident_feed(
    incidents: DataFrame, members: DataFrame, status: str | None = None,
    limit: int = V.FEED_LIMIT, offset: int = 0,
) -> DataFrame:
    """A page of incidents with anomaly counts. The page is cut first, so only its members are counted."""
    page = broadcast_if_small(incident_page(incidents, status, limit, offset))
    hits = members.join(page.select("incident_id"), "incident_id", "left_semi")
    return incident_anomaly_count(page, hits).orderBy(F.desc("started_at"), "incident_id")


def recent_open_incidents(incidents: DataFrame, members: DataFrame) -> DataFrame:
    """First ten of the open feed."""
    return incident_feed(incidents, members, "open").limit(V.RECENT_OPEN)


def service_open_incidents(
    incidents: DataFrame, members: DataFrame, service: str, filter_first: bool = False
) -> DataFrame:
    """Open incidents of one service.

    By default the service is filtered after the page was cut, as the report does; ``filter_first``
    pages the service itself.
    """
    if filter_first:
        return incident_feed(optional_filter(incidents, "service", service), members, "open")
    return incident_feed(incidents, members, "open").where(F.col("service") == service)
