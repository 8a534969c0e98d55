"""Sessionise anomalies into incidents, suppress repeats, link and resolve.

Incidents of one series start more than the grouping gap apart, so a series has at most
time span / gap of them however many anomalies it has. All per-series ordering below runs on such
bounded rows, never on the anomalies themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import fixed_values as V
from pulsegrid.functions.scalars import deterministic_id, from_micros, micros, time_literal
from pulsegrid.operators.selection import number_rows
from pulsegrid.session import broadcast_if_small

SERIES = ("service", "metric")


def _slot(gap_seconds: int) -> Column:
    return F.floor(micros("timestamp") / F.lit(gap_seconds * 1_000_000)).cast("bigint")


def session_slots(anomalies: DataFrame, gap_seconds: int = V.GROUPING_SECONDS) -> DataFrame:
    """Occupied time slots of width ``gap`` with the incident each belongs to.

    Two anomalies in one slot are less than the gap apart and so in one session. Slots are counted
    inside each task first; only the slots, one row each, are ordered per series. A gap equal to
    the limit still joins, and it is measured from the previous anomaly.
    """
    return join_slots(slot_counts(anomalies, gap_seconds), gap_seconds)


def slot_counts(anomalies: DataFrame, gap_seconds: int) -> DataFrame:
    """First and last time and number of anomalies per slot; counts of parts of a table can be merged."""
    return anomalies.groupBy(*SERIES, _slot(gap_seconds).alias("slot")).agg(
        F.min(micros("timestamp")).alias("first_us"),
        F.max(micros("timestamp")).alias("last_us"),
        F.count(F.lit(1)).alias("n"),
    )


def join_slots(slots: DataFrame, gap_seconds: int) -> DataFrame:
    """Slots with the start and id of the session each belongs to."""
    gap_us = gap_seconds * 1_000_000
    ordered = Window.partitionBy(*SERIES).orderBy("slot")
    previous = F.lag("last_us").over(ordered)
    opens = previous.isNull() | (F.col("first_us") - previous > gap_us)
    # Starts grow with time, so the latest start so far is the start of the session.
    started = F.max(F.when(F.col("opens"), F.col("first_us"))).over(ordered)
    return (
        slots.withColumn("opens", opens)
        .withColumn("started_us", started)
        .withColumn("incident_id", deterministic_id("incident", *SERIES, "started_us"))
        .drop("opens")
    )


def _incidents(slots: DataFrame, like) -> DataFrame:
    return (
        slots.groupBy(*SERIES, "incident_id", "started_us")
        .agg(F.sum("n").alias("n_anomalies"), F.max("last_us").alias("last_us"))
        .select(
            "incident_id", *SERIES, F.lit("open").alias("status"),
            from_micros(F.col("started_us"), like).alias("started_at"),
            from_micros(F.col("last_us"), like).alias("last_at"), "n_anomalies",
        )
    )


def group_incidents(anomalies: DataFrame, gap_seconds: int = V.GROUPING_SECONDS) -> DataFrame:
    """Incidents of all anomalies."""
    return _incidents(session_slots(anomalies, gap_seconds), anomalies.schema["timestamp"].dataType)


def incident_members(anomalies: DataFrame, gap_seconds: int = V.GROUPING_SECONDS) -> DataFrame:
    """(anomaly_id, incident_id) of all anomalies: an equi join on the slot.

    Slots that were counted and are few are broadcast, so the anomalies do not move; otherwise the
    join shuffles and a slot with very many anomalies is split.
    """
    slots = broadcast_if_small(session_slots(anomalies, gap_seconds).select(*SERIES, "slot", "incident_id"))
    keyed = anomalies.select("anomaly_id", *SERIES, "timestamp", _slot(gap_seconds).alias("slot"))
    return keyed.join(slots, [*SERIES, "slot"]).select("anomaly_id", "incident_id")


def incident_members_agg(anomalies: DataFrame, members: DataFrame) -> DataFrame:
    """Members per incident, first and last member and the start."""
    first = F.struct("timestamp", "anomaly_id")
    return (
        members.join(anomalies.select("anomaly_id", "timestamp"), "anomaly_id")
        .groupBy("incident_id")
        .agg(
            F.count(F.lit(1)).alias("n_members"), F.min("timestamp").alias("started_at"),
            F.min(first).alias("a"), F.max(first).alias("b"),
        )
        .select(
            "incident_id", "n_members", "started_at",
            F.col("a.anomaly_id").alias("first_anomaly_id"), F.col("b.anomaly_id").alias("last_anomaly_id"),
        )
    )


def incident_member_list(anomalies: DataFrame, members: DataFrame) -> DataFrame:
    """Ordered member ids of every incident as numbered rows.

    One array per incident would gather a huge incident in one task; the numbers carry the order.
    """
    rows = members.join(anomalies.select("anomaly_id", "timestamp"), "anomaly_id")
    return number_rows(rows, ["incident_id"], ["timestamp", "anomaly_id"], "member_no")


def ungrouped_anomalies(anomalies: DataFrame, members: DataFrame) -> DataFrame:
    """Anomalies that belong to no incident yet."""
    return anomalies.join(members.select("anomaly_id"), "anomaly_id", "left_anti")


def fresh_ungrouped(
    anomalies: DataFrame, members: DataFrame, as_of: datetime | str, service: str, metric: str,
    max_age_seconds: int = V.FRESH_SECONDS,
) -> DataFrame:
    """Drop the ungrouped anomalies of one series that are older than the age; keep everything else."""
    limit = time_literal(anomalies, "timestamp", as_of) - F.make_dt_interval(secs=F.lit(max_age_seconds))
    stale = (F.col("service") == service) & (F.col("metric") == metric) & (F.col("timestamp") < limit)
    return ungrouped_anomalies(anomalies, members).where(~stale)


def link_members(anomalies: DataFrame, members: DataFrame) -> DataFrame:
    """Anomalies with their incident id, NULL while ungrouped."""
    return anomalies.join(members, "anomaly_id", "left")


def incident_of_event(events: DataFrame, anomalies: DataFrame, members: DataFrame, incidents: DataFrame) -> DataFrame:
    """Event to anomaly to incident; events without an incident drop out."""
    return (
        events.select("event_id")
        .join(anomalies.select("event_id", "anomaly_id", "score"), "event_id")
        .join(members, "anomaly_id")
        .join(incidents.select("incident_id", "status", "started_at"), "incident_id")
        .select("event_id", "anomaly_id", "incident_id", "status", "started_at", "score")
    )


def suppress_cooldown(incidents: DataFrame, cooldown_seconds: int) -> DataFrame:
    """Event-time replay of suppression: an incident fires unless one fired less than the cooldown ago.

    Exactly at the cooldown it fires. The starts of a series, at most time span / grouping gap, pass
    through their task in order as a stream of batches; only the last firing is kept between them,
    and the next one is found by binary search.
    """
    like = incidents.schema["started_at"].dataType
    wait = cooldown_seconds * 1_000_000

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, last = None, None
        for batch in batches:
            us = batch.column("us").to_numpy()
            names = list(zip(*(batch.column(c).to_pylist() for c in SERIES), strict=True))
            starts = [n for n in range(len(names)) if n == 0 or names[n] != names[n - 1]]
            fired = []
            for start, end in zip(starts, [*starts[1:], len(names)], strict=True):
                if names[start] != series:
                    series, last = names[start], None
                at = start
                while at < end:
                    if last is not None:
                        at += int(np.searchsorted(us[at:end], last + wait))
                    if at < end:
                        fired.append(at)
                        last = us[at]
                        at += 1
            yield batch.take(pa.array(fired, pa.int64()))

    starts = incidents.select(*SERIES, micros("started_at").alias("us"), "incident_id")
    ordered = starts.repartition(*SERIES).sortWithinPartitions(*SERIES, "us", "incident_id")
    fired = ordered.mapInArrow(fire, "service string, metric string, us bigint, incident_id string")
    return fired.select("incident_id", *SERIES, from_micros(F.col("us"), like).alias("started_at"))


@dataclass(frozen=True)
class CycleResult:
    """What one alert cycle would store, and its two counts."""

    incidents: DataFrame
    members: DataFrame
    fired: DataFrame
    counts: DataFrame


def alert_cycle(
    anomalies: DataFrame, members: DataFrame, last_fired: DataFrame, now: datetime | str,
    gap_seconds: int = V.GROUPING_SECONDS, cooldown_seconds: int = V.SUPPRESSION_SECONDS,
) -> CycleResult:
    """One cycle at ``now``: group what is ungrouped; per series the earliest group fires, unless the
    series fired less than the cooldown ago. Everything else stays ungrouped for the next cycle."""
    like = anomalies.schema["timestamp"].dataType
    at = time_literal(anomalies, "timestamp", now)
    waiting = ungrouped_anomalies(anomalies, members)
    slots = broadcast_if_small(session_slots(waiting, gap_seconds))
    groups = _incidents(slots, like)
    heads = groups.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_groups"), F.min(F.struct("started_at", "incident_id")).alias("head")
    )
    recent = last_fired.groupBy(*SERIES).agg(F.max("last_fired").alias("last_fired"))
    ready = F.col("last_fired").isNull() | (
        micros(at) >= micros("last_fired") + F.lit(cooldown_seconds * 1_000_000)
    )
    heads = heads.join(recent, list(SERIES), "left").withColumn("fires", ready)
    firing = heads.where("fires")
    incidents = firing.select(
        F.col("head.incident_id").alias("incident_id"), *SERIES, F.lit("open").alias("status"),
        F.col("head.started_at").alias("started_at"), F.lit(None).cast(like).alias("resolved_at"),
    )
    fired_slots = slots.join(firing.select(F.col("head.incident_id").alias("incident_id")), "incident_id", "left_semi")
    new_members = (
        waiting.withColumn("slot", _slot(gap_seconds))
        .join(fired_slots.select(*SERIES, "slot", "incident_id"), [*SERIES, "slot"])
        .select("anomaly_id", "incident_id")
    )
    fired = firing.select(*SERIES, at.alias("last_fired"))
    created = F.coalesce(F.count_if("fires"), F.lit(0))
    counts = heads.agg(
        created.alias("created"), (F.coalesce(F.sum("n_groups"), F.lit(0)) - created).alias("suppressed")
    )
    return CycleResult(incidents, new_members, fired, counts)


def resolve_incident(incidents: DataFrame, incident_ids: DataFrame, now: datetime | str, seq: int) -> DataFrame:
    """Status events that soft-close incidents; unknown ids close nothing."""
    return incidents.join(incident_ids.select("incident_id"), "incident_id", "left_semi").select(
        "incident_id", F.lit("resolved").alias("status"),
        time_literal(incidents, "started_at", now).alias("event_ts"), F.lit(seq).cast("bigint").alias("seq"),
    )


def current_incidents(incidents: DataFrame, status_events: DataFrame) -> DataFrame:
    """Incidents under their latest status; ``resolved_at`` is set only while resolved."""
    newest = status_events.groupBy("incident_id").agg(
        F.max(F.struct("event_ts", "seq", "status")).alias("e")
    )
    status = F.coalesce("e.status", "status")
    return incidents.drop("resolved_at").join(newest, "incident_id", "left").select(
        "incident_id", *SERIES, status.alias("status"), "started_at",
        F.when(status == "resolved", F.col("e.event_ts")).alias("resolved_at"),
    )


def status_domain_audit(rows: DataFrame) -> DataFrame:
    """Rows per table column ``status`` inside and outside the allowed values."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("status").isin(*V.STATUSES)).alias("n_invalid"),
        F.count_if(F.col("status") == "open").alias("n_open"),
    )
