"""Parse, validate, dedupe and idempotently append metric events and anomalies."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import deterministic_id, micros, parse_event_time, time_literal
from pulsegrid.schemas import WIRE_EVENT
from pulsegrid.session import small_or_none

SERIES = ("service", "metric")


def _absent(name: str) -> Column:
    return F.col(f"j.{name}").isNull() | F.is_variant_null(f"j.{name}")


def _is_text(name: str) -> Column:
    """Numbers, objects and lists are no names, although they could be written as text."""
    return F.schema_of_variant(f"j.{name}") == "STRING"


def parse_events(messages: DataFrame, data: str = "data") -> DataFrame:
    """JSON text to typed events plus ``reason``, which is NULL for a good event.

    The raw text stays in the row. An event without an id gets one from its own content, so a
    redelivered message keeps it.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    # As generated rows the parsed parts are computed once; as plain columns they would be computed
    # again for every later use, filters included.
    parsed = messages.withColumn("j", F.explode(F.array(F.from_json(F.col(data), WIRE_EVENT, options))))
    typed = F.struct(
        F.coalesce("j.event_id", deterministic_id("event", data)).alias("event_id"),
        F.try_variant_get("j.service", "$", "string").alias("service"),
        F.try_variant_get("j.metric", "$", "string").alias("metric"),
        F.col("j.value").try_cast("double").alias("value"),
        parse_event_time("j.timestamp").alias("timestamp"),
        F.from_json("j.labels", "map<string,string>").alias("labels"),
    )
    parsed = parsed.withColumn("e", F.explode(F.array(typed)))
    reason = (
        F.when(F.col(data).isNull(), "missing data")
        .when(F.col("j").isNull() | F.col("j._corrupt").isNotNull(), "bad json")
        .when(_absent("service"), "missing service")
        .when(_absent("metric"), "missing metric")
        .when(~_is_text("service"), "bad service")
        .when(~_is_text("metric"), "bad metric")
        .when(F.col("j.value").isNull(), "missing value")
        .when(F.col("e.value").isNull() | F.isnan("e.value") | (F.abs("e.value") == float("inf")), "bad value")
        .when(F.col("j.timestamp").isNull(), "missing timestamp")
        .when(F.col("e.timestamp").isNull(), "bad timestamp")
        .when(F.col("j.labels").isNotNull() & F.col("e.labels").isNull(), "bad labels")
    )
    no_labels = F.create_map().cast("map<string,string>")
    return parsed.select(
        *messages.columns,
        "e.event_id", "e.service", "e.metric", "e.value", "e.timestamp",
        F.coalesce("e.labels", no_labels).alias("labels"),
        reason.alias("reason"),
    )


def validate_events(parsed: DataFrame, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """Split into (valid events, rejected messages with payload and reason)."""
    valid = parsed.where(F.col("reason").isNull()).drop("reason", data)
    event_columns = ("event_id", "service", "metric", "value", "timestamp", "labels")
    rejected = parsed.where(F.col("reason").isNotNull()).drop(*event_columns)
    return valid, rejected


def accept_request(parsed: DataFrame, request: str) -> DataFrame:
    """All-or-nothing requests: per request its size, its bad events and whether it is accepted."""
    return parsed.groupBy(request).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("reason").isNotNull()).alias("n_bad"),
        (F.count_if(F.col("reason").isNotNull()) == 0).alias("accepted"),
    )


def accepted_events(parsed: DataFrame, request: str) -> DataFrame:
    """Events of the requests without any bad event; a request with one passes on nothing."""
    bad = parsed.where(F.col("reason").isNotNull()).select(request).distinct()
    return parsed.join(bad, request, "left_anti").drop("reason")


def dedupe_first(df: DataFrame, keys: Sequence[str], arrival: Sequence[str], numbered: bool = False) -> DataFrame:
    """First arrival wins per key.

    A key with very many copies reaches its reducer as one row per task. With ``numbered``, ``arrival``
    is one number that no two rows share: then only keys and numbers are combined, by hashing and
    without a sort, and the winners are looked up by both. That computes ``df`` twice, so it suits stored rows;
    rows that are parsed on the way take the one pass.
    """
    if numbered:
        first = df.groupBy(*keys).agg(F.min(arrival[0]).alias(arrival[0]))
        return df.join(first, [*keys, arrival[0]], "left_semi")
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*arrival)).alias("row")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest]).select(*df.columns)


def insert_if_absent(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], arrival: Sequence[str], small_batch: bool = False,
    numbered: bool = False,
) -> DataFrame:
    """Rows of ``batch`` to append to ``target``: new keys only, first arrival of each, stored row wins.

    With ``small_batch`` the rows of the batch are counted and, when few, their keys are broadcast: the target
    is then only scanned for them and not shuffled. A batch of more rows meets the target in one shuffled join.
    """
    stored = target.select(*keys)
    if small_batch and (named := small_or_none(batch.select(*keys))) is not None:
        stored = stored.join(named, list(keys), "left_semi")
    return dedupe_first(batch.join(stored, list(keys), "left_anti"), keys, arrival, numbered)


# Days of a batch that are named one by one; a batch that touches more is taken as a span.
NAMED_DAYS = 1000


def recent_target(target: DataFrame, batch: DataFrame, column: str = "timestamp") -> DataFrame:
    """Part of a date-partitioned table that a batch can collide with, as a static partition filter.

    Only the batch's own days are opened: one reading from long ago does not open every day since.
    """
    day = F.to_date(column).alias("day")
    days = [r["day"] for r in batch.select(day).where("day IS NOT NULL").distinct().limit(NAMED_DAYS + 1).collect()]
    if not days:
        return target.limit(0)
    if len(days) <= NAMED_DAYS:
        return target.where(F.col("event_date").isin(days))
    span = batch.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    return target.where(F.col("event_date").between(F.lit(span["a"]), F.lit(span["b"])))


def insert_anomalies(target: DataFrame, scored: DataFrame, small_batch: bool = False) -> DataFrame:
    """New anomalies as open rows; one per event, the stored one wins."""
    rows = scored.withColumn("status", F.lit("open"))
    return insert_if_absent(target, rows, ["event_id"], ["timestamp", "anomaly_id"], small_batch)


def batch_accounting(parsed: DataFrame, target: DataFrame, batch_column: str) -> DataFrame:
    """Per batch: received, rejected, inserted and skipped, where an earlier batch wins a key."""
    keys = ["timestamp", "event_id"]
    good = parsed.where(F.col("reason").isNull())
    firsts = (
        good.groupBy(*keys).agg(F.min(batch_column).alias(batch_column))
        .join(target.select(*keys), keys, "left_anti")
        .groupBy(batch_column).agg(F.count(F.lit(1)).alias("inserted"))
    )
    sizes = parsed.groupBy(batch_column).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("reason").isNotNull()).alias("rejected")
    )
    inserted = F.coalesce("inserted", F.lit(0))
    return sizes.join(firsts, batch_column, "left").select(
        batch_column, "received", "rejected", inserted.alias("inserted"),
        (F.col("received") - F.col("rejected") - inserted).alias("skipped"),
    )


def completeness_audit(
    metrics: DataFrame, catalog: DataFrame, start: datetime | str, end: datetime | str, interval_seconds: int
) -> DataFrame:
    """Stored rows of each catalog series in [start, end) against the expected number of ticks."""
    ts = F.col("timestamp")
    first, last = time_literal(metrics, "timestamp", start), time_literal(metrics, "timestamp", end)
    stored = (
        metrics.where((ts >= first) & (ts < last)).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    )
    expected = F.floor((micros(last) - micros(first)) / F.lit(interval_seconds * 1_000_000)).cast("bigint")
    n = F.coalesce("n", F.lit(0))
    return catalog.join(stored, list(SERIES), "left").select(
        *SERIES, expected.alias("expected"), n.alias("stored"), (n >= expected).alias("complete")
    )
