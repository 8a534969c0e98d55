"""Suppression of repeated alerts as keyed state: one last firing per series, forgotten when its cooldown is over."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.functions import fixed_values as V

SERIES = ("service", "metric")
FIRED = "incident_id string, service string, metric string, started_us bigint, what string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cooldown(StatefulProcessor):
    """Fires an incident unless its series fired less than the cooldown ago; exactly at the cooldown it fires.

    The state of a series is the time of its last firing, in microseconds. An event-time timer removes it when the
    watermark has passed the end of the cooldown, so quiet series keep nothing.
    """

    def __init__(self, cooldown_seconds: int, report_expiry: bool = False):
        self.wait = cooldown_seconds * 1_000_000
        self.report_expiry = report_expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def _until(self, last: int) -> int:
        """Timers count milliseconds; rounded up, so that none runs before the cooldown is over."""
        return -(-(last + self.wait) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Of one series and one batch: at most its time span divided by the grouping gap.
        starts = pd.concat([r[["us", "incident_id"]] for r in rows]).sort_values(["us", "incident_id"])
        us, ids = starts["us"].to_numpy(), starts["incident_id"].to_numpy()
        known = self.last.get()
        before = last = int(known[0]) if known is not None else None
        fired, at = [], 0
        while at < len(us):
            if last is not None:
                at += int(np.searchsorted(us[at:], last + self.wait))
            if at < len(us):
                fired.append(at)
                last = int(us[at])
                at += 1
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._until(before))
            self.last.update((last,))
            self.handle.registerTimer(self._until(last))
        if fired:
            yield pd.DataFrame(
                {"incident_id": ids[fired], "service": key[0], "metric": key[1], "started_us": us[fired], "what": "fired"}
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.last.get()
        if known is not None and self._until(int(known[0])) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            if self.report_expiry:
                yield pd.DataFrame(
                    {"incident_id": [None], "service": [key[0]], "metric": [key[1]], "started_us": [int(known[0])], "what": ["expired"]}
                )

    def close(self) -> None:
        pass


def stream_suppress(
    incidents: DataFrame, cooldown_seconds: int = V.SUPPRESSION_SECONDS, horizon: str = V.ROLLUP_REFRESH,
    report_expiry: bool = False,
) -> DataFrame:
    """Stream of incidents (incident_id, service, metric, started_at) to those that fire, as soon as they come.

    Incidents that come in order of their start give exactly what ``suppress_cooldown`` gives for all of them together,
    however they are cut into batches; within a batch any order will do. One that comes after a later one of its
    series has fired is held against that firing. Lateness beyond ``horizon`` is taken as past: state is only kept
    for the cooldown behind the watermark. An incident without a start does not fire. ``report_expiry`` also gives a row
    (what = 'expired') when the state of a series goes. Run it inside ``keyed_state``.
    """
    at = F.col("started_at").cast("timestamp")
    rows = incidents.where(at.isNotNull()).select(*SERIES, at.alias("started_at"), F.unix_micros(at).alias("us"), "incident_id")
    fired = (
        rows.withWatermark("started_at", horizon).groupBy(*SERIES)
        .transformWithStateInPandas(Cooldown(cooldown_seconds, report_expiry), FIRED, "Append", "EventTime")
    )
    fired = fired.select("incident_id", *SERIES, F.timestamp_micros("started_us").alias("started_at"), "what")
    return fired if report_expiry else fired.drop("what")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk, by key; a stream takes the setting when it starts."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, KEYED_STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
