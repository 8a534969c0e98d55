"""State tables derived from the given tables: anomalies, incidents, registry, schedule, messages.

The given data holds readings only. Everything else a report needs is derived from them by rules
that both Spark and plain SQL can state; hashes of ids decide the state of a row (resolved or open,
grouped or waiting), and no row is left out.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import fixed_values as V
from pulsegrid.functions.scalars import deterministic_id, hash60, labels_to_json
from pulsegrid.operators.incidents import current_incidents, group_incidents, incident_members
from pulsegrid.operators.registry import with_current_flag
from pulsegrid.operators.schedule import offset_to_window
from pulsegrid.operators.scoring import keep_anomalies, rank_detector
from pulsegrid.plans.detection import as_anomalies
from pulsegrid.session import cut_lineage
from pulsegrid.sources.adapters import load_metric_events, read_table

AS_OF = "2024-01-31 00:00:00"
SIM_START = "2024-01-01 00:00:00"
GAP = 36_000
SERIES = ("service", "metric")
EVENT_TYPES = ("view", "signup", "error", "click", "purchase")


class World:
    """Lazily derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # Call sites in error messages cost more than building the plans themselves.
        spark.conf.set("spark.sql.dataFrameQueryContext.enabled", "false")
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def events(self) -> DataFrame:
        return load_metric_events(self.spark, self.sf_dir)

    @cached_property
    def readings(self) -> DataFrame:
        return self.events.drop("labels")

    @cached_property
    def series(self) -> DataFrame:
        return self.readings.select(*SERIES).distinct()

    @cached_property
    def scored(self) -> DataFrame:
        return rank_detector(self.readings)

    @cached_property
    def anomalies(self) -> DataFrame:
        """Stored once, as the reports read a stored table."""
        found = keep_anomalies(self.scored.withColumn("model_id", deterministic_id("model", *SERIES)))
        return cut_lineage(as_anomalies(found))

    @cached_property
    def all_members(self) -> DataFrame:
        return incident_members(self.anomalies, GAP)

    @cached_property
    def members(self) -> DataFrame:
        """Memberships stored so far; one anomaly in five still waits."""
        return self.all_members.where(hash60("anomaly_id") % 5 != 0)

    @cached_property
    def opened(self) -> DataFrame:
        return group_incidents(self.anomalies, GAP).select(
            "incident_id", *SERIES, "status", "started_at", F.lit(None).cast("timestamp_ntz").alias("resolved_at")
        )

    @cached_property
    def status_events(self) -> DataFrame:
        """One incident in four was closed an hour after it began."""
        closed = self.opened.where(hash60("incident_id") % 4 == 0)
        return closed.select(
            "incident_id", F.lit("resolved").alias("status"),
            (F.col("started_at") + F.expr("INTERVAL 1 HOUR")).alias("event_ts"), F.lit(1).cast("bigint").alias("seq"),
        )

    @cached_property
    def incidents(self) -> DataFrame:
        return current_incidents(self.opened, self.status_events)

    @cached_property
    def fired(self) -> DataFrame:
        """Last firing per series, none for one series in three."""
        h = hash60(F.concat_ws(":", F.lit("fired"), *SERIES))
        ago = F.make_dt_interval(secs=(h % 600).cast("decimal(18,6)"))
        return self.series.where(h % 3 != 0).select(
            *SERIES, (F.lit(AS_OF).cast("timestamp_ntz") - ago).alias("last_fired")
        )

    @cached_property
    def versions(self) -> DataFrame:
        """Three versions per series, trained 0, 7 and 14 days before the as-of time."""
        as_of = F.lit(AS_OF).cast("timestamp_ntz")
        trained = [as_of - F.expr(f"INTERVAL {7 * v} DAYS") for v in range(3)]
        counts = [F.count_if(F.col("timestamp") < t).alias(f"n{v}") for v, t in enumerate(trained)]
        sizes = self.readings.groupBy(*SERIES).agg(*counts)
        rows = F.array(
            *[F.struct(F.lit(v).alias("v"), t.alias("t"), F.col(f"n{v}").alias("n")) for v, t in enumerate(trained)]
        )
        rows = sizes.select(*SERIES, F.explode(rows).alias("r")).withColumn(
            "model_id", deterministic_id("model", *SERIES, "r.v")
        )
        h = hash60("model_id")

        def score(name: str):
            value = (hash60(F.concat_ws(":", F.lit(name), "model_id")) % 101) / F.lit(100.0)
            return F.when(h % 10 == 0, F.lit(-1.0)).otherwise(value).alias(f"eval_{name}")

        return rows.select(
            "model_id", *SERIES, F.lit("isolation_forest").alias("algorithm"), F.col("r.t").alias("trained_at"),
            (F.col("r.t") - F.expr("INTERVAL 30 DAYS")).alias("window_start"), F.col("r.t").alias("window_end"),
            F.ceil(F.col("r.n") * F.lit(0.8)).alias("n_samples"), score("precision"), score("recall"), score("f1"),
            F.col("r.v").alias("version"),
        )

    @cached_property
    def pointers(self) -> DataFrame:
        """Each version was registered when trained; one series in four went back to its second version."""
        back = hash60(F.concat_ws(":", *SERIES)) % 4 == 0
        registered = self.versions.select(
            *SERIES, "model_id", F.lit("register").alias("kind"), F.col("trained_at").alias("event_ts"),
            (2 - F.col("version")).cast("bigint").alias("seq"),
        )
        rolled = self.versions.where((F.col("version") == 1) & back).select(
            *SERIES, "model_id", F.lit("rollback").alias("kind"),
            F.lit(AS_OF).cast("timestamp_ntz").alias("event_ts"), F.lit(9).cast("bigint").alias("seq"),
        )
        return registered.unionByName(rolled)

    @cached_property
    def registry(self) -> DataFrame:
        return with_current_flag(self.versions, self.pointers)

    @cached_property
    def schedule(self) -> DataFrame:
        """Four overlapping schedule rows per series, one of each anomaly type, sized by the series."""
        rows = self.series.select(
            *SERIES, hash60(F.concat_ws(":", *SERIES)).alias("h"),
            F.posexplode(F.array(*[F.lit(t) for t in V.ANOMALY_TYPES])).alias("i", "anomaly_type"),
        )
        h, i = F.col("h"), F.col("i")
        minutes = F.when(i % 2 == 0, (1440 + h % 4000).cast("double"))
        hours = F.when(i != 0, (24 + h % 48).cast("double"))
        magnitude = (
            F.when(F.col("anomaly_type") == "dip", 0.7).when(F.col("anomaly_type") == "spike", 5.0).otherwise(20.0)
        )
        return rows.select(
            i.alias("spec_idx"), *SERIES, "anomaly_type",
            (h % 480 + i * 20).cast("double").alias("start_offset_hours"),
            minutes.alias("duration_minutes"), hours.alias("duration_hours"), magnitude.alias("magnitude"),
        )

    @cached_property
    def windows(self) -> DataFrame:
        return offset_to_window(self.schedule, SIM_START, "timestamp_ntz")

    @cached_property
    def default_schedule(self) -> DataFrame:
        """The default schedule with its services and metrics under the names of the given series."""
        services = {s: f"svc-{i}" for i, s in enumerate(dict.fromkeys(r[0] for r in V.DEFAULT_SCHEDULE))}
        kinds = {m: EVENT_TYPES[i % len(EVENT_TYPES)] for i, m in enumerate(V.METRIC_TYPES)}
        rows = [(n, services[s], kinds[m], *rest) for n, (s, m, *rest) in enumerate(V.DEFAULT_SCHEDULE)]
        names = "start_offset_hours double, duration_minutes double, duration_hours double, magnitude double"
        return self.spark.createDataFrame(rows, f"spec_idx int, service string, metric string, anomaly_type string, {names}")

    @cached_property
    def messages(self) -> DataFrame:
        """One queue message per event, some of them cut off, without a value, with names or values of a wrong kind, or delivered twice."""
        text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        whole = F.to_json(F.struct("event_id", *SERIES, "value", text.alias("timestamp"), "labels"))
        rows = self.events.select(
            F.col("event_id").cast("bigint").alias("n"), whole.alias("text"), (hash60("event_id") % 50).alias("kind")
        )
        kind, text = F.col("kind"), F.col("text")
        data = (
            F.when(kind == 0, F.left(text, F.length(text) - 4))
            .when(kind == 1, F.regexp_replace(text, '"value":[^,]*,', ""))
            .when(kind == 3, F.regexp_replace(text, '"service":"[^"]*"', '"service":5'))
            .when(kind == 4, F.regexp_replace(text, '"metric":"([^"]*)"', '"metric":["$1"]'))
            .when(kind == 5, F.regexp_replace(text, '"value":[^,]*,', '"value":"Infinity",')).otherwise(text)
        )
        copies = F.when(kind == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return rows.select("n", data.alias("data"), F.explode(copies).alias("copy")).select(
            (F.col("n") * 2 + F.col("copy")).alias("msg_id"), "data"
        )

    @cached_property
    def labels_json(self) -> DataFrame:
        return self.events.select("event_id", labels_to_json("labels").alias("labels"))
