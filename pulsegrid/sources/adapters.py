"""The given tables as metric events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import labels_to_map


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metric_events(events: DataFrame) -> DataFrame:
    """Event table to canonical metric events: five services by user, the event type as metric."""
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service"),
        F.col("event_type").alias("metric"),
        "value",
        F.col("ts").alias("timestamp"),
        labels_to_map("props").alias("labels"),
    )


def load_metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_events(read_table(spark, sf_dir, "events"))


def lineitem_readings(lineitem: DataFrame) -> DataFrame:
    """Line items in long form, four readings each: a larger input of the same shape."""
    readings = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.col(f"l_{name}").alias("value"))
            for name in ("quantity", "extendedprice", "discount", "tax")
        ]
    )
    return lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"),
        F.concat("l_returnflag", "l_linestatus").alias("service"),
        F.col("l_shipdate").alias("timestamp"), F.explode(readings).alias("r"),
    ).select(
        F.concat_ws("-", "line_id", "r.metric").alias("event_id"), "service",
        F.col("r.metric").alias("metric"), F.col("r.value").alias("value"), "timestamp",
        F.create_map().cast("map<string,string>").alias("labels"),
    )
