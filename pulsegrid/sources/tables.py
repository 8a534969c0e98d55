"""Stored tables: date-partitioned metrics, append-only run folders, JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.scalars import parse_iso_utc
from pulsegrid.schemas import METRIC_EVENT

METRICS_LAYOUT = ("event_date", "service", "metric", "timestamp")


def dated(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("event_date", T.DateType())])


def with_event_date(df: DataFrame) -> DataFrame:
    return df.withColumn("event_date", F.to_date("timestamp"))


def write_metrics_table(metrics: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by day, sorted in files by series and time so that row groups can be skipped.

    The range partitioning includes the time, so a hot series or a busy day is written by many tasks.
    """
    (
        with_event_date(metrics)
        .repartitionByRange(*METRICS_LAYOUT).sortWithinPartitions(*METRICS_LAYOUT)
        .write.mode(mode).partitionBy("event_date").parquet(path)
    )


def read_metrics_table(spark: SparkSession, path: str, schema: T.StructType = METRIC_EVENT) -> DataFrame:
    return spark.read.schema(dated(schema)).parquet(path)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Empty table at ``path`` unless something is stored there already."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def save_run(rows: DataFrame, root: str, table: str, run_id: str) -> None:
    """Rows of one run in a folder of their own: a repeated run replaces itself and nothing else."""
    rows.write.mode("overwrite").parquet(f"{root}/{table}/run_id={run_id}")


def load_runs(spark: SparkSession, root: str, table: str, schema: T.StructType) -> DataFrame:
    """All runs of a table together."""
    full = T.StructType([*schema.fields, T.StructField("run_id", T.StringType())])
    return spark.read.schema(full).parquet(f"{root}/{table}")


def delete_paths(spark: SparkSession, paths: Sequence[str]) -> int:
    """Delete folders that nothing reads any more; returns how many there were."""
    done = 0
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def save_models(surfaces: DataFrame, root: str, run_id: str) -> None:
    save_run(surfaces, root, "score_surface", run_id)


def load_models(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    return load_runs(spark, root, "score_surface", schema).drop("run_id")


def write_jsonl(events: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per line, times in ISO-8601."""
    events.write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    ).json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Typed events of a JSON-lines folder written by ``write_jsonl``."""
    schema = "event_id string, service string, metric string, value double, timestamp string, labels map<string,string>"
    return spark.read.schema(schema).json(path).withColumn("timestamp", parse_iso_utc("timestamp"))


def write_ground_truth(windows: DataFrame, path: str) -> None:
    write_jsonl(windows, path)
