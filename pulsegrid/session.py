"""Session settings and the two helpers every job shares: small tables and lineage cuts."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was measured and has at most this many rows and bytes.
SMALL_ROWS = 200_000
SMALL_BYTES = 256 * 1024 * 1024


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session for jobs and tests. On a cluster the submitted settings win; nothing is forced there."""
    builder = (
        SparkSession.builder.appName("pulsegrid")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's checkpoint folder.

    Where none is set, a temporary folder serves in local mode only; on a cluster that is an error, as executors could
    not read each other's files.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps read the stored rows and survive the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def pin_small(df: DataFrame, bound: int = SMALL_ROWS) -> tuple[DataFrame, pa.Table | None]:
    """Materialise a table that is expected to be small, checking that it is.

    Up to ``bound`` rows (and ``SMALL_BYTES``) come back as a local relation marked for broadcast, with its rows as
    an Arrow table. A larger table is checkpointed and left to a shuffled (skew-split) join.
    """
    spark = df.sparkSession
    rows = df.limit(bound + 1).toArrow()
    if rows.num_rows <= bound and rows.nbytes <= SMALL_BYTES:
        return F.broadcast(spark.createDataFrame(rows, schema=df.schema)), rows
    return cut_lineage(df), None


def small_or_none(df: DataFrame, bound: int = SMALL_ROWS) -> DataFrame | None:
    """``pin_small`` for a table that is of no use unless it is small: a larger one is neither read whole nor stored."""
    rows = df.limit(bound + 1).toArrow()
    if rows.num_rows <= bound and rows.nbytes <= SMALL_BYTES:
        return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema))
    return None


def broadcast_if_small(df: DataFrame, bound: int = SMALL_ROWS) -> DataFrame:
    """``pin_small`` without the rows."""
    return pin_small(df, bound)[0]
