"""Helpers the corpus operators share: reading inputs, staging tables in the shared folder, Arrow slices."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import shared_folder

# Texts are worked on in slices of about this many bytes, so a task's memory follows the slice (or the longest text).
SLICE_BYTES = 2 * 1024 * 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the folder that the driver and all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/pulsegrid-{name}-{uuid.uuid4().hex}"


_scope: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the stored rows.

    Cuts lineage: a lost executor costs only its own running tasks, and a result that depends on how rows were dealt
    out is computed once. The files stay as long as the returned frame may be read: inside ``staged_into`` until the
    caller drops them, else as long as the shared folder's owner keeps them.
    """
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if (paths := _scope.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged_into(paths: list[str]) -> Iterator[None]:
    """Collects in ``paths`` what is staged inside."""
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables whose frames nobody will read again; empties ``paths``."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Rows of a few numbers each: at most some tens of megabytes.
BROADCAST_ROWS = 1_000_000


def small_or_not(rows: DataFrame, bound: int | None = None) -> DataFrame:
    """Marked for broadcast if counted to have at most so many short rows; else left to a shuffled join."""
    bound = BROADCAST_ROWS if bound is None else bound
    return F.broadcast(rows) if rows.limit(bound + 1).count() <= bound else rows


def release_memory() -> None:
    """Give freed memory back to the system: idle Python workers share an executor's memory with the next stage's."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(_libc(), "malloc_trim", None)) is not None:
        trim(0)


@lru_cache(maxsize=1)
def _libc():
    return ctypes.CDLL(None)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice have about ``limit`` bytes; a longer text comes alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        release_memory()


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
