"""Balanced contiguous shards from global byte prefix sums.

Rows are put in ascending order of their id. Every partition of that order sums its own sizes; the totals, one row per
partition, give each partition its global start; equal targets on that scale cut the order into shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import stage

ROW_BYTES = 16


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row the bytes and rows before it in its own partition."""
    part = TaskContext.get().partitionId()
    rows = total = 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        ends = np.cumsum(size)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array(np.full(n, part, dtype=np.int32)),
                pa.array(rows + np.arange(n, dtype=np.int64)),
                pa.array(total + ends - size),
            ],
            names=[*batch.schema.names, "part", "row", "before"],
        )
        rows += n
        total += int(ends[-1]) if n else 0


def assign_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, size, text_crc32, shard, slot, byte_start.

    Size is the UTF-8 length of the text plus 16. Order: id (nulls first), size, checksum; rows alike in all three are
    interchangeable. A shard takes the rows whose middle byte falls into its n-th part of all bytes, so a shard differs
    from the mean by at most the largest row. ``slot`` numbers a shard's rows from 0 without gaps. A null text has no
    bytes (size 16, checksum 0) and is placed like any other; an empty table gives no rows; other columns are ignored.
    Repeated rows, even a third of the table, are dealt over many partitions by the last sort key. Only ids, sizes
    and checksums are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["id", "size", "text_crc32", "tie"]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    id_type = docs.schema[id_col].dataType.simpleString()
    placed = stage(
        ordered.mapInArrow(_running, f"id {id_type}, size long, text_crc32 long, part int, row long, before long"), "prefix"
    )
    # One row per partition, then one per shard: both bounded by numbers the caller sets.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    cut = placed.join(F.broadcast(totals), "part").select(
        "id",
        "size",
        "text_crc32",
        (F.col("bytes_before") + F.col("before")).alias("byte_start"),
        (F.col("rows_before") + F.col("row")).alias("n"),
        F.expr(f"cast(((2 * (bytes_before + before) + size) * {n_shards}L) div (2 * all_bytes) as int)").alias("shard"),
    )
    firsts = cut.groupBy("shard").agg(F.min("n").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("n") - F.col("first")).alias("slot"), "byte_start"
    )



def write_shards(docs: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write whole rows into ``path/shard=n`` and return the assignment.

    The last order key of each shard (``n_shards`` rows, the caller's bound) becomes a literal, and each row finds its
    shard by it where it is read. Rows alike in id, size and checksum all go to the earliest shard that has one.
    """
    assigned = stage(assign_shards(docs, n_shards, id_col, text_col), "shards")
    last = assigned.groupBy("shard").agg(F.max(F.struct(F.col(id_col).alias("id"), "size", "text_crc32")).alias("k")).orderBy("shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = F.octet_length(text).cast("long") + ROW_BYTES, F.crc32(text.cast("binary"))
    shard = F.lit(None).cast("int")
    for row in reversed(last.collect()):
        key = F.struct(F.lit(row.k.id).cast(docs.schema[id_col].dataType).alias("id"), F.lit(row.k.size).alias("size"), F.lit(row.k.text_crc32).alias("crc"))
        shard = F.when(F.struct(F.col(id_col).alias("id"), size.alias("size"), crc.alias("crc")) <= key, F.lit(row.shard)).otherwise(shard)
    docs.withColumn("shard", shard).write.partitionBy("shard").parquet(path)
    return assigned
