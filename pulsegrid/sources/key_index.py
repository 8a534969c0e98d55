"""Filters of the keys a date-partitioned table holds, one or a few a day, kept beside the table.

A blocked Bloom filter as rows: a key sets eight bits in one block of 256 bits, so asking for a key is one equi join on
(part, day, block). A key that a filter does not know is surely new; only days with a key that may be stored are opened.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.ingest import NAMED_DAYS, dedupe_first, insert_if_absent, recent_target
from pulsegrid.session import broadcast_if_small, pin_small
from pulsegrid.sources.tables import ensure_table, save_run

KEYS_A_BLOCK = 16  # 16 bits a key: about one unknown key in a thousand is taken for a stored one
FILE_BLOCKS = 1 << 18
WORDS = ("w0", "w1", "w2", "w3")
BLOCK = T.StructType(
    [T.StructField("block", T.LongType())] + [T.StructField(w, T.LongType()) for w in WORDS]
    + [T.StructField("part", T.StringType()), T.StructField("event_date", T.DateType())]
)
# A row names the filter of a day within a part, a part that is no longer asked, or (with neither) that the index is whole.
PART = T.StructType([
    T.StructField("part", T.StringType()), T.StructField("event_date", T.DateType()),
    T.StructField("n_blocks", T.LongType()), T.StructField("retired", T.StringType()),
])


def _bits(key: str) -> list[Column]:
    """Two bits in each of the four words of a block."""
    h = F.xxhash64(F.lit("bits"), F.col(key))
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * n).bitwiseAND(63).cast("int")) for n in range(8)]
    return [bits[2 * n].bitwiseOR(bits[2 * n + 1]).alias(w) for n, w in enumerate(WORDS)]


def _block(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col("n_blocks")).alias("block")


@dataclass(frozen=True)
class KeyIndex:
    """The index in folder ``path`` of column ``key`` of a table whose days come from ``time``.

    Keys are added before their rows become visible, so a filter may name rows that never came (they cost an exact
    look) but never misses one. Null keys and null times are in no filter, as they equal nothing.
    """

    path: str
    key: str = "event_id"
    time: str = "timestamp"

    def build(self, spark: SparkSession, stored: DataFrame) -> None:
        """Index all rows stored so far; until this is done the index answers nothing and inserts look everywhere."""
        ensure_table(spark, f"{self.path}/parts/run_id=none", PART)
        ensure_table(spark, f"{self.path}/blocks/part=none/event_date=1970-01-01", T.StructType(BLOCK.fields[:5]))
        self.add(stored, "base")
        save_run(spark.createDataFrame([(None, None, None, None)], PART), self.path, "parts", "whole")

    def add(self, rows: DataFrame, part: str) -> None:
        """Filters for the days of ``rows`` as a part of its own; the same part, repeated, replaces itself."""
        keyed = rows.select(F.to_date(self.time).alias("event_date"), F.col(self.key)).where(F.col(self.key).isNotNull() & F.col("event_date").isNotNull())
        n_blocks = F.ceil(F.count(F.lit(1)) / KEYS_A_BLOCK).cast("bigint")
        sizes, _ = pin_small(keyed.groupBy("event_date").agg(n_blocks.alias("n_blocks")))  # one row a day
        blocks = keyed.join(sizes, "event_date").select("event_date", _block(self.key), *_bits(self.key))
        blocks = blocks.groupBy("event_date", "block").agg(*[F.bit_or(w).alias(w) for w in WORDS])
        # A file holds a run of blocks of one day; a busy day has many runs and so many tasks.
        laid_out = blocks.repartition("event_date", F.floor(F.col("block") / FILE_BLOCKS)).sortWithinPartitions("event_date", "block")
        laid_out.write.mode("overwrite").partitionBy("event_date").parquet(f"{self.path}/blocks/part={part}")
        named = sizes.select(F.lit(part).alias("part"), "event_date", "n_blocks", F.lit(None).cast("string").alias("retired"))
        save_run(named.coalesce(1), self.path, "parts", part)

    def parts(self, spark: SparkSession) -> DataFrame | None:
        """(part, event_date, n_blocks) of all filters to ask, or None where the index is not whole."""
        rows = spark.read.schema(PART).parquet(f"{self.path}/parts") if self._exists(spark) else None
        if rows is None or rows.where("part IS NULL AND retired IS NULL").isEmpty():
            return None
        gone = rows.where("retired IS NOT NULL").select(F.col("retired").alias("part")).distinct()
        return rows.where("part IS NOT NULL").drop("retired").join(gone, "part", "left_anti")

    def _exists(self, spark: SparkSession) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/parts")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def maybe_stored(self, rows: DataFrame) -> DataFrame | None:
        """Distinct (event_date, key) of ``rows`` that may be stored; None where the index is not whole.

        The days of ``rows`` and the parts of those days prune the filters that are read.
        """
        spark = rows.sparkSession
        parts = self.parts(spark)
        if parts is None:
            return None
        keyed = rows.select(F.to_date(self.time).alias("event_date"), F.col(self.key)).where(F.col(self.key).isNotNull()).distinct()
        blocks = spark.read.schema(BLOCK).parquet(f"{self.path}/blocks")
        days = [r["event_date"] for r in keyed.select("event_date").where("event_date IS NOT NULL").distinct().limit(NAMED_DAYS + 1).collect()]
        if len(days) <= NAMED_DAYS:
            parts, blocks = (df.where(F.col("event_date").isin(days)) for df in (parts, blocks))
        asked = keyed.join(broadcast_if_small(parts), "event_date")
        words = [F.col(f"q.{w}").bitwiseAND(F.col(f"b.{w}")) == F.col(f"q.{w}") for w in WORDS]
        asked = broadcast_if_small(asked.select("part", "event_date", self.key, _block(self.key), *_bits(self.key))).alias("q")
        same = [F.col(f"q.{c}") == F.col(f"b.{c}") for c in ("part", "event_date", "block")]
        hits = blocks.alias("b").join(asked, same).where(words[0] & words[1] & words[2] & words[3])
        return hits.select("q.event_date", F.col(f"q.{self.key}").alias(self.key)).distinct()

    def compact(self, stored: DataFrame, done: Sequence[str], part: str) -> int:
        """One filter a day again in place of the parts ``done``; returns how many parts that were.

        ``done`` must be parts whose rows ``stored`` shows, so read ``stored`` after you know them: a part whose rows are
        still on their way must stay. Asked meanwhile, the index gives the old filters or the new ones.
        """
        spark = stored.sparkSession
        parts = self.parts(spark)
        if parts is None:
            return 0
        old = parts.where(F.col("part").isin(list(done)))
        names = [r["part"] for r in old.select("part").distinct().collect()]
        if len(names) > 1:
            days = broadcast_if_small(old.select("event_date").distinct())
            self.add(stored.withColumn("_day", F.to_date(self.time)).join(days.withColumnRenamed("event_date", "_day"), "_day", "left_semi"), part)
            gone = spark.createDataFrame([(None, None, None, n) for n in names], PART)
            save_run(gone.coalesce(1), self.path, "parts", f"{part}-retires")
        return len(names)


def insert_indexed(target: DataFrame, index: KeyIndex, batch: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The rows that ``insert_if_absent`` gives, where only days with a key that may be stored are opened.

    ``target`` has the partition column event_date; ``keys`` hold the index's key and time. ``batch`` is read several
    times, so hand over stored or persisted rows. An empty batch gives nothing; columns of the batch are kept as they are.
    """
    hits = index.maybe_stored(batch)
    if hits is None:
        return insert_if_absent(recent_target(target, batch, index.time), batch, keys, arrival, small_batch=True)
    hits, rows = pin_small(hits)
    if rows is not None and rows.num_rows == 0:
        return dedupe_first(batch, keys, arrival)
    same = (F.to_date(F.col(f"n.{index.time}")) == F.col("h.event_date")) & (F.col(f"n.{index.key}") == F.col(f"h.{index.key}"))
    hit, new = hits.alias("h"), batch.alias("n")
    doubtful = new.join(hit, same, "left_semi")
    opened = recent_target(target, doubtful, index.time)
    exact = insert_if_absent(opened, doubtful, keys, arrival, small_batch=True)
    return dedupe_first(new.join(hit, same, "left_anti"), keys, arrival).unionByName(exact)
