"""Exact quantiles over many days from sketches kept per day: the readings are scanned once, to settle the rank.

The sketches of the days are merged to a bracket around the wanted rank. One pass over the readings counts what lies
below it and, per value, what lies inside; the exact value follows from those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.selection import DIRECT_ROWS, quantile
from pulsegrid.session import broadcast_if_small, cut_lineage, pin_small

SERIES = ("service", "metric")
SKETCH_K = 1024  # about 25 KB a series and day at most
RANK_ERROR = 0.0045  # of a rank, as share of the rows, that such a sketch stays within in 99 of 100 cases
STORED = T.StructType([
    T.StructField("service", T.StringType()), T.StructField("metric", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("sketch", T.BinaryType()), T.StructField("event_date", T.DateType()),
])


def daily_sketches(readings: DataFrame, value: str = "value") -> DataFrame:
    """Rows with a value and a mergeable sketch of them, per series and day. Null and NaN values are in none."""
    rows = readings.where(F.col(value).isNotNull() & ~F.isnan(value))
    return rows.groupBy(*SERIES, F.to_date("timestamp").alias("event_date")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_K).alias("sketch")
    )


def save_daily_sketches(readings: DataFrame, path: str) -> None:
    """Write or replace the sketches of the days of ``readings``, which must be whole days; other days stay."""
    rows = daily_sketches(readings).select(STORED.names).repartition("event_date")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


def load_daily_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def _brackets(sketches: DataFrame, q: float) -> DataFrame:
    merged = sketches.groupBy(*SERIES).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    # Twice the error, which leaves room for two rows, as the quantile lies between neighbours; few rows are all inside.
    few = F.col("n") * RANK_ERROR < 2

    def edge(rank: float, end: float) -> Column:
        bounds = [F.kll_sketch_get_quantile_double("sketch", F.lit(r)) for r in (end, min(max(rank, 0.0), 1.0))]
        return F.when(few, bounds[0]).otherwise(bounds[1])

    return merged.select(*SERIES, edge(q - 2 * RANK_ERROR, 0.0).alias("_lo"), edge(q + 2 * RANK_ERROR, 1.0).alias("_hi"))


def quantile_from_daily(
    readings: DataFrame, sketches: DataFrame, q: float, name: str, value: str = "value", direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """Exact quantile with linear interpolation per series, as ``quantile`` gives it, as a small table.

    ``sketches`` are those of the days of ``readings``. They only say where to look: the ranks come from the one pass over the
    readings, which also shows whether the bracket holds them. Series for which it does not (a sketch that erred, days
    without a sketch), or with more than ``direct_rows`` different values inside, go the general way, which
    narrows the rank over several scans. Null and NaN values count nowhere; a series without values has no row.
    """
    rows = readings.select(*SERIES, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    known = rows.join(broadcast_if_small(_brackets(sketches, q)), list(SERIES), "left")
    zone = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).when(F.col("_lo").isNotNull(), 0).otherwise(1)
    counted = known.select(*SERIES, "_v", zone.alias("_zone")).withColumn("_at", F.when(F.col("_zone") == 0, F.col("_v")))
    # The readings are read here and, for series that the sketches hold, nowhere else.
    counts = cut_lineage(counted.groupBy(*SERIES, "_zone", "_at").agg(F.count(F.lit(1)).alias("c")))

    within = F.col("_zone") == 0
    state = counts.groupBy(*SERIES).agg(
        F.sum("c").alias("_n"), F.coalesce(F.sum(F.when(F.col("_zone") == -1, F.col("c"))), F.lit(0)).alias("_below"),
        F.coalesce(F.sum(F.when(within, F.col("c"))), F.lit(0)).alias("_inside"), F.count_if(within).alias("_values"),
    )
    at = (F.col("_n") - 1) * F.lit(q)
    ranks = state.withColumn("_part", at - F.floor(at)).withColumn("_first", F.floor(at) + 1).withColumn("_last", F.ceil(at) + 1)
    held = (F.col("_below") < F.col("_first")) & (F.col("_last") <= F.col("_below") + F.col("_inside")) & (F.col("_values") <= direct_rows)
    ranks, _ = pin_small(ranks.withColumn("_held", held))  # one row a series

    settled = _settle(counts.where(within), ranks.where("_held"), name)
    rest = ranks.where("NOT _held").select(*SERIES)
    if rest.isEmpty():
        return settled
    open_rows = rows.join(F.broadcast(rest) if rest.count() <= 10_000 else rest, list(SERIES), "left_semi")
    return settled.unionByName(quantile(open_rows, SERIES, "_v", q, name, direct_rows=direct_rows))


def _settle(inside: DataFrame, ranks: DataFrame, name: str) -> DataFrame:
    """The value at the wanted ranks from counts per value; at most ``direct_rows`` rows of a series are ordered."""
    upto = F.sum("c").over(Window.partitionBy(*SERIES).orderBy("_at"))
    ranked = inside.join(ranks, list(SERIES)).withColumn("_upto", F.col("_below") + upto)

    def value_at(rank: str) -> Column:
        return F.min(F.when(F.col("_upto") >= F.col(rank), F.col("_at")))

    low, high = value_at("_first"), value_at("_last")
    # Without a fraction both are the same row, which may be infinite.
    between = F.when(low == high, low).otherwise(low + (high - low) * F.max("_part"))
    return ranked.groupBy(*SERIES).agg(between.alias(name))
