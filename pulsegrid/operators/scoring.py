"""Fit forests, attach current models, score readings."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import fixed_values as V
from pulsegrid.functions.forest import fit_surface, lookup, normal_core
from pulsegrid.functions.scalars import is_anomaly
from pulsegrid.operators.selection import GroupSizes, mark_first_k, quantile, weighted_quantile
from pulsegrid.session import broadcast_if_small, cut_lineage

SERIES = ("service", "metric")

# Score surfaces go to every executor only up to this many edges (16 bytes each) and models in all.
BROADCAST_EDGES = 4_000_000
BROADCAST_MODELS = 100_000
# Readings per sorted group when surfaces are too many to broadcast.
GROUP_ROWS = 4_000_000

FIT_SCHEMA = (
    "service string, metric string, edges array<double>, scores array<double>, n_fit bigint, fit_seconds double"
)


def fit_isolation_forest(
    train: DataFrame, n_trees: int = V.N_TREES, max_rows: int = V.MAX_TREE_ROWS, seed: int = V.FOREST_SEED,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """One forest per series as a score surface without offset.

    A forest looks at ``n_trees * max_rows`` rows at most, so that many are drawn per series by a
    hash of the event id before anything is grouped; a hot series costs its task no more than any
    other. Sorting the drawn values makes the fit independent of row order.
    """
    if "value" not in train.columns:
        raise ValueError("training rows need a 'value' column")
    sizes = sizes or GroupSizes.of(train, SERIES)
    if sizes.is_empty():
        raise ValueError("training rows must not be empty")
    keyed = train.select(
        *SERIES, "value", F.xxhash64("event_id").alias("_h1"), F.xxhash64(F.lit(seed), "event_id").alias("_h2")
    )
    wanted = n_trees * max_rows
    drawn = mark_first_k(keyed, SERIES, ["_h1", "_h2"], lambda n: F.least(n, F.lit(wanted)), "_in", sizes).where("_in")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        edges, scores = fit_surface(rows["value"].to_numpy(), n_trees, max_rows, seed)
        return pd.DataFrame(
            {
                "service": [rows["service"].iloc[0]], "metric": [rows["metric"].iloc[0]],
                "edges": [edges], "scores": [scores],
                "n_fit": [len(rows)], "fit_seconds": [time.perf_counter() - began],
            }
        )

    # A fixed number of partitions keeps the fits apart; adaptive coalescing would line them up in one task.
    width = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        drawn.select(*SERIES, "value").repartition(width, *SERIES).groupBy(*SERIES).applyInPandas(fit, FIT_SCHEMA)
    )


def attach_current_model(events: DataFrame, current: DataFrame) -> DataFrame:
    """Readings with the id of their current model; a series without one drops out."""
    return events.join(broadcast_if_small(current.select(*SERIES, "model_id")), list(SERIES))


@dataclass(frozen=True)
class LoadedSurfaces:
    """Surfaces brought to the driver after their size was checked: ids and (edges, decision scores)."""

    ids: list[str]
    steps: list[tuple[np.ndarray, np.ndarray]]

    def table(self, spark: SparkSession, **columns: pa.Array) -> DataFrame:
        ids = pa.array(self.ids, pa.string())
        return F.broadcast(spark.createDataFrame(pa.table({"model_id": ids, **columns})))


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [row.values.to_numpy(zero_copy_only=False) for chunk in column.chunks for row in chunk]


def load_surfaces(surfaces: DataFrame, max_edges: int | None = None) -> LoadedSurfaces | None:
    """Surfaces for a broadcast, or None when they have more edges or models in all than the bounds."""
    total = surfaces.agg(F.sum(F.size("edges")).alias("edges"), F.count(F.lit(1)).alias("models")).first()
    if (total["edges"] or 0) > (BROADCAST_EDGES if max_edges is None else max_edges) or total["models"] > BROADCAST_MODELS:
        return None
    rows = surfaces.select("model_id", "edges", "scores", "offset").toArrow()
    parts = zip(
        _arrays(rows.column("edges")), _arrays(rows.column("scores")), rows.column("offset").to_pylist(), strict=True
    )
    return LoadedSurfaces(rows.column("model_id").to_pylist(), [(e, s - o) for e, s, o in parts])


def score_events(
    events: DataFrame, surfaces: DataFrame, loaded: LoadedSurfaces | None = None, max_edges: int | None = None
) -> DataFrame:
    """``score`` = raw score minus offset of the reading's model; below 0 means anomalous.

    ``events`` carry model_id; a reading without a value cannot be scored and drops out. While all
    surfaces fit the measured bound they are broadcast and a reading costs one binary search; beyond
    it readings and edges are merged by sorting, with the same scores.
    """
    events = events.where(F.col("value").isNotNull())
    loaded = loaded or load_surfaces(surfaces, max_edges)
    if loaded is None:
        return _score_by_sorting(events, surfaces)
    spark = events.sparkSession
    shared = spark.sparkContext.broadcast(loaded.steps)
    places = loaded.table(spark, _at=pa.array(range(len(loaded.ids)), pa.int32()))

    @F.pandas_udf("double")
    def decide(at: pd.Series, value: pd.Series) -> pd.Series:
        where, x = at.to_numpy(), value.to_numpy(dtype=float)
        out = np.empty(len(x))
        order = np.argsort(where, kind="stable")
        found, starts = np.unique(where[order], return_index=True)
        for model, rows_of in zip(found, np.split(order, starts[1:]), strict=True):
            out[rows_of] = lookup(*shared.value[model], x[rows_of])
        return pd.Series(out)

    # Marked non-deterministic only so that a filter on the score does not evaluate it a second time.
    score = decide.asNondeterministic()
    return events.join(places, "model_id").withColumn("score", score("_at", "value")).drop("_at")


def score_anomalies(
    events: DataFrame, surfaces: DataFrame, threshold: float = V.ANOMALY_THRESHOLD,
    loaded: LoadedSurfaces | None = None, max_edges: int | None = None,
) -> DataFrame:
    """Only the readings whose score is below the threshold, with their scores.

    Nearly all readings lie in the range around a model's centre where every step is normal. Two
    numbers per model settle those inside the JVM; only the rest is scored, whichever way that goes.
    """
    loaded = loaded or load_surfaces(surfaces, max_edges)
    if loaded is not None:
        cores = [normal_core(edges, decisions, threshold) for edges, decisions in loaded.steps]
        low, high = (pa.array([c[i] for c in cores], pa.float64()) for i in (0, 1))
        bounds = loaded.table(events.sparkSession, _low=low, _high=high)
    else:
        bounds = broadcast_if_small(surface_cores(surfaces, threshold))
    inside = (F.col("value") > F.col("_low")) & (F.col("value") <= F.col("_high"))
    rest = events.join(bounds, "model_id").where(F.col("value").isNotNull() & ~inside).drop("_low", "_high")
    return keep_anomalies(score_events(rest, surfaces, loaded, max_edges), threshold)


def surface_cores(surfaces: DataFrame, threshold: float) -> DataFrame:
    """model_id, _low, _high: the normal range of each model, found where its surface lies."""

    def cores(batches):
        for batch in batches:
            steps = zip(batch["edges"], batch["scores"], batch["offset"], strict=True)
            bounds = [normal_core(np.asarray(e, dtype=float), np.asarray(s, dtype=float) - o, threshold) for e, s, o in steps]
            yield pd.DataFrame({"model_id": batch["model_id"], "_low": [b[0] for b in bounds], "_high": [b[1] for b in bounds]})

    return surfaces.select("model_id", "edges", "scores", "offset").mapInPandas(cores, "model_id string, _low double, _high double")


def _score_by_sorting(events: DataFrame, surfaces: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The same scores without a broadcast: readings take the score of the last edge below them.

    Each model's readings are spread over as many salts as their number needs, and its edges, which
    are bounded by the forest size, are copied to each salt.
    """
    sizes = events.groupBy("model_id").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("salts"))
    sizes = broadcast_if_small(sizes)
    readings = (
        events.join(surfaces.select("model_id"), "model_id", "left_semi").join(sizes, "model_id")
        .withColumn("_row", F.struct(*events.columns))
        .select(
            "model_id", F.pmod(F.xxhash64("event_id"), F.col("salts")).cast("int").alias("salt"),
            F.col("value").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("step"), "_row",
        )
    )
    floor = F.array(F.lit(float("-inf")))
    edges = surfaces.join(sizes, "model_id").select(
        "model_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.arrays_zip(F.concat(floor, "edges").alias("at"), F.col("scores").alias("step")).alias("steps"), "offset",
    )
    edges = edges.select("model_id", "salt", F.explode("steps").alias("s"), "offset").select(
        "model_id", "salt", F.col("s.at").alias("at"),
        # An edge does not count for a reading equal to it, so it sorts after; the floor sorts first.
        F.when(F.col("s.at") == F.lit(float("-inf")), -1).otherwise(1).alias("kind"),
        (F.col("s.step") - F.col("offset")).alias("step"), F.lit(None).cast(readings.schema["_row"].dataType).alias("_row"),
    )
    upto = (
        Window.partitionBy("model_id", "salt").orderBy("at", "kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    merged = readings.unionByName(edges).withColumn("score", F.last("step", ignorenulls=True).over(upto))
    return merged.where(F.col("kind") == 0).select("_row.*", "score")


def contamination_offset(scored: DataFrame, keys: Sequence[str] = SERIES, contamination: float = V.CONTAMINATION) -> DataFrame:
    """Quantile of the raw training scores per group, for scores of any kind."""
    return quantile(scored, keys, "score", contamination, "offset")


def surface_offsets(train: DataFrame, raw: DataFrame, contamination: float = V.CONTAMINATION) -> DataFrame:
    """Offset per model from all its training rows.

    Raw scores of a forest take at most one value per interval of its surface, so they are counted
    per value first and the quantile runs over those counts.
    """
    zeroed = raw.withColumn("offset", F.lit(0.0))
    scored = score_events(train.select("event_id", "model_id", "value"), zeroed)
    counts = scored.groupBy("model_id", "score").agg(F.count(F.lit(1)).alias("c"))
    return weighted_quantile(counts, ["model_id"], "score", "c", contamination, "offset")


def rank_detector(metrics: DataFrame, q: float = 1.0 - V.CONTAMINATION) -> DataFrame:
    """Model-free stand-in detector: score = quantile of the series minus value."""
    cut = quantile(metrics, SERIES, "value", q, "cut")
    return metrics.join(cut, list(SERIES)).withColumn("score", F.col("cut") - F.col("value")).drop("cut")


def keep_anomalies(scored: DataFrame, threshold: float = V.ANOMALY_THRESHOLD) -> DataFrame:
    return scored.where(is_anomaly("score", threshold)).withColumn("threshold", F.lit(float(threshold)))


def rethreshold(anomalies: DataFrame, threshold: float) -> DataFrame:
    """Re-judge stored anomalies; only a tighter threshold is meaningful, since normal readings are not stored."""
    kept: Column = is_anomaly("score", threshold)
    return anomalies.groupBy(*SERIES).agg(
        F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_dropped")
    )


def pin_surfaces(surfaces: DataFrame) -> DataFrame:
    """Fitted surfaces are read by several steps; fit them once."""
    return cut_lineage(surfaces)
