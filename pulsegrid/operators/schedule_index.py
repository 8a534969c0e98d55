"""Schedules with very many windows: disjoint segments, spread over time slots and joined by equality.

Overlapping windows of a series are flattened once into segments that each name the row that wins there. A segment is
listed in every time slot it touches, so a reading meets only the segments of its own slot, and at most one holds it:
readings are neither multiplied nor combined again, and no array of windows is searched row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.scalars import micros, perturb
from pulsegrid.operators.evaluation import confusion_scores
from pulsegrid.session import broadcast_if_small, cut_lineage, small_or_none

SERIES = ("service", "metric")
SLOT_BOUNDS = 20_000  # window bounds in a slot, while a series has at most MOST_SLOTS slots
MOST_SLOTS = 1_024  # a power of two
NO_RANK = np.iinfo(np.int64).max


def flat_segments(windows: DataFrame) -> DataFrame:
    """Series, from_us, to_us and the winning ``spec``: disjoint pieces of time, without those no window covers.

    The least (spec_idx, start, end, type, magnitude) wins, as in ``apply_anomaly_schedule``. Windows that are empty or
    lack a bound cover nothing; a window listed twice counts once. Windows are numbered in that order by a range sort, so
    that the rest only looks for least numbers. A series is cut into slots of equally many bounds. A window is a part of
    its first and its last slot; the slots between are covered by two runs of 2^k slots each, of which a series has at
    most ``MOST_SLOTS`` * log ``MOST_SLOTS`` different ones. So n windows need at most 4 n small rows, however they nest.
    """
    order = ["spec_idx", "start_us", "end_us", "anomaly_type", "magnitude"]
    kept = windows.withColumn("start_us", micros("start")).withColumn("end_us", micros("end")).where("start_us < end_us")
    sorted_specs = kept.select(*SERIES, *order).distinct().repartitionByRange(*order, *SERIES).sortWithinPartitions(*order)
    specs = cut_lineage(sorted_specs.withColumn("rank", F.monotonically_increasing_id()))
    cuts = broadcast_if_small(_slot_cuts(specs))
    placed = _placed(specs.select(*SERIES, "start_us", "end_us", "rank").join(cuts, list(SERIES)))
    parts = _edges(placed).unionByName(_whole_slots(placed, cuts))
    parts = parts.groupBy(*SERIES, "slot", "from_us", "to_us").agg(F.min("rank").alias("rank"))
    schema = T.StructType([*windows.select(*SERIES).schema, *(T.StructField(c, T.LongType()) for c in ("from_us", "to_us", "rank"))])
    segments = cut_lineage(parts.groupBy(*SERIES, "slot").applyInArrow(_least_covering, schema))
    few = small_or_none(segments)
    named = (segments if few is None else few).join(specs.select("rank", F.struct(*order).alias("spec")), "rank")
    return named.select(*SERIES, "from_us", "to_us", "spec")


def _slot_cuts(specs: DataFrame) -> DataFrame:
    """Series and ``cuts``, the times at which all its slots but the first begin: quantiles of its windows' bounds."""
    bounds = specs.select(*SERIES, F.explode(F.array("start_us", "end_us")).alias("us"))
    shares = [i / MOST_SLOTS for i in range(1, MOST_SLOTS)]
    sketched = bounds.groupBy(*SERIES).agg(
        F.percentile_approx("us", shares, 10 * MOST_SLOTS).alias("cuts"), F.count(F.lit(1)).alias("n")
    )
    step = F.greatest(F.lit(1), F.floor(F.lit(MOST_SLOTS * SLOT_BOUNDS) / F.col("n")))
    return sketched.select(*SERIES, F.array_distinct(F.filter("cuts", lambda _, i: (i + 1) % step == 0)).alias("cuts"))


def _placed(specs: DataFrame) -> DataFrame:
    """With ``a`` and ``b``, the slots of a window's first and last microsecond, by a binary search of the cuts."""
    steps = F.array(*[F.lit(MOST_SLOTS >> k) for k in range(1, MOST_SLOTS.bit_length())])

    def slot(us: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("cuts", at + step - 1) <= us, at + step).otherwise(at))

    # As generated rows both are computed once, whatever filters follow.
    found = F.struct(slot(F.col("start_us")).alias("a"), slot(F.col("end_us") - 1).alias("b"))
    return specs.withColumn("slots", F.explode(F.array(found))).select(*specs.columns, "slots.*")


def _edges(placed: DataFrame) -> DataFrame:
    """The parts of windows in their first and last slot."""
    first_ends, last_begins = F.get("cuts", F.col("a")), F.get("cuts", F.col("b") - 1)

    def part(slot: str, start: Column, end: Column) -> Column:
        return F.struct(F.col(slot).alias("slot"), start.alias("from_us"), end.alias("to_us"))

    inside = F.array(part("a", F.col("start_us"), F.col("end_us")))
    two = F.array(part("a", F.col("start_us"), first_ends), part("b", last_begins, F.col("end_us")))
    parts = placed.select(*SERIES, "rank", F.explode(F.when(F.col("a") == F.col("b"), inside).otherwise(two)).alias("part"))
    return parts.select(*SERIES, "part.*", "rank")


def _whole_slots(placed: DataFrame, cuts: DataFrame) -> DataFrame:
    """The least rank over each slot that lies between the first and the last of some window."""
    level = F.floor(F.log2(F.col("b") - F.col("a") - 1)).cast("int")  # where log2 falls short, two halves still cover a power of two
    runs = placed.where("b - a > 1").select(*SERIES, "rank", "a", "b", level.alias("level"))
    size = F.call_function("shiftleft", F.lit(1), F.col("level"))
    runs = runs.select(*SERIES, "rank", "level", F.explode(F.array(F.col("a") + 1, F.col("b") - size)).alias("run"))
    least = runs.groupBy(*SERIES, "level", "run").agg(F.min("rank").alias("rank"))
    slots = least.select(*SERIES, "rank", F.explode(F.sequence(F.col("run"), F.col("run") + size - 1)).alias("slot"))
    slots = slots.groupBy(*SERIES, "slot").agg(F.min("rank").alias("rank")).join(cuts, list(SERIES))
    return slots.select(*SERIES, "slot", F.get("cuts", F.col("slot") - 1).alias("from_us"), F.get("cuts", F.col("slot")).alias("to_us"), "rank")


def _least_covering(key: tuple, parts: pa.Table) -> pa.Table:
    """Disjoint pieces of one slot with the least rank that covers each; neighbours of one rank are one piece.

    A part is two runs of 2^k pieces; from the longest runs on, each hands its least rank to its halves.
    """
    start, end, rank = (parts[c].to_numpy() for c in ("from_us", "to_us", "rank"))
    at = np.unique(np.concatenate([start, end]))
    a, b = np.searchsorted(at, start), np.searchsorted(at, end)
    level = np.frexp(b - a)[1] - 1
    least = np.full(len(at) - 1, NO_RANK)
    for k in range(level.max(), -1, -1):
        here = level == k
        np.minimum.at(least, a[here], rank[here])
        np.minimum.at(least, b[here] - (1 << k), rank[here])
        if k:
            half = 1 << (k - 1)
            least[half:] = np.minimum(least[half:], least[:-half])
    begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(begins[1:], len(least))
    held = least[begins] != NO_RANK
    begins, ends = begins[held], ends[held]
    columns = [pa.repeat(k, len(begins)) for k in key[: len(SERIES)]]
    return pa.table([*columns, at[begins], at[ends], least[begins]], names=[*SERIES, "from_us", "to_us", "rank"])


def slotted(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments by slot, slot width of each series).

    A slot is as wide as the mean segment, gaps included, so a series has at most about three rows a segment.
    """
    extent = F.max("to_us") - F.min("from_us")
    widths = segments.groupBy(*SERIES).agg(
        F.min("from_us").alias("origin"), F.greatest(F.lit(1), F.ceil(extent / F.count(F.lit(1)))).cast("bigint").alias("width")
    )
    widths = broadcast_if_small(widths)  # one row a series
    touched = F.sequence(_slot("from_us"), F.floor((F.col("to_us") - 1 - F.col("origin")) / F.col("width")).cast("bigint"))
    rows = segments.join(widths, list(SERIES)).select(*SERIES, "from_us", "to_us", "spec", F.explode(touched).alias("slot"))
    return broadcast_if_small(rows), widths


def _slot(us: str):
    return F.floor((F.col(us) - F.col("origin")) / F.col("width")).cast("bigint")


def _with_spec(metrics: DataFrame, windows: DataFrame) -> DataFrame:
    """Readings with ``spec``, the window that wins at their time, or null."""
    rows, widths = slotted(cut_lineage(flat_segments(windows)))
    keyed = metrics.withColumn("_us", micros("timestamp")).join(widths, list(SERIES), "left").withColumn("_slot", _slot("_us"))
    m, s = keyed.alias("m"), rows.alias("s")
    same = [F.col(f"m.{c}") == F.col(f"s.{c}") for c in SERIES] + [F.col("m._slot") == F.col("s.slot")]
    inside = (F.col("m._us") >= F.col("s.from_us")) & (F.col("m._us") < F.col("s.to_us"))
    joined = m.join(s, [*same, inside], "left")
    return joined.select(*[F.col(f"m.{c}") for c in metrics.columns], F.col("s.spec").alias("_spec"))


def apply_schedule_indexed(metrics: DataFrame, windows: DataFrame) -> DataFrame:
    """What ``apply_anomaly_schedule`` gives, for any number of windows in a series.

    A reading without a time, or of a series without windows, stays as it is; no windows at all change nothing.
    Segments that were counted and are few are broadcast, else the join shuffles by series and slot, so a
    hot series is spread over its slots. Columns named _us, _slot or _spec are not carried.
    """
    hit = F.col("_spec").isNotNull()
    return (
        _with_spec(metrics, windows).withColumn("base_value", F.col("value"))
        .withColumn("value", F.when(hit, perturb(F.col("value"), F.col("timestamp"), F.col("_spec"))).otherwise(F.col("value")))
        .withColumn("spec_idx", F.col("_spec.spec_idx")).withColumn("is_anomalous", hit).drop("_spec")
    )


def score_against_truth_indexed(readings: DataFrame, windows: DataFrame, flag: str) -> DataFrame:
    """What ``score_against_truth`` gives, for any number of windows in a series."""
    labelled = _with_spec(readings, windows)
    return confusion_scores(
        labelled.withColumn("truth", F.when(F.col("_spec").isNotNull(), 1).otherwise(0))
        .withColumn("predicted", F.when(F.col(flag), 1).otherwise(0)).drop("_spec")
    )
