"""Exact order statistics and "first k of each group" that hold for hot groups.

A window ordered inside (service, metric) would put a hot series, possibly a third of all rows,
into one task. Group sizes are therefore counted first. Up to ``DIRECT_ROWS`` rows per group, Spark's
own window or ``percentile`` is used, on the ordering columns alone. Beyond that the wanted rank is
narrowed down: Spark's mergeable quantile sketch gives cut points of the remaining rows, exact counts
tell which of them enclose the rank, and so on until few enough rows are left to be ranked directly.
Cut points follow the rows and not the value range, so any distribution narrows, infinite values
included. The last step counts copies per value, so few different values need no narrowing, however
many rows they have.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import broadcast_if_small, cut_lineage, pin_small

CUT_POINTS = 200
SKETCH_ACCURACY = 20_000
DIRECT_ROWS = 2_000_000

RankRule = Callable[[Column], Sequence[Column]]


def _pin(state: DataFrame) -> tuple[DataFrame, int]:
    """State as a checked small table, with the largest number of values still in a range, as far as estimated."""
    pinned, rows = pin_small(state)
    if rows is not None:
        widest = pc.max(pc.min_element_wise(rows.column("left"), rows.column("kinds"))).as_py() if rows.num_rows else 0
    else:
        widest = pinned.agg(F.max(F.least("left", "kinds"))).first()[0]
    return pinned, widest or 0


def select_ranks(
    df: DataFrame, keys: Sequence[str], value: str, rule: RankRule | None, wanted: DataFrame | None = None,
    direct_rows: int | None = None,
) -> DataFrame:
    """Value at given 1-based ranks of each group, in ascending order of a numeric column.

    ``rule(n)`` gives one rank column per target from the group size; without a rule the table
    ``wanted`` (keys, rank) names one rank per group. The result has one row per group and target:
    keys, target, rank, n, value, n_below, n_equal.
    """
    keys = list(keys)
    rows = df.select(*keys, value).where(F.col(value).isNotNull())
    extent = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.approx_count_distinct(value).alias("kinds"),  # says only when to stop narrowing; the ranks are exact
    )
    if rule is None:
        extent = extent.join(wanted, keys)
        ranks = [F.col("rank")]
    else:
        ranks = list(rule(F.col("n")))
    targets = F.array(
        *[F.struct(F.lit(i).alias("target"), r.cast("bigint").alias("rank")) for i, r in enumerate(ranks)]
    )
    state = extent.select(*keys, "n", "lo", "hi", "kinds", F.explode(targets).alias("t")).select(
        *keys, "n", "lo", "hi", "kinds", "t.target", "t.rank", F.lit(0).cast("bigint").alias("base"),
        # A group of one repeated value needs no narrowing however many rows it has.
        F.when(F.col("hi") > F.col("lo"), F.col("n")).otherwise(F.lit(1).cast("bigint")).alias("left"),
    )
    state, widest = _pin(state)
    ordered = Window.partitionBy(*keys, "target")

    direct = DIRECT_ROWS if direct_rows is None else direct_rows
    before = None
    # A pass that does not halve the widest range met copies of one value, which the last step counts once.
    while widest > direct and (before is None or 2 * widest <= before):
        before = widest
        share = F.array(*[F.lit(i / CUT_POINTS) for i in range(CUT_POINTS + 1)])
        inside = _in_range(rows, state, keys, value)
        cuts = inside.groupBy(*keys, "target").agg(F.percentile_approx(value, share, F.lit(SKETCH_ACCURACY)).alias("cuts"))
        at = F.col("rank") - F.col("base")
        first = F.greatest(F.floor(at * CUT_POINTS / F.col("left")).cast("int") - 1, F.lit(0))
        last = F.least(F.ceil(at * CUT_POINTS / F.col("left")).cast("int") + 1, F.lit(CUT_POINTS))
        near = state.join(cuts, [*keys, "target"], "left").select(
            *keys, "n", "lo", "hi", "kinds", "target", "rank", "base", "left",
            F.coalesce(F.get("cuts", first), "lo").alias("a"), F.coalesce(F.get("cuts", last), "hi").alias("b"),
        )
        near = _pin(near)[0]
        v = F.col(value)
        counted = _in_range(rows, near, keys, value).groupBy(*keys, "target").agg(
            F.count_if(v < F.col("a")).alias("below"), F.count_if((v >= F.col("a")) & (v <= F.col("b"))).alias("within"),
            F.approx_count_distinct(F.when((v >= F.col("a")) & (v <= F.col("b")), v)).alias("kinds_within"),
        )
        below, within = F.coalesce("below", F.lit(0)), F.coalesce("within", F.lit(0))
        # A sketch that missed the rank narrows nothing.
        good = (F.col("base") + below < F.col("rank")) & (F.col("rank") <= F.col("base") + below + within)
        state = near.join(counted, [*keys, "target"], "left").select(
            *keys, "n", F.when(good, F.col("a")).otherwise(F.col("lo")).alias("lo"),
            F.when(good, F.col("b")).otherwise(F.col("hi")).alias("hi"), "target", "rank",
            (F.col("base") + F.when(good, below).otherwise(0)).alias("base"),
            F.when(good & (F.col("a") == F.col("b")), F.lit(1).cast("bigint")).when(good, within).otherwise(F.col("left")).alias("left"),
            F.when(good, F.col("kinds_within")).otherwise(F.col("kinds")).alias("kinds"),
        )
        state, widest = _pin(state)

    values = (
        _in_range(rows, state, keys, value)
        .groupBy(*keys, "target", "rank", "n", "base", value)
        .agg(F.count(F.lit(1)).alias("n_equal"))
        .withColumn("upto", F.col("base") + F.sum("n_equal").over(ordered.orderBy(value)))
    )
    return values.where(
        (F.col("upto") - F.col("n_equal") < F.col("rank")) & (F.col("rank") <= F.col("upto"))
    ).select(
        *keys, "target", "rank", "n", F.col(value).alias("value"),
        (F.col("upto") - F.col("n_equal")).alias("n_below"), "n_equal",
    )


def _in_range(rows: DataFrame, state: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.join(state, keys).where((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))


@dataclass(frozen=True)
class GroupSizes:
    """Rows per group (keys, n) as a checked small table. Counting is a scan, so it is done once and passed on."""

    table: DataFrame
    rows: pa.Table | None
    widest: int

    @staticmethod
    def pinned(table: DataFrame) -> GroupSizes:
        pinned, rows = pin_small(table)
        if rows is None:
            return GroupSizes(pinned, None, pinned.agg(F.max("n")).first()[0])
        return GroupSizes(pinned, rows, pc.max(rows.column("n")).as_py() or 0)

    @staticmethod
    def of(df: DataFrame, keys: Sequence[str]) -> GroupSizes:
        return GroupSizes.pinned(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))

    def at_least(self, n: int) -> GroupSizes:
        return GroupSizes.pinned(self.table.where(F.col("n") >= n))

    def part(self, size: Column) -> GroupSizes:
        """Sizes of a part of each group, from an expression over ``n``; empty parts drop out."""
        return GroupSizes.pinned(self.table.withColumn("n", size.cast("bigint")).where(F.col("n") > 0))

    def is_empty(self) -> bool:
        return self.table.isEmpty() if self.rows is None else self.rows.num_rows == 0


def quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, name: str, direct_rows: int | None = None
) -> DataFrame:
    """Exact quantile with linear interpolation per group, as a checked small table."""
    keys = list(keys)
    if GroupSizes.of(df, keys).widest <= (DIRECT_ROWS if direct_rows is None else direct_rows):
        return pin_small(df.groupBy(*keys).agg(F.percentile(value, F.lit(q)).alias(name)))[0]

    def rule(n: Column) -> list[Column]:
        at = (n - 1) * F.lit(q)
        return [F.floor(at) + 1, F.ceil(at) + 1]

    ranks = select_ranks(df, keys, value, rule, direct_rows=direct_rows)
    at = F.lit(q) * (F.max("n") - 1)
    low = F.max(F.when(F.col("target") == 0, F.col("value")))
    high = F.max(F.when(F.col("target") == 1, F.col("value")))
    cut = ranks.groupBy(*keys).agg((low + (high - low) * (at - F.floor(at))).alias(name))
    return pin_small(cut)[0]


def weighted_quantile(counts: DataFrame, keys: Sequence[str], value: str, weight: str, q: float, name: str) -> DataFrame:
    """Same, over already counted values whose number per group is bounded by the caller."""
    keys = list(keys)
    w = Window.partitionBy(*keys)
    total = F.sum(weight).over(w)
    upto = F.sum(weight).over(w.orderBy(value))
    ranked = counts.withColumn("at", (total - 1) * F.lit(q)).withColumn("upto", upto)
    low = F.min(F.when(F.col("upto") >= F.floor("at") + 1, F.col(value)))
    high = F.min(F.when(F.col("upto") >= F.ceil("at") + 1, F.col(value)))
    part = F.max(F.col("at") - F.floor("at"))
    return ranked.groupBy(*keys).agg((low + (high - low) * part).alias(name))


def _up_to(value: Column, cut: Column, tied: Column) -> Column:
    """Below the cut, or at it where ``tied`` holds. Only a CASE keeps Spark from computing ``tied`` for every row."""
    return F.when(value < cut, True).when(value == cut, tied).otherwise(False)


def mark_first_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rank: Callable[[Column], Column], flag: str,
    sizes: GroupSizes | None = None, direct_rows: int | None = None,
) -> DataFrame:
    """Add ``flag``: true for the first ``rank(n)`` rows of each group in the order of numeric columns.

    An expression in ``order`` is computed only for the rows that the ones before it leave tied at the cut.

    ``rank(n)`` must lie in 1..n, and ``order`` must make rows unique. The last row that is in, one per
    group, is found from the ordering columns alone; it is a small table, computed once, and the flag
    is a comparison with it, so whole rows are never shuffled. In large groups the cut is found on the
    first column; only where it falls inside a run of equal values do those rows, and no others, go on
    to the next column; they are stored, so the table is not scanned again for them. With ``sizes`` given, only the groups listed there remain.
    """
    keys, order = list(keys), [F.col(c) if isinstance(c, str) else c for c in order]
    if sizes is not None:
        df = df.join(sizes.table.select(*keys), keys, "left_semi")
    else:
        sizes = GroupSizes.of(df, keys)
    ranked = sizes.table.select(*keys, "n", rank(F.col("n")).alias("_rank"))
    if sizes.rows is not None and ranked.where(F.col("_rank") < F.col("n")).isEmpty():
        return df.withColumn(flag, F.lit(True))
    if sizes.widest <= (DIRECT_ROWS if direct_rows is None else direct_rows):
        ranked = F.broadcast(ranked) if sizes.rows is not None else ranked
        at = F.row_number().over(Window.partitionBy(*keys).orderBy(*[f"_by{i}" for i in range(len(order))]))
        last = df.select(*keys, *[c.alias(f"_by{i}") for i, c in enumerate(order)]).withColumn("_at", at).join(ranked, keys).where(F.col("_at") == F.col("_rank"))
        last = pin_small(last.select(*keys, *[F.col(f"_by{i}").alias(f"_last{i}") for i in range(len(order))]))[0]
        inside: Column = F.lit(True)
        for i, c in reversed(list(enumerate(order))):
            inside = _up_to(c, F.col(f"_last{i}"), inside)
        marked = df.join(last, keys, "left").withColumn(flag, F.coalesce(inside, F.lit(False)))
        return marked.drop(*[f"_last{i}" for i in range(len(order))])
    marked, tied, left = df, df, list(order)
    rule: RankRule | None = lambda n: [rank(n)]
    wanted: DataFrame | None = None
    levels = 0
    while left:
        found = select_ranks(tied.select(*keys, left[0].alias("_by")), keys, "_by", rule, wanted, direct_rows).select(
            *keys,
            F.col("value").alias(f"_cut{levels}"),
            (F.col("n_below") + F.col("n_equal") <= F.col("rank")).alias(f"_whole{levels}"),
            (F.col("rank") - F.col("n_below")).alias("rank"),
        )
        cut, rows = pin_small(found)
        marked = marked.join(cut.drop("rank"), keys, "left")
        levels += 1
        if rows is not None and all(rows.column(f"_whole{levels - 1}").to_pylist()):
            break
        split = cut.where(~F.col(f"_whole{levels - 1}")).select(*keys, F.col(f"_cut{levels - 1}").alias("_cut"), "rank")
        wanted, rule = split.drop("_cut"), None
        tied = tied.join(broadcast_if_small(split.drop("rank")), keys).where(left[0] == F.col("_cut"))
        names = [f"_by{i}" for i in range(levels, len(order))]
        tied = cut_lineage(tied.select(*keys, *[c.alias(name) for c, name in zip(left[1:], names, strict=True)]))
        left = [F.col(name) for name in names]
    inside = F.lit(True)
    for level in reversed(range(levels)):
        value, cut_value = order[level], F.col(f"_cut{level}")
        inside = _up_to(value, cut_value, F.col(f"_whole{level}") | inside)
    helpers = [f"_{part}{level}" for level in range(levels) for part in ("cut", "whole")]
    return marked.withColumn(flag, F.coalesce(inside, F.lit(False))).drop(*helpers)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``row_number`` per group by a range sort, so that a hot group is spread over many tasks.

    ``order`` must make rows unique. The sorted rows are checkpointed because the numbering reads
    them twice and both reads must see the same partitions.
    """
    keys = list(keys)
    by = [*keys, *order]
    laid_out = cut_lineage(
        df.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    pieces = laid_out.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(
        F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    pieces = pieces.select(*keys, "_part", "_first", before.alias("_before"))
    return (
        laid_out.join(pieces, [*keys, "_part"])
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
        .drop("_part", "_at", "_first", "_before")
    )
