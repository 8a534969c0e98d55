"""Model registry as append-only tables: versions, and events that move the current pointer."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import fixed_values as V
from pulsegrid.functions.scalars import score_tier

SERIES = ("service", "metric")


def register(versions: DataFrame, seq: int = 0) -> DataFrame:
    """Pointer events that make the given versions current. One append moves all pointers at once."""
    return versions.select(
        *SERIES, "model_id", F.lit("register").alias("kind"),
        F.col("trained_at").alias("event_ts"), F.lit(seq).cast("bigint").alias("seq"),
    )


def rollback_model(
    versions: DataFrame, service: str, metric: str, model_id: str, at: datetime | str, seq: int
) -> DataFrame:
    """Pointer event back to an older version of the same series; an unknown one is an error."""
    target = versions.where(
        (F.col("model_id") == model_id) & (F.col("service") == service) & (F.col("metric") == metric)
    )
    if target.limit(1).count() == 0:
        raise ValueError(f"series {service}/{metric} has no version {model_id}: roll back to one of its own versions")
    return target.select(
        *SERIES, "model_id", F.lit("rollback").alias("kind"),
        F.lit(str(at)).cast(versions.schema["trained_at"].dataType).alias("event_ts"),
        F.lit(seq).cast("bigint").alias("seq"),
    )


def current_models(pointers: DataFrame) -> DataFrame:
    """The one current model per series: last registered or last rolled back to."""
    return pointers.groupBy(*SERIES).agg(F.max(F.struct("event_ts", "seq", "model_id")).alias("p")).select(
        *SERIES, F.col("p.model_id").alias("model_id"), F.col("p.event_ts").alias("since")
    )


def with_current_flag(versions: DataFrame, pointers: DataFrame) -> DataFrame:
    now = current_models(pointers).select("model_id", F.lit(True).alias("is_current"))
    return versions.join(now, "model_id", "left").withColumn("is_current", F.coalesce("is_current", F.lit(False)))


def model_list(
    registry: DataFrame, service: str | None = None, current_only: bool = False, limit: int = V.MAX_MODELS
) -> DataFrame:
    """Newest versions first; model_id orders versions of the same run."""
    rows = registry
    if service is not None:
        rows = rows.where(F.col("service") == service)
    if current_only:
        rows = rows.where("is_current")
    return rows.orderBy(F.desc("trained_at"), "model_id").limit(limit)


def metrics_for_service(registry: DataFrame, service: str) -> DataFrame:
    return registry.where("is_current").where(F.col("service") == service).select("metric")


def avg_f1_evaluated(registry: DataFrame, gate: float = V.MIN_AVG_F1) -> DataFrame:
    """Mean F1 over evaluated versions; NULL, and no pass, when there is none."""
    f1 = F.when(F.col("eval_f1") >= 0, F.col("eval_f1"))
    return registry.agg(F.avg(f1).alias("avg_f1"), F.count(f1).alias("n_evaluated")).withColumn(
        "passes", F.coalesce(F.col("avg_f1") >= gate, F.lit(False))
    )


def registry_audit(registry: DataFrame) -> DataFrame:
    current, f1 = F.col("is_current"), F.col("eval_f1")
    return registry.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(current).alias("n_current"),
        F.count_if(current & (f1 > 0)).alias("n_current_scored"),
        F.count_if(current & (f1 < 0)).alias("n_current_not_evaluated"),
    )


def score_range_audit(registry: DataFrame) -> DataFrame:
    """Evaluated versions with a score outside [0, 1]."""
    outside = F.lit(False)
    for name in ("eval_precision", "eval_recall", "eval_f1"):
        outside = outside | ~F.col(name).between(0.0, 1.0)
    evaluated = F.col("eval_f1") >= 0
    return registry.agg(
        F.count_if(evaluated).alias("n_evaluated"), F.count_if(evaluated & outside).alias("n_out_of_range")
    )


def with_score_tier(registry: DataFrame) -> DataFrame:
    return registry.withColumn("tier", score_tier("eval_f1"))
