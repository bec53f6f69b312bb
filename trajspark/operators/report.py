"""Reports put together from the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.operators import motion, stats
from trajspark.operators.axes import FPS

KEYS = ["dataset_id", "source", "axis_index"]


def top_axes(metrics: DataFrame, metric: str, k: int = 5) -> DataFrame:
    """The k axes of each source with the largest metric; missing ones are left out, ties by axis. T1."""
    w = Window.partitionBy("dataset_id", "source").orderBy(F.desc(metric), "axis_index")
    return metrics.where(F.col(metric).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*KEYS, metric, "rank")


def temporal_summary(temporal: DataFrame) -> DataFrame:
    """A13: means by source; the top axes are ``temporal_leaders`` of the same table."""
    return temporal.groupBy("dataset_id", "source").agg(F.count(F.lit(1)).alias("n_axes"), F.avg("smoothness").alias("smoothness"), F.avg("jerk").alias("jerk"))


def temporal_leaders(temporal: DataFrame, k: int = 5) -> DataFrame:
    """(dataset_id, source, metric, rank, axis_index, value): the k axes of each source with the largest jerk, velocity,
    acceleration and third derivative, ranked in one pass. A13, T1."""
    return _leaders(temporal, ("jerk", "mean_velocity", "mean_acceleration", "mean_true_jerk"), k)


def constraint_leaders(constraints: DataFrame, k: int = 5) -> DataFrame:
    """The same of the shares of values and speeds beyond the limits; shares of 0 are there too. A14, T1."""
    return _leaders(constraints, ("position_ratio", "velocity_ratio"), k)


def _leaders(metrics: DataFrame, names: tuple[str, ...], k: int) -> DataFrame:
    cells = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]))
    w = Window.partitionBy("dataset_id", "source", "metric").orderBy(F.desc("value"), "axis_index")
    ranked = metrics.select(*KEYS, cells).where("value is not null").withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select("dataset_id", "source", "metric", "rank", "axis_index", "value")


def constraint_summary(constraints: DataFrame) -> DataFrame:
    """A14: the worst axes are ``constraint_leaders`` of the same table."""
    return constraints.groupBy("dataset_id").agg(
        F.count_if(F.col("n_position") > 0).alias("n_position_limits"), F.count_if(F.col("n_velocity") > 0).alias("n_velocity_limits"),
        F.max("position_ratio").alias("max_position_ratio"), F.max("velocity_ratio").alias("max_velocity_ratio"),
    )


def joint_report(axis: DataFrame, limits: DataFrame | None = None, fps: float = FPS) -> DataFrame:
    """Row per source and axis with metrics, coverage, temporal metrics, spikes and, with limits, constraints. A15."""
    derived = motion.derivatives(axis, fps)
    out = stats.axis_metrics(axis).join(stats.sigma_coverage(axis), KEYS, "left").join(motion.temporal_metrics(derived), KEYS, "left").join(motion.spike_ratio(derived), KEYS, "left")
    return out if limits is None else out.join(motion.constraint_metrics(derived, limits), KEYS, "left")
