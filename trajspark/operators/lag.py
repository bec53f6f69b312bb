"""Lag between state and action: correlations at shifts of whole frames, one sort for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.operators.axes import FPS

FLAT, TIE = 1e-9, 1e-9
PAIRED = ["dataset_id", "episode_index", "axis_index"]


def pair_state_action(axis: DataFrame) -> DataFrame:
    """Rows with the state ``x`` and the action ``y`` of one episode, frame and axis. J5."""
    side = lambda s, n: axis.where(F.col("source") == s).select(*PAIRED, "pos", F.col("value").alias(n))
    return side("state", "x").join(side("action", "y"), [*PAIRED, "pos"])


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are there; null below four of them or where one hardly varies."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((F.count(x) >= 4) & (sx >= FLAT) & (sy >= FLAT), F.try_divide(F.covar_pop(x, y), sx * sy))


def max_lag(fps: float = FPS) -> int:
    return max(3, min(15, round(fps * 0.5)))


def lagged_correlations(pairs: DataFrame, most: int) -> DataFrame:
    """(dataset, episode, axis, lag, correlation, weight) for lags -most..most: x now against y ``lag`` frames later.
    A11."""
    w = Window.partitionBy(*PAIRED).orderBy("pos")
    lags = list(range(-most, most + 1))
    wide = pairs.select(*PAIRED, "x", *[(F.lead("y", k) if k >= 0 else F.lag("y", -k)).over(w).alias(f"y{i}") for i, k in enumerate(lags)])
    aggs = []
    for i in range(len(lags)):
        aggs += [correlation(F.col("x"), F.col(f"y{i}")).alias(f"c{i}"), F.count(f"y{i}").alias(f"n{i}")]
    each = wide.groupBy(*PAIRED).agg(*aggs)
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{i}").alias("correlation"), F.col(f"n{i}").alias("weight")) for i, k in enumerate(lags)]))
    return each.select(*PAIRED, long.alias("r")).select(*PAIRED, "r.*").where("correlation is not null")


def state_action_lag(axis: DataFrame, fps: float = FPS) -> DataFrame:
    """Best lag of each axis: weighted over episodes, largest mean absolute correlation; within 1e-9 the smaller
    absolute lag, then the earlier one. Positive: the action follows the state. A12."""
    c = lagged_correlations(pair_state_action(axis), max_lag(fps)).groupBy("dataset_id", "axis_index", "lag").agg(
        (F.sum(F.abs("correlation") * F.col("weight")) / F.sum("weight")).alias("size"),
        (F.sum(F.col("correlation") * F.col("weight")) / F.sum("weight")).alias("correlation"),
        F.sum("weight").alias("weight"),
    )
    listed = c.groupBy("dataset_id", "axis_index").agg(F.array_sort(F.collect_list(F.struct("lag", "size", "correlation", "weight"))).alias("all"))
    better = lambda b, x: (x["size"] > b["size"] + TIE) | ((F.abs(x["size"] - b["size"]) <= TIE) & (F.abs(x["lag"]) < F.abs(b["lag"])))
    best = F.aggregate("all", F.get("all", F.lit(0)), lambda b, x: F.when(better(b, x), x).otherwise(b))
    out = listed.select("dataset_id", "axis_index", best.alias("b"))
    return out.select(
        "dataset_id", "axis_index", F.col("b.lag").cast("long").alias("lag_frames"), (F.col("b.lag") / fps).alias("lag_seconds"),
        F.col("b.size").alias("abs_correlation"), F.col("b.correlation").alias("correlation"), F.col("b.weight").alias("sample_weight"),
    )


def lag_summary(best: DataFrame) -> DataFrame:
    """Median, mean and largest absolute lag and the mean correlation of each dataset. A12."""
    return best.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_axes"), F.median("lag_frames").alias("median_lag"), F.avg(F.abs("lag_frames")).alias("mean_abs_lag"),
        F.max(F.abs("lag_frames")).alias("max_abs_lag"), F.avg("abs_correlation").alias("mean_abs_correlation"),
    )


def top_lag_axes(best: DataFrame, k: int = 5) -> DataFrame:
    """The k axes of largest absolute lag, then largest correlation. T1."""
    w = Window.partitionBy("dataset_id").orderBy(F.desc(F.abs("lag_frames")), F.desc("abs_correlation"), "axis_index")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
