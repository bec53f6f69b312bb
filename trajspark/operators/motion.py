"""Derivatives, smoothness, spikes, limits, time steps, smoothing of jumps, and static edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.operators.axes import AXIS, EPISODE, FPS, NO_STEP, finite
from trajspark.operators.stats import anomaly_threshold

SERIES = ["dataset_id", "source", "axis_index"]
NO_LIMIT_SLACK = 1e-9


def derivatives(axis: DataFrame, fps: float = FPS) -> DataFrame:
    """``axis`` with first and second differences d1, d2 and velocity, acceleration and jerk, each over the later time
    step; a step of no length counts as 1 / fps. W1."""
    w = Window.partitionBy(*AXIS).orderBy("pos")
    dt = F.col("ts") - F.lag("ts").over(w)
    axis = axis.withColumn("dt", F.when(dt <= NO_STEP, 1 / fps).otherwise(dt)).withColumn("d1", F.col("value") - F.lag("value").over(w))
    axis = axis.withColumn("d2", F.col("d1") - F.lag("d1").over(w)).withColumn("velocity", F.col("d1") / F.col("dt"))
    axis = axis.withColumn("acceleration", (F.col("velocity") - F.lag("velocity").over(w)) / F.col("dt"))
    return axis.withColumn("jerk", (F.col("acceleration") - F.lag("acceleration").over(w)) / F.col("dt"))


def temporal_metrics(derived: DataFrame) -> DataFrame:
    """Mean and largest absolute differences and derivatives of each source and axis over all episodes. A7."""
    named = {"d1": ("smoothness", "max_delta"), "d2": ("jerk", "max_jerk"), "velocity": ("mean_velocity", "max_velocity"), "acceleration": ("mean_acceleration", "max_acceleration"), "jerk": ("mean_true_jerk", "max_true_jerk")}
    aggs = [f(F.abs(c)).alias(n) for c, names in named.items() for f, n in zip((F.avg, F.max), names)]
    return derived.groupBy(*SERIES).agg(*aggs)


def spike_ratio(derived: DataFrame) -> DataFrame:
    """Share of absolute second differences above their mean + 3 deviations; 0 where that is 0. A8."""
    s = derived.select(*SERIES, F.abs("d2").alias("v")).where("v is not null")
    limit = s.groupBy(*SERIES).agg((F.avg("v") + 3 * F.stddev_pop("v")).alias("limit"))
    share = F.avg(F.when((F.col("limit") > 0) & (F.col("v") > F.col("limit")), 1.0).otherwise(0.0))
    return s.join(limit, SERIES).groupBy(*SERIES).agg(share.alias("spike_ratio"))


def constraint_metrics(derived: DataFrame, limits: DataFrame) -> DataFrame:
    """Counts and shares of values beyond (lower, upper) and of speeds beyond velocity_limit, by source and axis;
    ``limits``: dataset_id, source, axis_index, lower, upper, velocity_limit. A9."""
    d = derived.join(limits, SERIES)
    v, speed = F.col("value"), F.abs("velocity")
    beyond = (v < F.col("lower") - NO_LIMIT_SLACK) | (v > F.col("upper") + NO_LIMIT_SLACK)
    fast = speed > F.col("velocity_limit") + NO_LIMIT_SLACK
    out = d.groupBy(*SERIES).agg(
        F.count(F.when(F.col("lower").isNotNull() | F.col("upper").isNotNull(), v)).alias("n_position"),
        F.count_if(F.coalesce(beyond, F.lit(False))).alias("n_beyond"),
        F.count(F.when(F.col("velocity_limit").isNotNull(), speed)).alias("n_velocity"),
        F.count_if(F.coalesce(fast, F.lit(False))).alias("n_fast"),
        F.max(F.when(F.col("velocity_limit").isNotNull(), speed)).alias("max_speed"),
    )
    return out.withColumn("position_ratio", F.try_divide("n_beyond", "n_position")).withColumn("velocity_ratio", F.try_divide("n_fast", "n_velocity"))


def timestamp_summary(frames: DataFrame, fps: float = FPS) -> DataFrame:
    """Time steps of a dataset: mean, deviation, least, largest, and their distance from 1 / fps. Times are taken as
    they are; repair them first. A10."""
    dt = F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy(*EPISODE).orderBy("pos"))
    s = frames.select("dataset_id", dt.alias("dt")).where("dt is not null")
    off = F.abs(F.col("dt") - 1 / fps)
    return s.groupBy("dataset_id").agg(
        F.count("dt").alias("n"), F.avg("dt").alias("mean_dt"), F.stddev_pop("dt").alias("std_dt"), F.min("dt").alias("min_dt"),
        F.max("dt").alias("max_dt"), F.avg(off).alias("mean_jitter"), F.max(off).alias("max_jitter"),
    )


def dt_checks(frames: DataFrame, fps: float = FPS, tolerance: float = 0.05) -> DataFrame:
    """By episode: whether times rise throughout, and whether their mean step is within tolerance of 1 / fps. W17."""
    dt = F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy(*EPISODE).orderBy("pos"))
    return frames.select(*EPISODE, dt.alias("dt")).groupBy(*EPISODE).agg(
        F.coalesce(F.min("dt") > 0, F.lit(True)).alias("rising"),
        F.coalesce(F.abs(F.avg("dt") - 1 / fps) <= tolerance / fps, F.lit(True)).alias("steady"),
    )


def flag_anomalies(derived: DataFrame, column: str = "velocity", by: list[str] | None = None) -> DataFrame:
    """``derived`` with ``anomaly``: the column's absolute value is above the threshold of its series. W2."""
    keys = by or AXIS
    limit = anomaly_threshold(derived, keys, column)
    return derived.join(limit, keys, "left").withColumn("anomaly", F.coalesce(F.abs(column) > F.col("threshold"), F.lit(False)))


def smooth_jumps(derived: DataFrame, window: int = 5) -> DataFrame:
    """``derived`` with ``anomaly`` and ``smoothed``: frames within half a window of a velocity anomaly, but never the
    first and the last, lie on a straight line by frame number between the nearest untouched frames. W4."""
    radius = max(3, window | 1) // 2
    d = flag_anomalies(derived)
    order = Window.partitionBy(*AXIS).orderBy("pos")
    near = F.max(F.col("anomaly").cast("int")).over(order.rowsBetween(-radius, radius)) == 1
    edge = F.lag("pos").over(order).isNull() | F.lead("pos").over(order).isNull()
    d = d.withColumn("touched", near & ~edge)
    kept = F.when(~F.col("touched"), F.struct("pos", "value"))
    left = F.last(kept, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*AXIS).orderBy(F.desc("pos"))  # a running value from the end, not a frame scanned for each row
    right = F.last(kept, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("__l", left).withColumn("__r", right)
    share = (F.col("pos") - F.col("__l.pos")) / (F.col("__r.pos") - F.col("__l.pos"))
    line = F.col("__l.value") + share * (F.col("__r.value") - F.col("__l.value"))
    return d.withColumn("smoothed", F.when(F.col("touched"), line).otherwise(F.col("value"))).drop("__l", "__r")


def smoothing_report(smoothed: DataFrame) -> DataFrame:
    """Frames changed by dataset, episode and axis, and the largest change. W4."""
    out = smoothed.groupBy(*AXIS).agg(
        F.count_if("touched").alias("n_changed"), F.count_if("anomaly").alias("n_anomalies"), F.max(F.abs(F.col("smoothed") - F.col("value"))).alias("max_change")
    )
    return out.where("n_changed > 0")


def rebuild_vectors(axis: DataFrame, value: str) -> DataFrame:
    """Long form back to one vector per frame and source."""
    return axis.groupBy(*EPISODE, "source", "pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("axis_index", F.col(value).alias("value")))), lambda s: s["value"]).alias("vector")
    )


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (y - x) * (y - x)), F.lit(0.0), lambda s, x: s + x))


def pick_axes(v: Column, axes: list[int] | None) -> Column:
    return v if axes is None else F.array(*[F.get(v, F.lit(i)) for i in axes])


def window_motion(frames: DataFrame, column: str = "action", window: int = 5, axes: list[int] | None = None) -> DataFrame:
    """(episode, pos, motion): distance between the ends of the window that begins at each frame. W5."""
    w = Window.partitionBy(*EPISODE).orderBy("pos")
    v = pick_axes(F.col(column), axes)
    return frames.select(*EPISODE, "pos", distance(v, F.lead(v, window - 1).over(w)).alias("motion")).where("motion is not null")


def static_edge_trim(frames: DataFrame, column: str = "action", threshold: float = 10.0, margin: int = 0, min_static: int = 1, window: int = 5, axes: list[int] | None = None) -> DataFrame:
    """Row of each episode: what its first and last moving window leave to cut at either end. W6."""
    window, margin, min_static = max(2, window), max(0, margin), max(1, min_static)
    size = frames.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("length"), F.count(column).alias("n_vectors"))
    m = window_motion(frames, column, window, axes).groupBy(*EPISODE).agg(
        F.min(F.when(F.col("motion") > threshold, F.col("pos"))).alias("first_move"),
        F.max(F.when(F.col("motion") > threshold, F.col("pos"))).alias("last_move"),
        F.max("motion").alias("max_motion"), F.avg("motion").alias("mean_motion"),
    )
    t = size.join(m, EPISODE, "left")
    start = F.greatest(F.lit(0), F.col("first_move") - margin)
    end = F.least(F.col("length") - 1, F.col("last_move") + window - 1 + margin)
    before, after = start, F.col("length") - 1 - end
    cut = lambda n: F.when(n >= min_static, n).otherwise(0)
    reason = (
        F.when(F.col("length") < 2, "episode too short").when(F.col("n_vectors") == 0, f"{column} unavailable")
        .when(F.col("length") < window, "episode shorter than the window").when(F.col("first_move").isNull(), "no moving segment found")
        .when((cut(before) == 0) & (cut(after) == 0), "static edge shorter than the least")
    )
    moves = F.col("first_move").isNotNull()
    return t.select(
        *EPISODE, "length", F.when(reason.isNull(), "ok").otherwise("skipped").alias("status"), F.coalesce(reason, F.lit("static edges")).alias("reason"),
        F.when(moves, cut(before)).otherwise(0).cast("long").alias("trim_start"), F.when(moves, cut(after)).otherwise(0).cast("long").alias("trim_end"),
        F.when(moves, start).otherwise(0).cast("long").alias("keep_start"), F.when(moves, end).otherwise(F.col("length") - 1).cast("long").alias("keep_end"),
        "max_motion", "mean_motion",
    )


def trimmed_frames(trims: DataFrame) -> DataFrame:
    """(episode, pos) of all frames that the trims cut."""
    t = trims.where("trim_start + trim_end > 0")
    head = F.when(F.col("trim_start") > 0, F.sequence(F.lit(0).cast("long"), F.col("trim_start") - 1))
    tail = F.when(F.col("trim_end") > 0, F.sequence(F.col("length") - F.col("trim_end"), F.col("length") - 1))
    none = F.array().cast("array<bigint>")
    return t.select(*EPISODE, F.explode(F.concat(F.coalesce(head, none), F.coalesce(tail, none))).alias("pos"))


def max_joint_speed(frames: DataFrame, fps: float = FPS) -> DataFrame:
    """(episode, pos, speed): largest absolute change of any state axis since the frame before, times fps; the first
    frame has 0. W8."""
    w = Window.partitionBy(*EPISODE).orderBy("pos")
    change = F.array_max(F.zip_with(F.lag("state").over(w), F.col("state"), lambda x, y: F.abs(y - x)))
    return frames.select(*EPISODE, "pos", F.coalesce(change * fps, F.lit(0.0)).alias("speed"))


def max_action_jump(frames: DataFrame, column: str = "action") -> DataFrame:
    """Largest distance between neighbouring vectors of a dataset. A28."""
    w = Window.partitionBy(*EPISODE).orderBy("pos")
    return frames.select("dataset_id", distance(F.lag(column).over(w), F.col(column)).alias("jump")).groupBy("dataset_id").agg(F.max("jump").alias("max_jump"))


def static_axes(axis: DataFrame, least: float = 1e-9) -> DataFrame:
    """Axes whose population deviation is below ``least``. A27."""
    s = axis.groupBy(*SERIES).agg(F.stddev_pop(finite(F.col("value"))).alias("std"))
    return s.where(F.col("std") < least)


def temporal_preview(axis: DataFrame, points: int = 96, fps: float = FPS) -> DataFrame:
    """Derivatives of each dataset's longest episode (the first of several), anomalies marked by that episode's own
    thresholds, and ``shown``: an even sample of ``points`` frames plus the anomalies. W3, P15."""
    size = axis.groupBy(*EPISODE).agg(F.count_distinct("pos").alias("n"))
    longest = size.groupBy("dataset_id").agg(F.max_by("episode_index", F.struct("n", -F.col("episode_index"))).alias("episode_index"))
    d = flag_anomalies(derivatives(axis.join(longest, EPISODE, "left_semi"), fps))
    return select_preview(d, AXIS, "anomaly", points)


def select_preview(df: DataFrame, keys: list[str], marked: str | None, points: int = 96) -> DataFrame:
    """``df`` with ``shown``: every marked row and an even sample; of more marks than points, an even sample of those.
    P15."""
    order = Window.partitionBy(*keys).orderBy("pos")
    whole = Window.partitionBy(*keys)
    mark = F.coalesce(F.col(marked), F.lit(False)) if marked else F.lit(False)
    df = df.withColumn("__mark", mark)
    marks = Window.partitionBy(*keys, "__mark").orderBy("pos")
    df = df.withColumn("__n", F.count(F.lit(1)).over(whole)).withColumn("__i", F.row_number().over(order) - 1)
    df = df.withColumn("__m", F.sum(F.col("__mark").cast("int")).over(whole)).withColumn("__j", F.row_number().over(marks) - 1)

    def even(i: Column, n: Column, k: Column) -> Column:
        """Whether i is rint(j * (n - 1) / (k - 1)) for some j below k."""
        step = (n - 1) / F.greatest(k - 1, F.lit(1))
        j = F.rint(i / F.greatest(step, F.lit(1e-12)))
        hit = [F.rint((j + d) * step) == i for d in (-1, 0, 1)]
        inside = [(j + d >= 0) & (j + d <= k - 1) for d in (-1, 0, 1)]
        return (n <= k) | (hit[0] & inside[0]) | (hit[1] & inside[1]) | (hit[2] & inside[2])

    p = F.lit(points)
    sampled = even(F.col("__i"), F.col("__n"), F.greatest(p - F.col("__m"), F.lit(2)))
    crowded = F.col("__mark") & even(F.col("__j"), F.col("__m"), p)
    shown = F.when(F.col("__m") > p, crowded).otherwise(F.col("__mark") | sampled)
    return df.withColumn("shown", shown).drop("__n", "__i", "__m", "__j", "__mark")


def curve_preview(frames: DataFrame, trims: DataFrame, points: int = 260, axes: int = 8, episodes: int = 80) -> DataFrame:
    """Sampled curves of the first ``axes`` action axes (state where there is no action) of the affected episodes, with
    a mark on frames that go. A report: at most ``episodes`` of them. P16."""
    some = trims.where("trim_start + trim_end > 0").orderBy(*EPISODE).limit(episodes)
    f = frames.join(some.select(*EPISODE, "keep_start", "keep_end"), EPISODE)
    vector = F.coalesce(F.col("action") if "action" in frames.columns else F.lit(None).cast("array<double>"), F.col("state"))
    f = f.withColumn("curve", F.slice(vector, 1, axes)).withColumn("trimmed", ~F.col("pos").between(F.col("keep_start"), F.col("keep_end")))
    return select_preview(f, EPISODE, None, points).where("shown").select(*EPISODE, "pos", "curve", "trimmed")


def sample_frames(frames: DataFrame) -> DataFrame:
    """Evenly spaced frames of each episode for camera statistics: of n, least(greatest(least(100, n), n^0.75), 10000).
    P17."""
    whole, order = Window.partitionBy(*EPISODE), Window.partitionBy(*EPISODE).orderBy("pos")
    n = F.count(F.lit(1)).over(whole)
    f = frames.withColumn("__n", n).withColumn("__i", F.row_number().over(order) - 1)
    k = F.least(F.greatest(F.least(F.lit(100), F.col("__n")), F.floor(F.col("__n") ** 0.75)), F.lit(10_000))
    step = (F.col("__n") - 1) / F.greatest(k - 1, F.lit(1))
    j = F.rint(F.col("__i") / F.greatest(step, F.lit(1e-12)))
    return f.where((F.col("__n") <= k) | (F.rint(j * step) == F.col("__i"))).drop("__n", "__i")
