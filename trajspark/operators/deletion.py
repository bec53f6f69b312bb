"""What a deletion of frames does to the motion, and which deleted frames would bridge the gap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.operators.axes import EPISODE, FPS
from trajspark.operators.edits import delete_except_bridges, find_junctions
from trajspark.operators.motion import distance
from trajspark.operators.stats import acceleration_threshold
from trajspark.session import materialize

RATIO_CAP = 999.0


def splice_check(axis: DataFrame, gone: DataFrame, k_sigma: float = 3.0) -> DataFrame:
    """Row per junction and axis: how far the jump departs from the steps before and after it, over the axis's own
    acceleration threshold (at most 999), and whether that is too much. The steps are those of the recording, whether or
    not their other frame goes. Jumps up to 0.1 % of the largest axis range are left aside. W14."""
    w = Window.partitionBy(*EPISODE, "axis_index").orderBy("pos")
    steps = axis.withColumn("before", F.col("value") - F.lag("value").over(w)).withColumn("next", F.lead("value").over(w) - F.col("value"))
    k = steps.join(gone.select(*EPISODE, "pos"), [*EPISODE, "pos"], "left_anti")
    k = k.withColumn("right", F.lead("pos").over(w)).withColumn("jump", F.lead("value").over(w) - F.col("value")).withColumn("after", F.lead("next").over(w)).where("right - pos > 1")
    limits = acceleration_threshold(axis, k_sigma).select(*EPISODE, "axis_index", "accel_threshold")
    spread = axis.groupBy(*EPISODE, "axis_index").agg((F.max("value") - F.min("value")).alias("range")).groupBy(*EPISODE).agg(F.max("range").alias("range"))
    j = k.join(limits, [*EPISODE, "axis_index"], "left").join(spread, EPISODE)
    off = F.greatest(F.coalesce(F.abs(F.col("jump") - F.col("before")), F.lit(0.0)), F.coalesce(F.abs(F.col("after") - F.col("jump")), F.lit(0.0)))
    ratio = F.when(F.abs("jump") <= 0.001 * F.col("range"), 0.0).otherwise(F.least(F.lit(RATIO_CAP), F.coalesce(off / F.col("accel_threshold"), F.lit(0.0))))
    return j.select(*EPISODE, F.col("pos").alias("left"), "right", "axis_index", "jump", ratio.alias("ratio"), (ratio > 1).alias("bad"))


def junction_report(axis: DataFrame, gone: DataFrame, k_sigma: float = 3.0) -> DataFrame:
    """Row per junction: largest ratio, bad axes, whether it is smooth; episodes of under four frames are. D1."""
    size = axis.groupBy(*EPISODE).agg(F.count_distinct("pos").alias("n"))
    c = splice_check(axis, gone, k_sigma).groupBy(*EPISODE, "left", "right").agg(
        F.max("ratio").alias("ratio"), F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("axis_index")))).alias("bad_axes")
    )
    j = find_junctions(axis.select(*EPISODE, "pos").distinct(), gone).join(c, [*EPISODE, "left", "right"], "left").join(size, EPISODE)
    return j.withColumn("smooth", (F.col("n") < 4) | (F.size("bad_axes") == 0)).drop("n")


#: Share of a frame's deviation at which it still counts. Fixed value.
LOWER = 0.99


def farthest_points(path: np.ndarray, tolerance: float) -> list[int]:
    """Inner points of a path that Douglas and Peucker's rule keeps; distance is the largest over axes at equal step."""
    out, waiting = [], [(0, len(path) - 1)]
    while waiting:
        a, b = waiting.pop()
        if b - a < 2:
            continue
        share = (np.arange(a + 1, b) - a)[:, None] / (b - a)
        off = np.abs(path[a + 1 : b] - (path[a] + share * (path[b] - path[a]))).max(axis=1)
        k = int(off.argmax())
        if off[k] > tolerance:
            out.append(a + 1 + k)
            waiting += [(a, a + 1 + k), (a + 1 + k, b)]
    return sorted(out)


def _bridge(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("pos")
    path, tolerance = np.stack(group["state"].to_numpy()), float(group["tolerance"].iloc[0])
    least = max(2, (len(path) - 2) // 3)
    found = farthest_points(path, tolerance)
    if len(found) < least and len(path) > 2:
        # where too few come out, the tolerance is just below the deviation that as many frames as needed reach
        share = np.linspace(0, 1, len(path))[1:-1, None]
        off = np.sort(np.abs(path[1:-1] - (path[0] * (1 - share) + path[-1] * share)).max(axis=1))[::-1]
        found = farthest_points(path, LOWER * off[min(least, len(off)) - 1])
    out = group.iloc[found][[*EPISODE, "left", "pos"]]
    return out.astype({"left": "int64", "pos": "int64"})


def bridge_frames(frames: DataFrame, junctions: DataFrame, gone: DataFrame) -> DataFrame:
    """(episode, left, pos): deleted frames to keep at junctions that are not smooth, so that the path bends as before.
    The tolerance is half the largest mean step of an axis between the frames that stay. Where that gives fewer than a third of the frames between, or
    than two, it becomes 0.99 of the deviation from the straight line that this many frames reach. One junction is one
    group. D2."""
    w = Window.partitionBy(*EPISODE).orderBy("pos")
    steps = F.zip_with("state", F.lag("state").over(w), lambda x, y: F.abs(x - y))
    kept = frames.join(gone.select(*EPISODE, "pos"), [*EPISODE, "pos"], "left_anti")
    mean = kept.select(*EPISODE, steps.alias("s")).select(*EPISODE, F.posexplode("s").alias("k", "step")).groupBy(*EPISODE, "k").agg(F.avg("step").alias("step"))
    tolerance = mean.groupBy(*EPISODE).agg((F.max("step") / 2).alias("tolerance"))
    bad = junctions.where("not smooth").select(*EPISODE, "left", "right").join(tolerance, EPISODE)
    inside = frames.select(*EPISODE, "pos", "state").join(bad, EPISODE).where("pos between left and right")
    return inside.groupBy(*EPISODE, "left").applyInPandas(_bridge, "dataset_id string, episode_index long, left long, pos long")


def hermite(share: Column, a: Column, b: Column, slope_a: Column, slope_b: Column, width: Column) -> Column:
    """Cubic through a and b with the given slopes per step. F16."""
    t, t2, t3 = share, share * share, share * share * share
    return (2 * t3 - 3 * t2 + 1) * a + (t3 - 2 * t2 + t) * width * slope_a + (3 * t2 - 2 * t3) * b + (t3 - t2) * width * slope_b


def _closest(off: DataFrame) -> DataFrame:
    """Of each stretch of a junction the frame of least ``off``; 1 + n div 3 stretches, two at least, cut at the whole part
    of equal shares."""
    n = F.col("n_between")
    off = off.withColumn("k", F.least(n, F.greatest(F.lit(2), 1 + F.floor(n / 3))).cast("int"))
    # the number of a frame's stretch: how many stretches have ended before it
    stretch = F.size(F.filter(F.sequence(F.lit(1), F.col("k")), lambda i: F.floor(i * (n / F.col("k"))) <= F.col("pos") - F.col("left") - 1))
    return off.groupBy(*EPISODE, "left", stretch.alias("stretch")).agg(F.min_by("pos", F.struct("off", "pos")).alias("pos")).drop("stretch")


def bridge_frames_curve(axis: DataFrame, junctions: DataFrame) -> DataFrame:
    """(episode, left, pos): of each stretch of a junction, the deleted frame closest to the cubic between its ends, by
    Euclidean distance. D3."""
    w = Window.partitionBy(*EPISODE, "axis_index").orderBy("pos")
    a = axis.withColumn("step", F.col("value") - F.lag("value").over(w)).withColumn("next", F.lead("value").over(w) - F.col("value"))
    bad = junctions.where("not smooth").select(*EPISODE, "left", "right", "n_between")
    at = lambda name, v, s: a.select(*EPISODE, "axis_index", F.col("pos").alias(name), F.col("value").alias(v), F.coalesce(s, F.lit(0.0)).alias(f"slope_{v}"))
    ends = bad.join(at("left", "a", F.col("step")), [*EPISODE, "left"]).join(at("right", "b", F.col("next")), [*EPISODE, "axis_index", "right"])
    inside = a.select(*EPISODE, "axis_index", "pos", "value").join(ends, [*EPISODE, "axis_index"]).where("pos > left and pos < right")
    width = F.col("right") - F.col("left")
    ideal = hermite((F.col("pos") - F.col("left")) / width, F.col("a"), F.col("b"), F.col("slope_a"), F.col("slope_b"), width)
    off = inside.withColumn("off", (F.col("value") - ideal) ** 2).groupBy(*EPISODE, "left", "right", "n_between", "pos").agg(F.sqrt(F.sum("off")).alias("off"))
    return _closest(off)


#: Order of the low-pass filter is three; its cut-off as a share of half the frame rate, and frames added at either end.
#: Fixed values.
CUTOFF = 0.25
PADDING = 12


def low_pass(path: np.ndarray, cutoff: float = CUTOFF) -> np.ndarray:
    """``path`` (frames by axes) through a third-order Butterworth filter forth and back, so that nothing is delayed. The
    ends are prolonged by their mirror image through the end point; each run begins in the steady state of its first
    value. The path must be longer than the padding."""
    poly = np.polynomial.polynomial
    c, up, down = 1 / np.tan(np.pi * cutoff / 2), [1.0, 1.0], [1.0, -1.0]
    terms = [(c**k * g) * poly.polymul(poly.polypow(down, k), poly.polypow(up, 3 - k)) for k, g in enumerate((1, 2, 2, 1))]
    a = np.sum(terms, axis=0)
    b, a = poly.polypow(up, 3) / a[0], a / a[0]
    steady = np.array([(b[i + 1 :] - a[i + 1 :]).sum() for i in range(3)])

    def run(x: np.ndarray) -> np.ndarray:
        y, z = np.empty_like(x), np.vstack([np.outer(steady, x[0]), np.zeros(x.shape[1])])
        for i, v in enumerate(x):
            y[i] = b[0] * v + z[0]
            z[:3] = np.outer(b[1:], v) - np.outer(a[1:], y[i]) + z[1:]
        return y

    x = np.concatenate([2 * path[0] - path[PADDING:0:-1], path, 2 * path[-1] - path[-2 : -PADDING - 2 : -1]])
    return run(run(x)[::-1])[::-1][PADDING:-PADDING]


def _low_pass(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("pos")
    out = group[[*EPISODE, "pos", "state"]].copy()
    out["ideal"] = list(low_pass(np.stack(group["state"].to_numpy())))
    return out


def bridge_frames_filter(frames: DataFrame, axis: DataFrame, junctions: DataFrame) -> DataFrame:
    """(episode, left, pos): of each stretch of a junction, the deleted frame closest to the episode's low-passed path, and
    closest to the cubic in episodes of up to twelve frames. An episode with a junction that is not smooth is one group.
    D3."""
    bad = junctions.where("not smooth").select(*EPISODE, "left", "right", "n_between")
    size = frames.join(bad, EPISODE, "left_semi").groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("n"))
    long = size.where(F.col("n") > PADDING).select(*EPISODE)
    ideal = frames.select(*EPISODE, "pos", "state").join(long, EPISODE, "left_semi").groupBy(*EPISODE).applyInPandas(
        _low_pass, "dataset_id string, episode_index long, pos long, state array<double>, ideal array<double>"
    )
    off = ideal.join(bad, EPISODE).where("pos > left and pos < right").withColumn("off", distance(F.col("state"), F.col("ideal")))
    return _closest(off).union(bridge_frames_curve(axis, junctions.join(long, EPISODE, "left_anti")))


def analyze_deletion(frames: DataFrame, axis: DataFrame, gone: DataFrame, k_sigma: float = 3.0) -> DataFrame:
    """Row of each episode with junctions: their number, how many are not smooth, and which deleted frames had better
    stay: ``method`` bridge (frames where the path bends) with the frames of the filter as ``alternative``, filter where
    the first finds none, none, or smooth. ``bad_after`` and ``bad_after_alternative`` are the junctions that are not
    smooth once those frames stay. ``axis`` may hold a choice of the axes of ``frames``' states. Junctions and both sets
    are written once, as each is read several times. D1."""
    chosen = axis.groupBy(*EPISODE, "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis_index", "value"))), lambda s: s["value"]).alias("state"))
    f = frames.select(*EPISODE, "pos").join(chosen, [*EPISODE, "pos"])
    j = materialize(junction_report(axis, gone, k_sigma), "junctions")
    sets = {"bridges": materialize(bridge_frames(f, j, gone), "bridges"), "filtered": materialize(bridge_frames_filter(f, axis, j), "filtered")}
    out = j.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("n_junctions"), F.count_if(~F.col("smooth")).alias("n_bad"))
    for name, kept in sets.items():
        again = junction_report(axis, delete_except_bridges(gone, kept).join(kept.select(*EPISODE), EPISODE, "left_semi"), k_sigma)
        out = out.join(kept.groupBy(*EPISODE).agg(F.array_sort(F.collect_set("pos")).alias(name)), EPISODE, "left")
        out = out.join(again.groupBy(*EPISODE).agg(F.count_if(~F.col("smooth")).alias(f"bad_{name}")), EPISODE, "left")
        # a set that keeps all the deleted frames leaves no junction; one of no frames changes nothing
        out = out.withColumn(f"bad_{name}", F.when(F.col(name).isNotNull(), F.coalesce(f"bad_{name}", F.lit(0))))
    method = F.when(F.col("n_bad") == 0, "smooth").when(F.col("bridges").isNotNull(), "bridge").when(F.col("filtered").isNotNull(), "filter").otherwise("none")
    bridge = method == "bridge"
    pick = lambda yes, no: F.when(bridge, F.col(yes)).otherwise(F.col(no))
    return out.select(
        *EPISODE, "n_junctions", "n_bad", method.alias("method"), pick("bridges", "filtered").alias("frames"), F.when(bridge, F.col("filtered")).alias("alternative"),
        pick("bad_bridges", "bad_filtered").alias("bad_after"), F.when(bridge, F.col("bad_filtered")).alias("bad_after_alternative"),
    )
