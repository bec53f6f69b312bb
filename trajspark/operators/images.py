"""Grey-frame metrics, quality scores, reports by episode and camera, and channel statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits, weights and grades of frame quality. Fixed values.
BLUR_GOOD, BLUR_ACCEPTABLE = 200.0, 50.0
BRIGHTNESS_LOW, BRIGHTNESS_HIGH = 0.15, 0.85
CONTENT_FLOOR = 15
ENTROPY_GOOD, ENTROPY_ACCEPTABLE = 6.5, 4.0
CONTRAST_GOOD, CONTRAST_ACCEPTABLE = 0.15, 0.05
EXPOSURE_WARN, EXPOSURE_BAD = 0.01, 0.10
DIFF_STATIC, DIFF_SCENE = 0.002, 0.30
WEIGHTS = {"blur": 0.35, "brightness": 0.15, "entropy": 0.20, "contrast": 0.15, "exposure": 0.15}
GRADES = ((90, "excellent"), (75, "good"), (60, "acceptable"), (40, "poor"))

CAMERA_EPISODE = ["dataset_id", "camera", "episode_index"]
MEANS = ("blur", "brightness", "brightness_content", "dark_ratio", "overexposed", "underexposed", "entropy", "contrast", "frame_diff", "quality")
METRICS = "blur double, brightness double, brightness_content double, dark_ratio double, overexposed double, underexposed double, entropy double, contrast double"


def gray_of(pixels: np.ndarray) -> np.ndarray:
    """Rounded luma of RGB pixels (height, width, 3)."""
    return np.rint(pixels @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def frame_metrics(gray: np.ndarray) -> list[float]:
    """Metrics of a grey image in the order of METRICS. F7, F8."""
    g = gray.astype(np.float64)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    share = np.bincount(gray.reshape(-1), minlength=256) / gray.size
    some = share[share > 0]
    content = g[g >= CONTENT_FLOOR]
    return [
        laplacian.var(), g.mean() / 255, (content.mean() if content.size else g.mean()) / 255, float((g < CONTENT_FLOOR).mean()),
        float((g > 250).mean()), float((g < 5).mean()), float(-(some * np.log2(some)).sum()), g.std() / 255,
    ]


def _grey(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for n, data in zip(b.column(keys + 2).to_pylist(), b.column(keys + 3).to_pylist()):
            pixels = np.frombuffer(data, np.uint8).reshape(-1, n)
            out.append(pixels[:, 0] if n == 1 else gray_of(pixels[:, 2::-1]))
        yield pa.RecordBatch.from_arrays([*b.columns[: keys + 2], pa.array([x.astype(np.int32) for x in out], pa.list_(pa.int32()))], [*b.schema.names[: keys + 2], "gray"])


def gray_frames(pictures: DataFrame) -> DataFrame:
    """(keys, height, width, gray) of pictures (keys, height, width, channels, data) whose bytes are grey, or blue, green and
    red (and opacity, which is ignored); the input of F7. S16."""
    keys = [*CAMERA_EPISODE, "pos"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pictures.select(*keys, "height", "width").schema) + ", gray array<int>"
    return pictures.select(*keys, "height", "width", "channels", "data").mapInArrow(lambda b: _grey(b, len(keys)), schema)


def _channels(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        channels, out = [], []
        for n, data in zip(b.column(keys).to_pylist(), b.column(keys + 1).to_pylist()):
            pixels = np.frombuffer(data, np.uint8).reshape(-1, n)
            pixels = pixels if n == 1 else pixels[:, 2::-1]
            channels.append(pixels.shape[1])
            out.append(pixels.reshape(-1).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*b.columns[:keys], pa.array(channels, pa.int32()), pa.array(out, pa.list_(pa.int32()))], [*b.schema.names[:keys], "channels", "data"])


def channel_frames(pictures: DataFrame) -> DataFrame:
    """(keys, channels, data) of pictures, as numbers: grey, or red, green and blue; the input of A25. S16."""
    keys = [*CAMERA_EPISODE, "pos"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pictures.select(*keys).schema) + ", channels int, data array<int>"
    return pictures.select(*keys, "channels", "data").mapInArrow(lambda b: _channels(b, len(keys)), schema)


def _measured(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [
            frame_metrics(np.asarray(v, np.uint8).reshape(h, w)) for h, w, v in zip(b.column(keys).to_pylist(), b.column(keys + 1).to_pylist(), b.column(keys + 2).to_pylist())
        ]
        columns = list(zip(*rows)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([*b.columns[:keys], *[pa.array(c, pa.float64()) for c in columns]], [*b.schema.names[:keys], *[m.split()[0] for m in METRICS.split(", ")]])


def gray_metrics(frames: DataFrame) -> DataFrame:
    """Metrics of frames (keys, height, width, gray array of 0..255). F7."""
    keys = [*CAMERA_EPISODE, "pos"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*keys).schema) + ", " + METRICS
    return frames.select(*keys, "height", "width", "gray").mapInArrow(lambda b: _measured(b, len(keys)), schema)


def frame_difference(frames: DataFrame) -> DataFrame:
    """(keys, frame_diff): mean absolute difference to the frame before over 255; 0 for the first. W7."""
    before = F.lag("gray").over(Window.partitionBy(*CAMERA_EPISODE).orderBy("pos"))
    total = F.aggregate(F.zip_with("gray", before, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return frames.select(*CAMERA_EPISODE, "pos", F.coalesce(total / F.size("gray") / 255, F.lit(0.0)).alias("frame_diff"))


def score_blur(v: Column) -> Column:
    """F1."""
    return F.when(v >= BLUR_GOOD, 100.0).when(v >= BLUR_ACCEPTABLE, 50 + 50 * (v - BLUR_ACCEPTABLE) / (BLUR_GOOD - BLUR_ACCEPTABLE)).otherwise(F.greatest(F.lit(0.0), v / BLUR_ACCEPTABLE * 50))


def score_brightness(v: Column) -> Column:
    """F2."""
    low, high = v / BRIGHTNESS_LOW * 100, (1 - v) / (1 - BRIGHTNESS_HIGH) * 100
    return F.when(v.between(BRIGHTNESS_LOW, BRIGHTNESS_HIGH), 100.0).otherwise(F.greatest(F.lit(0.0), F.when(v < BRIGHTNESS_LOW, low).otherwise(high)))


def _ramp(v: Column, good: float, fair: float) -> Column:
    return F.when(v >= good, 100.0).when(v >= fair, (v - fair) / (good - fair) * 100).otherwise(F.greatest(F.lit(0.0), v / fair * 50))


def score_entropy(v: Column) -> Column:
    """drops to 0 at the acceptable limit from below as well as above."""
    return _ramp(v, ENTROPY_GOOD, ENTROPY_ACCEPTABLE)


def score_contrast(v: Column) -> Column:
    """F4."""
    return _ramp(v, CONTRAST_GOOD, CONTRAST_ACCEPTABLE)


def score_exposure(over: Column, under: Column) -> Column:
    """F5."""
    bad = F.greatest(over, under)
    mild = 100 - (bad - EXPOSURE_WARN) / (EXPOSURE_BAD - EXPOSURE_WARN) * 80
    return F.when(bad < EXPOSURE_WARN, 100.0).when(bad < EXPOSURE_BAD, mild).otherwise(F.greatest(F.lit(0.0), 20 - (bad - EXPOSURE_BAD) / (1 - EXPOSURE_BAD) * 20))


def frame_quality(metrics: DataFrame) -> DataFrame:
    """``metrics`` with ``quality``, the weighted score. F6."""
    light = F.coalesce(F.col("brightness_content"), F.col("brightness"))
    parts = {
        "blur": score_blur(F.col("blur")), "brightness": score_brightness(light), "entropy": score_entropy(F.col("entropy")),
        "contrast": score_contrast(F.col("contrast")), "exposure": score_exposure(F.col("overexposed"), F.col("underexposed")),
    }
    total = F.lit(0.0)
    for k, w in WEIGHTS.items():
        total = total + w * parts[k]
    return metrics.withColumn("quality", total)


def problem_reasons(metrics: DataFrame) -> DataFrame:
    """``metrics`` with ``reasons``; the last two kinds don't apply to the first frame. F9."""
    light, later = F.coalesce(F.col("brightness_content"), F.col("brightness")), F.col("pos") > 0
    rules = (
        (F.col("blur") < BLUR_ACCEPTABLE, "blurry"), (light < BRIGHTNESS_LOW, "dark"), (light > BRIGHTNESS_HIGH, "bright"), (F.col("entropy") < ENTROPY_ACCEPTABLE, "low_info"),
        (F.col("overexposed") > EXPOSURE_BAD, "overexposed"), (F.col("underexposed") > EXPOSURE_BAD, "underexposed"),
        (later & (F.col("frame_diff") < DIFF_STATIC), "static"), (later & (F.col("frame_diff") > DIFF_SCENE), "scene_change"),
    )
    return metrics.withColumn("reasons", F.array_compact(F.array(*[F.when(rule, name) for rule, name in rules])))


def analyze_frames(frames: DataFrame) -> DataFrame:
    """Metrics, difference, quality and reasons of every frame."""
    m = gray_metrics(frames).join(frame_difference(frames), [*CAMERA_EPISODE, "pos"])
    return problem_reasons(frame_quality(m))


def quality_grade(score: Column) -> Column:
    """F10."""
    out = F.lit("bad")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def episode_image_summary(metrics: DataFrame) -> DataFrame:
    """A21."""
    problem = F.size("reasons") > 0
    return metrics.groupBy(*CAMERA_EPISODE).agg(
        F.count(F.lit(1)).alias("n_frames"), *[F.avg(m).alias(m) for m in MEANS], F.min("blur").alias("min_blur"), F.max("blur").alias("max_blur"),
        F.coalesce(F.try_divide(F.count_if((F.col("pos") > 0) & (F.col("frame_diff") < DIFF_STATIC)), F.count(F.lit(1)) - 1), F.lit(0.0)).alias("static_ratio"),
        F.count_if(problem).alias("n_problems"), F.avg(problem.cast("double")).alias("problem_ratio"),
    )


def image_report(summary: DataFrame) -> DataFrame:
    """By camera: mean quality over episodes, share of problem frames over frames, grade, best and worst episode (the
    first of several). A22, T3."""
    out = summary.groupBy("dataset_id", "camera").agg(
        F.count(F.lit(1)).alias("n_episodes"), F.avg("quality").alias("quality"), (F.sum("n_problems") / F.sum("n_frames")).alias("problem_ratio"),
        F.max_by("episode_index", F.struct("quality", -F.col("episode_index"))).alias("best_episode"), F.min_by("episode_index", F.struct("quality", "episode_index")).alias("worst_episode"),
    )
    return out.withColumn("grade", quality_grade(F.col("quality")))


def problem_reason_counts(metrics: DataFrame) -> DataFrame:
    """Frames by reason and their share of all problem frames. A24."""
    bad = metrics.where(F.size("reasons") > 0)
    n = bad.groupBy("dataset_id", "camera").agg(F.count(F.lit(1)).alias("n_bad"))
    r = bad.select("dataset_id", "camera", F.explode("reasons").alias("reason")).groupBy("dataset_id", "camera", "reason").agg(F.count(F.lit(1)).alias("n_frames"))
    return r.join(n, ["dataset_id", "camera"]).withColumn("share", F.col("n_frames") / F.col("n_bad")).drop("n_bad")


def episode_image_detail(metrics: DataFrame, camera: str, episode: int) -> DataFrame:
    """P25."""
    return metrics.where((F.col("camera") == camera) & (F.col("episode_index") == episode)).orderBy("pos")


def select_camera_episodes(videos: DataFrame, camera: str, episodes: DataFrame | None = None) -> DataFrame:
    """Episodes of a camera, or those of ``episodes`` that it has; an error if there are none. P18."""
    own = videos.where(F.col("camera") == camera).select("dataset_id", "episode_index").distinct()
    own = own if episodes is None else own.join(episodes, ["dataset_id", "episode_index"], "left_semi")
    if own.isEmpty():
        raise ValueError(f"no episode of camera {camera}")
    return own


def join_speed(metrics: DataFrame, speed: DataFrame) -> DataFrame:
    """Frames with the speed of the same number; what one side has beyond the other is left out. J11."""
    return metrics.join(speed.select("dataset_id", "episode_index", "pos", "speed"), ["dataset_id", "episode_index", "pos"])


def speed_blur_correlation(joined: DataFrame, least: int = 10) -> DataFrame:
    """Pearson correlation of speed and blur over all frames of a camera, if more than ``least`` pairs; with its class.
    A23, P26."""
    sx, sy = F.stddev_pop("speed"), F.stddev_pop("blur")
    r = F.when(F.count(F.lit(1)) > least, F.try_divide(F.covar_pop("speed", "blur"), sx * sy))
    out = joined.where("speed is not null and blur is not null").groupBy("dataset_id", "camera").agg(r.alias("correlation"))
    kind = F.when(F.col("correlation") < -0.3, "bad").when(F.col("correlation") < -0.1, "poor").when(F.col("correlation") < 0.1, "good").when(F.col("correlation").isNotNull(), "acceptable")
    return out.withColumn("class", kind)


def _bins(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, channel, value, count = [], [], [], []
        for i, (n, v) in enumerate(zip(b.column(keys).to_pylist(), b.column(keys + 1).to_pylist())):
            pixels = np.asarray(v, np.uint8).reshape(-1, n)
            for c in range(n):
                h = np.bincount(pixels[:, c], minlength=256)
                some = np.flatnonzero(h)
                rows += [i] * len(some)
                channel += [c] * len(some)
                value += some.tolist()
                count += h[some].tolist()
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*[b.column(k).take(take) for k in range(keys)], pa.array(channel, pa.int32()), pa.array(value, pa.int32()), pa.array(count, pa.int64())],
            [*b.schema.names[:keys], "channel", "value", "n"],
        )


def channel_stats(pixels: DataFrame) -> DataFrame:
    """Statistics in 0..1 of each channel over the sampled frames of an episode, all from counts of the 256 values;
    ``pixels``: keys, pos, channels, data (array, channels interleaved). ``frames`` is the number of frames. A25."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pixels.select(*CAMERA_EPISODE).schema) + ", channel int, value int, n long"
    counted = pixels.select(*CAMERA_EPISODE, "channels", "data").mapInArrow(lambda b: _bins(b, 3), schema)
    keys = [*CAMERA_EPISODE, "channel"]
    h = counted.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*keys).orderBy("value"))
    h = h.withColumn("upto", running).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))

    def at(position: Column) -> Column:
        """Value of a rank from 0, of whole number."""
        return F.min(F.when(F.col("upto") > position, F.col("value")))

    def quantile(q: float) -> Column:
        rank = F.lit(q) * (F.col("total") - 1)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        share = F.lit(q) * (F.max("total") - 1)
        return (low + (high - low) * (share - F.floor(share))) / 255

    mean = F.sum(F.col("value") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("value") * F.col("value") * F.col("n")) / F.sum("n")
    frames = pixels.groupBy(*CAMERA_EPISODE).agg(F.count(F.lit(1)).alias("frames"))
    out = h.groupBy(*keys).agg(
        (F.min("value") / 255).alias("min"), (F.max("value") / 255).alias("max"), (mean / 255).alias("mean"),
        (F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)) / 255).alias("std"), *[quantile(q).alias(f"q{round(q * 100):02d}") for q in (0.01, 0.1, 0.5, 0.9, 0.99)],
    )
    return out.join(frames, CAMERA_EPISODE)
