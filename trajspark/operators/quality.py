"""Checks before training, repairs, comparison of statistics, video consistency, and the health score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.operators import lag, motion, stats
from trajspark.operators.axes import EPISODE, FPS, explode_axes, finite, sanitize_timestamps
from trajspark.operators.edits import renumber_frames

#: Weights of the health score, its grades and levels, and what statistics must hold. Fixed values.
HEALTH_WEIGHTS = {"integrity": 0.20, "completeness": 0.15, "smoothness": 0.20, "coverage": 0.15, "constraint": 0.10, "alignment": 0.10, "image_quality": 0.10}
HEALTH_GRADES = ((85, "A"), (70, "B"), (55, "C"), (40, "D"))
HEALTH_LEVELS = ((75, "good"), (50, "warn"))
REQUIRED_METRICS = ("min", "max", "mean", "std", "count", "q01", "q10", "q50", "q90", "q99")
REQUIRED_FILES = ("meta/info.json", "meta/episodes.jsonl", "meta/tasks.jsonl", "meta/stats.json", "meta/episodes_stats.jsonl")
LEVELS = ("pass", "warn", "error")
#: Profiles of models that read language. Fixed values.
LANGUAGE = ("pi05", "pi0", "pi0.5", "openvla", "vla")


def ladder(score: Column, steps: tuple, rest: str) -> Column:
    out = F.lit(rest)
    for least, name in reversed(steps):
        out = F.when(score >= least, name).otherwise(out)
    return out


def health_grade(score: Column) -> Column:
    """F11."""
    return ladder(score, HEALTH_GRADES, "F")


def health_level(score: Column) -> Column:
    """F11."""
    return ladder(score, HEALTH_LEVELS, "bad")


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """F15."""
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def safe_mean(x: Column) -> Column:
    """Mean of the finite values, 0 where there are none. F15."""
    return F.coalesce(F.avg(finite(x)), F.lit(0.0))


def safe_max(x: Column) -> Column:
    """Largest finite value, 0 where there are none. F15."""
    return F.coalesce(F.max(finite(x)), F.lit(0.0))


# --- comparison of statistics -----------------------------------------------------------------------------------------


def long_stats(s: DataFrame, metrics: list[str]) -> DataFrame:
    """(dataset, feature, metric, axis_index, value) of statistics with one column per metric."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col("n" if m == "count" else m).cast("double").alias("value")) for m in metrics]))
    return s.select("dataset_id", F.col("source").alias("feature"), "axis_index", cells.alias("c")).select("dataset_id", "feature", "c.metric", "axis_index", "c.value")


def diff_stats(a: DataFrame, b: DataFrame, tolerance: float = 1e-4, by: tuple[str, ...] = ()) -> DataFrame:
    """By feature and metric: whether both sides have it with as many axes, the largest absolute and relative
    difference, and whether it matches. ``by``: more columns that both sides are compared by. J9, G8."""
    keys = ["dataset_id", "feature", "metric", *by]
    both = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), [*keys, "axis_index"], "full_outer")
    gap = F.abs(F.col("a") - F.col("b"))
    out = both.groupBy(*keys).agg(
        F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.max(gap).alias("max_abs"), F.max(gap / F.greatest(F.abs("a"), F.lit(1e-12))).alias("max_rel"),
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_single"),
    )
    return out.select(*keys, "n_a", "n_b", "max_abs", "max_rel", ((F.col("n_single") == 0) & (F.col("max_abs") <= tolerance)).alias("match"))


def overall_match(diff: DataFrame) -> DataFrame:
    return diff.groupBy("dataset_id").agg(F.bool_and("match").alias("match"), F.count_if(~F.col("match")).alias("n_mismatches"))


def verify_stats(frames: DataFrame, stored: DataFrame, stored_episodes: DataFrame, vectors: list[str], scalars: list[str], tolerance: float = 1e-4, widths: dict[str, int] | None = None) -> DataFrame:
    """Recomputed statistics against the stored ones of the dataset (against = stats) and against the merge of the stored
    ones of its episodes (against = episodes_stats). They are recomputed once for both; ``widths`` as in
    ``stats.recompute_stats``. V1."""
    metrics = ["mean", "std", "min", "max", "count"]
    fresh = long_stats(stats.recompute_stats(frames, vectors, scalars, widths, quantiles=False), metrics)
    both = fresh.withColumn("against", F.explode(F.array(F.lit("stats"), F.lit("episodes_stats"))))
    merged = long_stats(stats.merge_stats(stored_episodes), metrics).withColumn("against", F.lit("episodes_stats"))
    out = diff_stats(both, stored.withColumn("against", F.lit("stats")).unionByName(merged), tolerance, ("against",))
    return out.select(*[c for c in out.columns if c != "against"], "against")


# --- references and videos --------------------------------------------------------------------------------------------


def unknown_task_refs(refs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Task numbers in use that no task has. J6."""
    return refs.where("task_index is not null").select("dataset_id", "task_index").distinct().join(tasks.select("dataset_id", "task_index"), ["dataset_id", "task_index"], "left_anti")


def missing_videos(episodes: DataFrame, video_features: DataFrame, videos: DataFrame) -> DataFrame:
    """Episodes and video features without a file under the key or its last part. J12."""
    wanted = episodes.select(*EPISODE).join(video_features.select("dataset_id", "feature"), "dataset_id")
    wanted = wanted.withColumn("camera", F.element_at(F.split("feature", r"\."), -1))
    have = videos.select(*EPISODE, F.col("camera").alias("have")).distinct()
    by_key = wanted.join(have, (wanted["dataset_id"] == have["dataset_id"]) & (wanted["episode_index"] == have["episode_index"]) & (wanted["feature"] == have["have"]), "left_anti")
    return by_key.join(have, (by_key["dataset_id"] == have["dataset_id"]) & (by_key["episode_index"] == have["episode_index"]) & (by_key["camera"] == have["have"]), "left_anti").select(*EPISODE, "feature")


def probe_fallbacks(videos: DataFrame) -> DataFrame:
    """``fps`` from text like 30/1 where needed, ``nb_frames`` from fps and duration where missing. S7."""
    parts = F.split(F.col("fps").cast("string"), "/")
    fps = F.when(F.size(parts) == 2, F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))).otherwise(F.get(parts, F.lit(0)).try_cast("double"))
    v = videos.withColumn("fps", fps)
    return v.withColumn("nb_frames", F.coalesce(F.col("nb_frames").cast("long"), F.bround(F.col("fps") * F.col("duration")).cast("long")))


def check_video_integrity(videos: DataFrame, lengths: DataFrame, fps: float = FPS, fps_tolerance: float = 0.01, frame_tolerance: int = 0) -> DataFrame:
    """A row per episode and camera with its issues: rate, frames, duration by over two frames; a file that was not
    probed is a warning. J4."""
    v = videos.join(lengths.select(*EPISODE, "length"), EPISODE)
    probed = F.col("fps").isNotNull()
    rules = (
        (~probed, "not probed"), (probed & (F.abs(F.col("fps") - fps) / fps > fps_tolerance), "frame rate"),
        (probed & (F.abs(F.col("nb_frames") - F.col("length")) > frame_tolerance), "frame count"),
        (probed & (F.abs(F.col("duration") - F.col("length") / fps) > 2 / fps), "duration"),
    )
    v = v.withColumn("issues", F.array_compact(F.array(*[F.when(rule, name) for rule, name in rules])))
    level = F.when(F.size("issues") == 0, "ok").when(F.array_contains("issues", "not probed"), "warning").otherwise("error")
    return v.select(*EPISODE, "camera", "issues", level.alias("level"))


def video_checks(episodes: DataFrame, video_features: DataFrame, videos: DataFrame, datasets: DataFrame, examples: int = 5) -> DataFrame:
    """Check row of each dataset on the files of its video features. K20."""
    bad = missing_videos(episodes, video_features, videos)
    found = datasets.select("dataset_id").join(_examples(bad, F.format_string("episode %d %s", "episode_index", "feature"), examples), "dataset_id", "left")
    return check(found, "video.files", F.col("n_bad").isNotNull(), F.format_string("%d missing: %s", "n_bad", "examples"))


def info_checks(info: DataFrame) -> DataFrame:
    """Check row of each dataset on whether its info.json can be parsed; ``info``: dataset_id, info VARIANT. K1."""
    return check(info, "structure.info_parse", F.coalesce(F.schema_of_variant("info").startswith("OBJECT"), F.lit(False)) == F.lit(False), F.lit("not a JSON object"))


def affected_episodes(integrity: DataFrame) -> DataFrame:
    rank = F.when(F.col("level") == "error", 2).when(F.col("level") == "warning", 1).otherwise(0)
    worst = integrity.groupBy(*EPISODE).agg(F.max(rank).alias("rank")).where("rank > 0")
    return worst.select(*EPISODE, F.when(F.col("rank") == 2, "error").otherwise("warning").alias("level"))


# --- checks: (dataset_id, level, id, detail, fixable) -----------------------------------------------------------------


def check(df: DataFrame, name: str, bad: Column, detail: Column, level: str = "error", fixable: bool = False) -> DataFrame:
    return df.select("dataset_id", F.when(bad, level).otherwise("pass").alias("level"), F.lit(name).alias("id"), F.when(bad, detail).otherwise("").alias("detail"), (bad & F.lit(fixable)).alias("fixable"))


def _examples(bad: DataFrame, text: Column, n: int = 5) -> DataFrame:
    """First n messages of each dataset. T6."""
    ranked = bad.withColumn("__r", F.row_number().over(Window.partitionBy("dataset_id").orderBy("episode_index")))
    return ranked.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_bad"), F.array_join(F.array_compact(F.array_sort(F.collect_list(F.when(F.col("__r") <= n, text)))), "; ").alias("examples"),
    )


def file_checks(files: DataFrame, datasets: DataFrame) -> DataFrame:
    """Presence of the metadata files; ``files``: dataset_id, rel_path. K1, K2, K3."""
    wanted = datasets.select("dataset_id", F.explode(F.array(*[F.lit(f) for f in REQUIRED_FILES])).alias("rel_path"))
    have = files.select("dataset_id", "rel_path", F.lit(True).alias("have")).distinct()
    j = wanted.join(have, ["dataset_id", "rel_path"], "left")
    missing = F.col("have").isNull()
    present = j.select("dataset_id", F.when(missing, "error").otherwise("pass").alias("level"), F.concat(F.lit("structure."), "rel_path").alias("id"), F.when(missing, "missing").otherwise("").alias("detail"), F.lit(False).alias("fixable"))
    return present.union(check(datasets, "structure.version", ~F.col("version").eqNullSafe("v2.1"), F.concat(F.lit("version "), F.coalesce("version", F.lit("unknown"))), "warn"))


def frame_checks(frames: DataFrame, datasets: DataFrame, dims: dict[str, int], fps: float = FPS, examples: int = 5) -> DataFrame:
    """Totals, episode numbers, frame numbers, times, the global index, and width and finiteness of the vectors.
    K5, K6, K8 to K12, W17."""
    order = Window.partitionBy(*EPISODE).orderBy("pos")
    episodes = frames.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("length"))
    totals = episodes.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("e"), F.sum("length").alias("f"), F.min("episode_index").alias("low"), F.max("episode_index").alias("high")
    ).join(datasets.select("dataset_id", "total_episodes", "total_frames"), "dataset_id", "right")
    out = [
        check(totals, "structure.total_episodes", ~F.col("e").eqNullSafe(F.col("total_episodes")), F.format_string("%d declared, %d found", "total_episodes", "e"), fixable=True),
        check(totals, "structure.total_frames", ~F.col("f").eqNullSafe(F.col("total_frames")), F.format_string("%d declared, %d found", "total_frames", "f"), fixable=True),
        check(totals, "structure.episode_index_contiguous", ~((F.col("low") == 0) & (F.col("high") == F.col("e") - 1)), F.lit("not 0 to n - 1"), fixable=True),
    ]
    first = Window.partitionBy("dataset_id").orderBy("episode_index")
    start = episodes.select(*EPISODE, (F.sum("length").over(first) - F.col("length")).alias("start"))
    f = frames.join(start, EPISODE)
    f = f.withColumn("row", F.row_number().over(order) - 1).withColumn("dt", F.col("timestamp") - F.lag("timestamp").over(order))
    per = [F.count_if(~F.col("frame_index").eqNullSafe(F.col("row"))).alias("bad_number")] if "frame_index" in frames.columns else [F.lit(0).alias("bad_number")]
    per += [F.count_if(~F.col("index").eqNullSafe(F.col("start") + F.col("row"))).alias("bad_index")] if "index" in frames.columns else [F.lit(0).alias("bad_index")]
    late = F.coalesce(F.abs(F.avg("dt") - 1 / fps) > 0.05 / fps, F.lit(False))
    per += [((F.count_if(F.col("timestamp").isNull() | F.isnan("timestamp")) > 0) | F.coalesce(F.min("dt") <= 0, F.lit(False)) | late).alias("bad_time")]
    for name, dim in dims.items():
        v = F.col(name)
        per += [F.count_if(v.isNull() | (F.size(v) != dim)).alias(f"bad_{name}"), F.count_if(F.coalesce(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))).alias(f"odd_{name}")]
    e = f.groupBy(*EPISODE).agg(*per)
    for name, bad, level in (("temporal.frame_index", F.col("bad_number") > 0, "error"), ("temporal.timestamp", F.col("bad_time"), "error"), ("temporal.global_index", F.col("bad_index") > 0, "warn"),
                             *[(f"dtype.{n}", F.col(f"bad_{n}") > 0, "error") for n in dims], *[(f"dtype.{n}.finite", F.col(f"odd_{n}") > 0, "error") for n in dims]):
        found = datasets.select("dataset_id").join(_examples(e.where(bad), F.format_string("episode %d", "episode_index"), examples), "dataset_id", "left")
        out.append(check(found, name, F.col("n_bad").isNotNull(), F.col("examples"), level, not name.startswith("dtype")))
    result = out[0]
    for o in out[1:]:
        result = result.union(o)
    return result


def task_checks(tasks: DataFrame, refs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Task rows and references to them. K13, K14."""
    blank = tasks.groupBy("dataset_id").agg(F.count_if(F.col("task_index").try_cast("long").isNull() | F.col("task").isNull() | (F.trim("task") == "")).alias("n"))
    rows = datasets.select("dataset_id").join(blank, "dataset_id", "left")
    unknown = unknown_task_refs(refs, tasks).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    seen = datasets.select("dataset_id").join(unknown, "dataset_id", "left")
    return check(rows, "task.tasks_jsonl", F.coalesce(F.col("n") > 0, F.lit(True)), F.lit("missing or blank tasks"), fixable=True).union(
        check(seen, "task.task_index_refs", F.coalesce(F.col("n") > 0, F.lit(False)), F.format_string("%d unknown tasks", "n"))
    )


def task_typecheck(datasets: DataFrame, task_dtype: str | None, profile: str) -> DataFrame:
    """A frame column ``task`` must be text; an error where the model reads language. K15."""
    level = "error" if profile in LANGUAGE else "warn"
    return check(datasets, "task.parquet_task_type", F.lit(task_dtype not in (None, "string")), F.lit(f"type {task_dtype}"), level, True)


def stats_checks(stored: DataFrame, datasets: DataFrame, features: DataFrame, n_episode_stats: DataFrame, required: tuple = ("state", "action")) -> DataFrame:
    """Every declared feature has all metrics, finite, of size 1 or its dimension; as many episode statistics as
    episodes. K16, K17. ``stored``: dataset_id, feature, metric, axis_index, value; ``n_episode_stats``: dataset_id, n."""
    s = stored.groupBy("dataset_id", "feature", "metric").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).alias("odd"))
    g = features.select("dataset_id", "feature", "dim").join(s, ["dataset_id", "feature"], "left").groupBy("dataset_id", "feature", "dim").agg(
        F.collect_set("metric").alias("have"), F.max(F.coalesce((F.col("size") != 1) & (F.col("size") != F.col("dim")), F.lit(False))).alias("wrong"), F.sum(F.coalesce("odd", F.lit(0))).alias("odd"),
    )
    missing = F.array_except(F.array(*[F.lit(m) for m in REQUIRED_METRICS]), "have")
    bad = (F.size(missing) > 0) | F.col("wrong") | (F.col("odd") > 0)
    level = F.when(~bad, "pass").when(F.col("feature").isin(*required), "error").otherwise("warn")
    each = g.select("dataset_id", level.alias("level"), F.concat(F.lit("stats."), "feature").alias("id"), F.when(bad, F.array_join(F.array_sort(missing), ",")).otherwise("").alias("detail"), bad.alias("fixable"))
    n = datasets.select("dataset_id", "total_episodes").join(n_episode_stats, "dataset_id", "left")
    return each.union(check(n, "stats.episodes_stats_count", ~F.col("n").eqNullSafe(F.col("total_episodes")), F.format_string("%d of %d", F.coalesce("n", F.lit(0)), "total_episodes"), "warn", True))


def semantic_checks(frames: DataFrame, datasets: DataFrame, jump: float = 10.0) -> DataFrame:
    """Action axes that never move, and steps above the limit. K19."""
    still = motion.static_axes(explode_axes(frames, "action")).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    d = datasets.select("dataset_id").join(still, "dataset_id", "left").join(motion.max_action_jump(frames), "dataset_id", "left")
    return check(d, "semantic.action_static", F.coalesce(F.col("n") > 0, F.lit(False)), F.format_string("%d axes", "n"), "warn").union(
        check(d, "semantic.action_jump", F.coalesce(F.col("max_jump") > jump, F.lit(False)), F.format_string("%.3f", "max_jump"), "warn")
    )


def finalize_checks(checks: DataFrame) -> DataFrame:
    """Numbers by level and the status: error before warn before pass. K21."""
    counts = [F.count_if(F.col("level") == x).alias(f"n_{x}") for x in LEVELS]
    c = checks.groupBy("dataset_id").agg(*counts, F.count_if("fixable").alias("n_fixable"))
    return c.withColumn("status", F.when(F.col("n_error") > 0, "error").when(F.col("n_warn") > 0, "warn").otherwise("pass"))


# --- repairs ----------------------------------------------------------------------------------------------------------


def repair_tasks(jsonl: DataFrame, parquet: DataFrame) -> DataFrame:
    """Valid rows of the first source, or of the second where a dataset has none in the first. R2, L4."""
    good = lambda t: t.select("dataset_id", F.col("task_index").try_cast("long").alias("task_index"), F.trim("task").alias("task")).where("task_index is not null and task <> ''")
    one = good(jsonl)
    return one.union(good(parquet).join(one.select("dataset_id").distinct(), "dataset_id", "left_anti"))


def repair_frames(frames: DataFrame, episodes: DataFrame, fps: float = FPS) -> tuple[DataFrame, DataFrame]:
    """(repaired frames, episodes with what changed): frame numbers and index, times of episodes whose times don't rise,
    tasks from the metadata where missing. R3."""
    f = renumber_frames(frames)
    from trajspark.operators.edits import episode_offsets

    f = f.join(episode_offsets(frames).select(*EPISODE, "first_frame"), EPISODE).withColumn("__index", F.col("first_frame") + F.col("pos")).drop("first_frame")
    f = sanitize_timestamps(f.withColumn("__time", F.col("timestamp")), fps)
    known = episodes.select(*EPISODE, F.col("task_index").cast("long").alias("__meta"))
    f = f.join(known, EPISODE, "left").withColumn("__task", F.coalesce(F.col("task_index").cast("long"), "__meta", F.lit(0)))
    differs = ~F.col("__time").eqNullSafe(F.col("timestamp")) | ~F.col("task_index").cast("long").eqNullSafe(F.col("__task"))
    if "index" in frames.columns:
        differs = differs | ~F.col("index").eqNullSafe(F.col("__index"))
    changed = f.groupBy(*EPISODE).agg(F.count_if(differs).alias("n_changed")).where("n_changed > 0")
    out = f.withColumn("index", F.col("__index")).withColumn("task_index", F.col("__task")).drop("__index", "__time", "__meta", "__task", "task")
    return out, changed


def repair_metadata(frames: DataFrame) -> DataFrame:
    """Episode rows from the frames: length and first task. R4."""
    return frames.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("length"), F.min_by("task_index", "pos").cast("long").alias("task_index"))


# --- health: (dataset_id, dimension, score, available) ----------------------------------------------------------------


def _dimension(df: DataFrame, name: str, score: Column, available: Column | bool = True) -> DataFrame:
    known = available if isinstance(available, Column) else F.lit(available)
    return df.select("dataset_id", F.lit(name).alias("dimension"), F.round(clamp(score), 1).alias("score"), known.alias("available"))


def score_integrity(integrity: DataFrame) -> DataFrame:
    """H1."""
    s = integrity.groupBy("dataset_id").agg(F.avg((F.col("level") == "error").cast("double")).alias("e"), F.avg((F.col("level") == "warning").cast("double")).alias("w"))
    score = F.when(F.col("w") == 1, 30.0).when(F.col("e") > 0, 80 * (1 - 2 * F.col("e")) - 10 * F.col("w")).otherwise(100 - 15 * F.col("w"))
    return _dimension(s, "integrity", score)


def score_completeness(files: DataFrame, datasets: DataFrame, lengths: DataFrame) -> DataFrame:
    """H2."""
    needed = REQUIRED_FILES[:4]
    have = files.groupBy("dataset_id").agg(F.collect_set("rel_path").alias("have"))
    n = lengths.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("found"))
    d = datasets.join(have, "dataset_id", "left").join(n, "dataset_id", "left")
    missing = F.size(F.array_except(F.array(*[F.lit(f) for f in needed]), F.coalesce("have", F.array().cast("array<string>"))))
    score = F.when(missing > 0, 100 - 30 * missing).when(~F.col("found").eqNullSafe(F.col("total_episodes")), 60.0).when(~F.array_contains("have", REQUIRED_FILES[4]), 90.0).otherwise(100.0)
    return _dimension(d, "completeness", score)


def score_smoothness(derived: DataFrame) -> DataFrame:
    """Mean spike ratio of the five axes of most second difference of each source. H3."""
    m = motion.temporal_metrics(derived).select(*motion.SERIES, "jerk").where("jerk is not null")
    top = m.withColumn("__r", F.row_number().over(Window.partitionBy("dataset_id", "source").orderBy(F.desc("jerk"), "axis_index"))).where("__r <= 5")
    s = motion.spike_ratio(derived).join(top, motion.SERIES, "left_semi").groupBy("dataset_id").agg(F.avg("spike_ratio").alias("spike"))
    every = derived.select("dataset_id").distinct().join(s, "dataset_id", "left")
    return _dimension(every, "smoothness", F.coalesce(100 - F.col("spike") / 0.15 * 100, F.lit(70.0)))


def score_coverage(axis: DataFrame) -> DataFrame:
    """H4."""
    s = stats.sigma_coverage(axis).groupBy("dataset_id").agg(F.avg("within_1").alias("w"))
    return _dimension(s, "coverage", 100 - 200 * F.abs(F.col("w") - 0.68), F.col("w").isNotNull())


def score_constraint(derived: DataFrame, limits: DataFrame) -> DataFrame:
    """H5."""
    m = motion.constraint_metrics(derived, limits).groupBy("dataset_id").agg(F.max("position_ratio").alias("p"), F.max("velocity_ratio").alias("v"))
    zero = F.lit(0.0)
    d = derived.select("dataset_id").distinct().join(m, "dataset_id", "left")
    return _dimension(d, "constraint", 100 - 500 * F.coalesce("p", zero) - 300 * F.coalesce("v", zero), F.col("p").isNotNull() | F.col("v").isNotNull())


def score_alignment(frames: DataFrame, axis: DataFrame, fps: float = FPS) -> DataFrame:
    """H6."""
    t = motion.timestamp_summary(sanitize_timestamps(frames, fps), fps)
    ls = lag.lag_summary(lag.state_action_lag(axis, fps)).select("dataset_id", "median_lag", "mean_abs_correlation")
    d = frames.select("dataset_id").distinct().join(t, "dataset_id", "left").join(ls, "dataset_id", "left")
    jitter, most, lagged = F.col("mean_jitter") * fps, F.col("max_jitter") * fps, F.abs("median_lag")
    off = F.when(F.col("n").isNull(), 20).otherwise(F.when(jitter > 0.1, 30).when(jitter > 0.05, 15).otherwise(0) + F.when(most > 0.5, 10).otherwise(0))
    off = off + F.when(lagged >= 2, 25).when(lagged >= 1, 10).otherwise(0) + F.when(F.col("mean_abs_correlation") < 0.7, 15).otherwise(0)
    return _dimension(d, "alignment", 100.0 - off)


def score_image_quality(report: DataFrame) -> DataFrame:
    """First camera of each dataset. H7."""
    first = report.groupBy("dataset_id").agg(F.min_by("quality", "camera").alias("q"))
    return _dimension(first, "image_quality", F.col("q"), F.col("q").isNotNull())


def health_report(dimensions: DataFrame) -> DataFrame:
    """Weighted mean of what is available, and the grade. H8."""
    weight = F.create_map(*[F.lit(x) for p in HEALTH_WEIGHTS.items() for x in p])[F.col("dimension")]
    w = F.when(F.col("available"), weight)
    out = dimensions.groupBy("dataset_id").agg(F.try_divide(F.sum(F.col("score") * w), F.sum(w)).alias("score"), F.count_if("available").alias("n_dimensions"))
    out = out.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 1))
    return out.withColumn("grade", health_grade(F.col("score"))).withColumn("level", health_level(F.col("score")))
