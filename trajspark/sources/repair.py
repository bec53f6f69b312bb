"""Check and repair of whole dataset folders in one call."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators import quality
from trajspark.operators.axes import EPISODE
from trajspark.session import materialize
from trajspark.sources import footers, readers, writers

#: Columns that repairs look at, for files that lack them.
COLUMNS = {"timestamp": "double", "task_index": "long", "state": "array<double>", "action": "array<double>"}
STORED = {"observation.state": "state", "action": "action"}


def _frames(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(footers, frames with all columns that repairs need, quarantine)."""
    foot = materialize(footers.read_footers(spark, [root]), "footers")
    frames, bad = footers.scan_frames_tolerant(spark, [root], foot)
    missing = {c: F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items() if c not in frames.columns}
    return foot, frames.select("*", *missing.values()), bad


def _tasks(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    lines = readers.read_jsonl(spark, [root], "tasks.jsonl", readers.TASKS)
    table = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "tasks.parquet").option("ignoreCorruptFiles", True).schema("task_index long, task string").parquet(root)
    return lines, table.select("task_index", "task", readers.dataset_of(F.col("_metadata.file_path"), "meta").alias("dataset_id"))


def _widths(info: DataFrame) -> DataFrame:
    """(dataset_id, state, action): declared numbers of axes."""
    f = readers.features(info).where(F.col("feature").isin(*STORED))
    return f.groupBy("dataset_id").agg(*[F.max(F.when(F.col("feature") == k, F.get("shape", F.lit(0)))).alias(v) for k, v in STORED.items()])


def check_datasets(spark: SparkSession, root: str, profile: str = "general") -> DataFrame:
    """All checks before training of the dataset folders below ``root``: (dataset_id, level, id, detail, fixable). K1 to
    K19 but for those of videos. Datasets of one rate and the same widths are checked together."""
    info = materialize(readers.read_info(spark, [root]), "info")
    d = materialize(readers.datasets(info), "datasets")
    foot, frames, bad = _frames(spark, root)
    lines, table = _tasks(spark, root)
    tasks = quality.repair_tasks(lines, table)
    features = readers.features(info)
    listing = readers.file_listing(spark, [root])
    out = [
        quality.file_checks(listing, d), footers.load_checks(bad, d), footers.presence_checks(foot, features, d), footers.task_index_checks(spark, [root], profile in quality.LANGUAGE),
        quality.task_checks(tasks.select("dataset_id", F.col("task_index").cast("string").alias("task_index"), "task"), frames.select(*EPISODE, "task_index"), d),
    ]
    groups = d.join(_widths(info), "dataset_id", "left").select("fps", "state", "action", "dataset_id")
    for g in groups.select("fps", "state", "action").distinct().collect():
        own = groups.where(F.col("fps").eqNullSafe(g.fps) & F.col("state").eqNullSafe(g.state) & F.col("action").eqNullSafe(g.action)).select("dataset_id")
        some, of = frames.join(own, "dataset_id", "left_semi"), d.join(own, "dataset_id", "left_semi")
        out.append(quality.frame_checks(some, of, {k: v for k, v in (("state", g.state), ("action", g.action)) if v is not None}, g.fps))
        out.append(quality.semantic_checks(some, of))
    n = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "episodes_stats.jsonl").text(root)
    n = n.select(readers.dataset_of(F.col("_metadata.file_path"), "meta").alias("dataset_id")).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    numeric = features.where(~F.col("dtype").isin("image", "video", "string")).select("dataset_id", "feature", F.get("shape", F.lit(0)).alias("dim"))
    out.append(quality.stats_checks(readers.read_stats(spark, [root]), d, numeric, n, tuple(STORED)))
    return materialize(reduce(DataFrame.union, out), "checks")


def _copied(files: DataFrame, source: str, target: str) -> DataFrame:
    """Copies of ``files`` (path below ``source``), a stretch of bytes at a time: (path, n_rows, bytes)."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = writers._files(source)
        for b in batches:
            for path in b.column(0).to_pylist():
                part = writers._Part(target, path)
                with fs.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                    while chunk := stream.read(8 << 20):
                        part.out.write(chunk)
                yield writers._told([part.done()])

    return files.select("path").repartition("path").mapInArrow(copy, writers._WRITTEN)


def _merged_infos(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, text): the source's info.json with the totals and paths of the repaired one, and features it lacks."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for one, two in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                one, two = json.loads(one or "{}"), json.loads(two)
                kept = {k: v for k, v in one.items() if k not in ("total_episodes", "total_frames", "total_tasks", "total_chunks", "data_path", "splits")}
                features = two.get("features", {}) | {k: v for k, v in (one.get("features") or {}).items() if k in two.get("features", {}) or v.get("dtype") in ("image", "video")}
                texts.append(json.dumps(two | kept | {"features": features}, ensure_ascii=False, indent=2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["path", "text"])

    both = new.join(old, "dataset_id", "left").select(F.concat("dataset_id", F.lit("/meta/info.json")).alias("path"), F.to_json("old_info").alias("old"), "text")
    return both.mapInArrow(merge, "path string, text string")


def repair_dataset(spark: SparkSession, source: str, target: str, overwrite: bool = False, profile: str = "general") -> DataFrame:
    """Repaired copies below ``target`` of the dataset folders below ``source``, which stay as they are: tasks from
    whichever file has them, frame numbers, times, indexes and task numbers, episode metadata, totals and statistics of
    datasets in the v2.1 layout; of others the tasks alone. All other files are copied.

    The copy is made in ``target``.staging and listed in its manifest.jsonl; then it takes its place whole, so a call that
    was stopped can be made again and nothing half done is ever at ``target``. Returns (dataset_id, n_pass, n_warn, n_error,
    n_fixable, status) of the result's checks. R1 (R2 to R5, then K1 to K19)."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the repaired copy must not take the source's place")
    files, place = writers._files(target)
    there = files.get_file_info(place).type.name != "NotFound"
    if there and not overwrite:
        raise ValueError(f"{target} is there already")
    staging = f"{target.rstrip('/')}.staging"
    info = materialize(readers.read_info(spark, [source]), "info")
    d = readers.datasets(info)
    current = d.where("version = 'v2.1'")
    _, frames, _ = _frames(spark, source)
    frames = frames.join(current.select("dataset_id"), "dataset_id", "left_semi")
    tasks = materialize(quality.repair_tasks(*_tasks(spark, source)).dropDuplicates(["dataset_id", "task_index"]), "tasks")
    episodes = readers.read_jsonl(spark, [source], "episodes.jsonl", readers.EPISODES).where("episode_index IS NOT NULL")
    told = episodes.groupBy(*EPISODE).agg(F.first(F.col("task_index").try_cast("long"), True).alias("task_index"))
    done = []
    for r in current.select("fps").distinct().collect():
        own = frames.join(current.where(F.col("fps") == r.fps).select("dataset_id"), "dataset_id", "left_semi")
        fixed, _ = quality.repair_frames(own, told, r.fps)
        fixed = materialize(fixed.withColumn("frame_index", F.col("pos")), "repaired")
        named = fixed.select(*EPISODE, "task_index").distinct().join(tasks, ["dataset_id", "task_index"]).groupBy(*EPISODE).agg(F.array_sort(F.collect_set("task")).alias("tasks"))
        of = tasks.join(fixed.select("dataset_id").distinct(), "dataset_id", "left_semi")
        done.append(writers.write_dataset(fixed, named, of, staging, fps=r.fps))
    # the infos that were just written are the new ones
    new = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "info.json").text(staging, wholetext=True) if done else None
    if new is not None:
        new = materialize(new.select(readers.dataset_of(F.col("_metadata.file_path"), "meta").alias("dataset_id"), F.col("value").alias("text")), "new-infos")
        materialize(writers.write_texts(_merged_infos(info.withColumnRenamed("info", "old_info"), new), staging), "written")
    old = tasks.join(current.select("dataset_id"), "dataset_id", "left_anti")
    done.append(materialize(writers.write_lines(writers.jsonl(old, "meta/tasks.jsonl", "task_index"), staging), "written"))
    listing = readers.file_listing(spark, [source]).select("dataset_id", F.concat("dataset_id", F.lit("/"), "rel_path").alias("path"), "rel_path")
    tabled = tasks.join(listing.where("rel_path = 'meta/tasks.parquet'").select("dataset_id").distinct(), "dataset_id", "left_semi")
    done.append(materialize(writers.write_tasks_table(tabled, staging), "written"))
    have = reduce(DataFrame.union, done)
    rest = listing.join(have, "path", "left_anti").join(current.select("dataset_id", F.lit(True).alias("current")), "dataset_id", "left")
    # data files of the v2.1 layout that were not written again can't be read
    rest = rest.where(~(F.coalesce("current", F.lit(False)) & F.startswith("rel_path", F.lit("data/")) & F.endswith("rel_path", F.lit(".parquet"))))
    done.append(materialize(_copied(rest, source, staging), "copied"))
    manifest = reduce(DataFrame.union, done)
    at = F.xxhash64("path")
    materialize(writers.write_lines(manifest.select(F.lit("manifest.jsonl").alias("path"), at.alias("at"), F.to_json(F.struct("path", "n_rows", "bytes")).alias("line")), staging), "written")
    if there:
        files.move(place, f"{place.rstrip('/')}.before")
    files.move(f"{place.rstrip('/')}.staging", place)
    if there:
        files.delete_dir(f"{place.rstrip('/')}.before")
    return quality.finalize_checks(check_datasets(spark, target, profile))
