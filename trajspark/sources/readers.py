"""Dataset folders as DataFrames: many roots at once, rows tagged with ``dataset_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators.axes import materialize_vector

EPISODES = "episode_index long, length long, task_index string, tasks array<string>"
TASKS = "task_index string, task string"


def dataset_of(path: Column, marker: str) -> Column:
    """Name of the folder above ``marker`` in a path."""
    return F.regexp_extract(path, rf"([^/]+)/{marker}(?:/|$)", 1)


def read_jsonl(spark: SparkSession, roots: list[str], name: str, schema: str) -> DataFrame:
    """Lines of meta/<name> of all roots; a root without the file adds none. S3."""
    parts = [spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).schema(schema).json(r) for r in roots]
    out = parts[0].select("*", F.col("_metadata.file_path").alias("__p"))
    for p in parts[1:]:
        out = out.union(p.select("*", F.col("_metadata.file_path").alias("__p")))
    return out.withColumn("dataset_id", dataset_of(F.col("__p"), "meta")).drop("__p")


def read_info(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(dataset_id, info VARIANT) of each root's info.json. S4."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "info.json").text(roots, wholetext=True)
    return text.select(dataset_of(F.col("_metadata.file_path"), "meta").alias("dataset_id"), F.try_parse_json("value").alias("info"))


def datasets(info: DataFrame) -> DataFrame:
    """S13, P1."""
    get = lambda path, kind: F.try_variant_get("info", f"$.{path}", kind)
    return info.select(
        "dataset_id", get("codebase_version", "string").alias("version"), F.coalesce(get("fps", "double"), F.lit(30.0)).alias("fps"), get("robot_type", "string").alias("robot_type"),
        get("total_episodes", "long").alias("total_episodes"), get("total_frames", "long").alias("total_frames"), F.coalesce(get("chunks_size", "long"), F.lit(1000)).alias("chunks_size"),
    )


def features(info: DataFrame) -> DataFrame:
    """(dataset_id, feature, dtype, shape, raw), a row per declared feature. S4, P4."""
    entries = info.sparkSession.tvf.variant_explode(F.try_variant_get("info", "$.features", "variant").outer())
    e = info.lateralJoin(entries).select("dataset_id", F.col("key").alias("feature"), F.col("value").alias("raw"))
    return e.select("dataset_id", "feature", F.try_variant_get("raw", "$.dtype", "string").alias("dtype"), F.try_variant_get("raw", "$.shape", "array<int>").alias("shape"), "raw")


def scan_frames(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Frames of all episode files; the episode's number comes from the file's name, the position from the row. Vectors
    split over columns are put together. S1, S2, S5."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "episode_*.parquet").option("mergeSchema", True).parquet(*roots)
    names = {c: c.replace("observation.", "") for c in df.columns if c.startswith("observation.")}
    path = F.col("_metadata.file_path")
    df = df.select(
        *[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns if c != "episode_index"], F.col("_metadata.row_index").alias("pos"),
        F.regexp_extract(path, r"episode_(\d+)\.parquet", 1).cast("long").alias("episode_index"), dataset_of(path, "data").alias("dataset_id"),
    )
    for key in ("state", "action"):
        df = materialize_vector(df, key)
    return df


def list_episodes(episodes: DataFrame) -> DataFrame:
    """Episodes with their lengths and task numbers, 0 where there is none. P2."""
    return episodes.select("dataset_id", "episode_index", "length", F.coalesce(F.try_to_number("task_index", F.lit("999999999")).cast("long"), F.lit(0)).alias("task_index"))


def episode_frames(frames: DataFrame, episode: int) -> DataFrame:
    """One episode's frames in order, missing times as 0. P3."""
    return frames.where(F.col("episode_index") == episode).withColumn("timestamp", F.coalesce("timestamp", F.lit(0.0))).orderBy("dataset_id", "pos")


def stats_keys(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(dataset_id, feature) of each root's stats.json. P24."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "stats.json").text(roots, wholetext=True)
    return text.select(dataset_of(F.col("_metadata.file_path"), "meta").alias("dataset_id"), F.explode(F.json_object_keys("value")).alias("feature"))


def read_stats(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(dataset_id, feature, metric, axis_index, value) of each root's stats.json; single numbers are axis 0."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "stats.json").text(roots, wholetext=True)
    s = text.select(dataset_of(F.col("_metadata.file_path"), "meta").alias("dataset_id"), F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("feature", "metrics"))
    s = s.select("dataset_id", "feature", F.explode("metrics").alias("metric", "text"))
    values = F.coalesce(F.from_json("text", "array<double>"), F.array(F.col("text").try_cast("double")))
    return s.select("dataset_id", "feature", "metric", F.posexplode(values).alias("axis_index", "value"))


def table_preview(df: DataFrame, rows: int = 20) -> tuple[list[tuple[str, str]], int, DataFrame]:
    """(columns and types, row count, first rows). S15."""
    return df.dtypes, df.count(), df.limit(rows)


def video_inventory(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Video files with camera and episode; contents are not read. S6."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mp4").load(roots).select("path", F.col("length").alias("bytes"))
    parts = F.split(F.regexp_extract("path", r"/videos/(.*)$", 1), "/")
    key = F.when(F.startswith(F.get(parts, F.lit(0)), F.lit("chunk-")), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    return f.select(
        dataset_of(F.col("path"), "videos").alias("dataset_id"), F.regexp_extract("path", r"episode_(\d+)\.mp4", 1).try_cast("long").alias("episode_index"), key.alias("video_key"),
        F.element_at(F.split(key, r"\."), -1).alias("camera"), "path", "bytes",
    )


def file_listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(dataset_id, rel_path, subdir, bytes) of all files below the roots. S14, S21, S22."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", F.col("length").alias("bytes"))
    rel = F.regexp_extract("path", r"/((?:meta|data|videos|images)/.*)$", 1)
    return f.select(F.regexp_extract("path", r"([^/]+)/(?:meta|data|videos|images)/", 1).alias("dataset_id"), rel.alias("rel_path"), F.split(rel, "/")[0].alias("subdir"), "bytes").where("rel_path <> ''")


def directory_sizes(listing: DataFrame) -> DataFrame:
    """S22."""
    return listing.groupBy("dataset_id", "subdir").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_files"))


def bag_inventory(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Folders that hold a recording: storage (mcap wins), files, size in MB. S10."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", F.col("length").alias("bytes"))
    f = f.withColumn("bag", F.regexp_extract("path", r"^(.*)/[^/]+$", 1))
    is_mcap, is_db3 = F.endswith("path", F.lit(".mcap")), F.endswith("path", F.lit(".db3"))
    b = f.groupBy("bag").agg(
        F.count_if(is_mcap).alias("n_mcap"), F.count_if(is_db3).alias("n_db3"), F.count_if(F.endswith("path", F.lit("/metadata.yaml"))).alias("n_meta"),
        F.round(F.sum("bytes") / 1e6, 1).alias("size_mb"), F.count(F.lit(1)).alias("n_files"),
    ).where("n_mcap + n_db3 + n_meta > 0")
    return b.select("bag", F.when(F.col("n_mcap") > 0, "mcap").when(F.col("n_db3") > 0, "sqlite3").otherwise("unknown").alias("storage"), "n_files", "size_mb")


def bag_version(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Release by the number in metadata.yaml. S11."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.yaml").text(roots, wholetext=True)
    n = F.regexp_extract("value", r"version:\s*(\d+)", 1).try_cast("int")
    return t.select(F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1).alias("bag"), F.when(n >= 8, "jazzy").when(n >= 4, "humble").otherwise("older").alias("release"))


def read_urdf_joints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Joints of robot descriptions: name, type, axis, limits; movable unless fixed. S9."""
    schema = "_name string, _type string, axis struct<_xyz: string>, limit struct<_lower: double, _upper: double>"
    j = spark.read.format("xml").option("rowTag", "joint").schema(schema).load(",".join(paths))
    return j.select(F.col("_name").alias("joint"), F.col("_type").alias("kind"), F.transform(F.split("axis._xyz", " "), lambda x: x.cast("double")).alias("axis"), F.col("limit._lower").alias("lower"), F.col("limit._upper").alias("upper"), (F.col("_type") != "fixed").alias("movable"))


def read_images(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Frames of images/<camera>/episode_<n>/frame_<n>.<suffix> (dataset_id, camera, episode_index, pos, height, width,
    channels, data) by Spark's image source; ``data`` holds the bytes of the rows as the source gives them, blue before
    green before red. A file that is no image is left out. S16."""
    i = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(roots).select("image.*")
    at = lambda name: F.regexp_extract("origin", rf"{name}[_-](\d+)", 1).try_cast("long")
    camera = F.regexp_extract("origin", r"/images/(?:chunk-\d+/)?([^/]+)/", 1)
    return i.select(
        dataset_of(F.col("origin"), "images").alias("dataset_id"), F.element_at(F.split(camera, r"\."), -1).alias("camera"), at("episode").alias("episode_index"), at("frame").alias("pos"),
        "height", "width", F.col("nChannels").alias("channels"), "data",
    ).where("episode_index is not null and pos is not null")
