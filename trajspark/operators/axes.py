"""Vector series in long form, axis names and groups, and repaired time stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPISODE = ["dataset_id", "episode_index"]
AXIS = ["dataset_id", "source", "episode_index", "axis_index"]
FPS = 30.0
#: A time step up to this length counts as none.
NO_STEP = 1e-9

#: Words that tell the side and the part of a joint, in order of rank. Fixed values.
SIDES = ("left", "right")
PARTS = {
    "arm": ("shoulder", "elbow", "wrist"),
    "hand": ("thumb", "index", "middle", "ring", "pinky", "finger", "grip", "grasp", "prox", "meta", "distal"),
    "head": ("head", "neck", "jaw"),
    "torso": ("torso", "spine", "waist", "hip", "pelvis", "chest"),
    "leg": ("knee", "ankle", "foot", "toe", "thigh", "shin"),
}


def finite(x: Column) -> Column:
    """The value, or null where it is missing, NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clean_vector(v: Column) -> Column:
    """A list of doubles; a missing list is empty, entries that are no finite numbers are null. P12."""
    return F.coalesce(F.transform(v.cast("array<double>"), finite), F.array().cast("array<double>"))


def materialize_vector(df: DataFrame, key: str) -> DataFrame:
    """The vector column ``key`` from split columns key_0, key_1, ... in order of their numbers. S5."""
    parts = sorted((c for c in df.columns if c.startswith(f"{key}_") and c[len(key) + 1 :].isdigit()), key=lambda c: int(c[len(key) + 1 :]))
    if key in df.columns or not parts:
        return df
    vector = F.array(*[F.col(f"`{c}`").cast("double") for c in parts])
    return df.withColumn(key, vector).drop(*parts)


def feature_dim(df: DataFrame, key: str, keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Length of the vector by dataset: that of its first row that isn't empty. P6."""
    some = df.where(F.size(key) > 0)
    return some.groupBy(*keys).agg(F.min_by(F.size(key), F.struct("episode_index", "pos")).alias("dim"))


def explode_axes(frames: DataFrame, source: str) -> DataFrame:
    """Long form of the column ``source``: a row per frame and axis; rows of another length than the dataset's are left
    out. P11."""
    v = frames.select(*EPISODE, "pos", F.col("timestamp").alias("ts"), clean_vector(F.col(source)).alias("v"))
    v = v.join(feature_dim(v, "v"), "dataset_id").where(F.size("v") == F.col("dim"))
    return v.select(*EPISODE, F.lit(source).alias("source"), "pos", "ts", F.posexplode("v").alias("axis_index", "value"))


def sanitize_timestamps(frames: DataFrame, fps: float = FPS) -> DataFrame:
    """``timestamp`` of an episode becomes pos / fps throughout if any is missing, not finite or not above the one
    before. P13."""
    order, whole = Window.partitionBy(*EPISODE).orderBy("pos"), Window.partitionBy(*EPISODE)
    t = finite(F.col("timestamp").cast("double"))
    before = F.lag(t).over(order)
    good = t.isNotNull() & (before.isNull() | (t > before))
    # a lag over a missing value is missing too, but then that value's own row is bad
    frames = frames.withColumn("__good", F.coalesce(good, F.lit(False)))
    frames = frames.withColumn("__all", F.min("__good").over(whole))
    row = F.row_number().over(order) - 1
    return frames.withColumn("timestamp", F.when(F.col("__all"), F.col("timestamp").cast("double")).otherwise(row / fps)).drop("__good", "__all")


def axis_names(features: DataFrame) -> DataFrame:
    """``name`` of each axis of (dataset_id, feature, dim, names, joint_names): the feature's names if as many as axes,
    else the joints' names, else prefix_i. P8."""
    prefix = F.element_at(F.split("feature", r"\."), -1)
    own = F.when(F.size("names") == F.col("dim"), F.col("names"))
    joints = F.when(F.size("joint_names") == F.col("dim"), F.col("joint_names"))
    numbered = F.transform(F.sequence(F.lit(0), F.col("dim") - 1), lambda i: F.concat(prefix, F.lit("_"), i))
    return features.select("dataset_id", "feature", F.posexplode(F.coalesce(own, joints, numbered)).alias("axis_index", "axis_name"))


def name_tokens(name: Column) -> Column:
    return F.split(F.lower(F.translate(name, "-", "_")), "_")


def _first_of(name: Column, words: dict[str, tuple[str, ...]]) -> Column:
    tokens, out = name_tokens(name), F.lit(None).cast("string")
    for key, those in reversed(words.items()):
        out = F.when(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in those])), key).otherwise(out)
    return out


def axis_side(name: Column) -> Column:
    return _first_of(name, {s: (s,) for s in SIDES})


def axis_part(name: Column) -> Column:
    return _first_of(name, PARTS)


def axis_group(name: Column) -> Column:
    """Group of a joint name: side and part, either, or other. P9."""
    key = F.concat_ws("_", axis_side(name), axis_part(name))
    return F.when(key == "", "other").otherwise(key)


def group_label(key: Column) -> Column:
    """P10."""
    label = F.initcap(F.replace(F.coalesce(key, F.lit("")), F.lit("_"), F.lit(" ")))
    return F.when(label == "", "Other").otherwise(label)


def normalize_joint_name(name: Column) -> Column:
    """Small letters and digits only, without a closing "joint". F14."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "_?joint$", "")
    return F.regexp_replace(low, "[^a-z0-9]+", "")


def joint_layout(candidates: DataFrame) -> DataFrame:
    """Names by dataset from (dataset_id, rank, names): those of the least rank that are there. P7."""
    return candidates.where(F.size("names") > 0).groupBy("dataset_id").agg(F.min_by("names", "rank").alias("names"))


def feature_names(raw: str = "raw") -> Column:
    """Names of a feature from its VARIANT entry: a list of lists gives its first list, a list itself, an object its
    first list. P5."""
    nested = F.try_variant_get(raw, "$.names[0]", "array<string>")
    flat = F.try_variant_get(raw, "$.names", "array<string>")
    mapped = F.try_variant_get(raw, "$.names", "map<string, array<string>>")
    names = F.coalesce(nested, flat, F.element_at(F.map_values(mapped), 1))
    return F.when(F.exists(names, lambda n: n.isNull() | (F.trim(n) == "")), None).otherwise(names)


def compress_ranges(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Runs of whole numbers as (first, last). P21."""
    island = F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return (
        df.select(*keys, value).distinct().withColumn("island", island).groupBy(*keys, "island")
        .agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("island")
    )
