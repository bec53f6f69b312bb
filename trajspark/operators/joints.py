"""Joint tables: angle units, mirrored sliding joints, and limits from several sources."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNING = ("revolute", "continuous")
LIMITS = ("lower", "upper", "velocity_limit", "torque_limit")


def normalize_angle_units(axis: DataFrame, joints: DataFrame, basis: str = "episode") -> DataFrame:
    """``axis`` with turning joints in radians: an episode whose largest turning value is above 2 pi is taken as degrees.
    ``joints``: dataset_id, axis_index, kind. ``basis`` first_frame looks at each episode's first frame only. P19."""
    a = axis.join(joints.select("dataset_id", "axis_index", "kind"), ["dataset_id", "axis_index"], "left")
    turning = F.col("kind").isin(*TURNING)
    whole = Window.partitionBy("dataset_id", "episode_index")
    looked = turning if basis == "episode" else turning & (F.col("pos") == F.min("pos").over(whole))
    a = a.withColumn("__looked", F.coalesce(looked, F.lit(False)))
    a = a.withColumn("__most", F.max(F.when(F.col("__looked"), F.abs("value"))).over(whole))
    degrees = turning & (F.col("__most") > 2 * math.pi)
    return a.withColumn("value", F.when(degrees, F.radians("value")).otherwise(F.col("value"))).drop("kind", "__looked", "__most")


def mirror_pairs(joints: DataFrame, mapped: DataFrame) -> DataFrame:
    """(dataset_id, joint, follows): unmapped sliding joints with the negated limits of a mapped one and the opposite
    direction. ``joints``: dataset_id, joint, kind, axis, lower, upper; ``mapped``: dataset_id, joint. P20."""
    slide = joints.where("kind = 'prismatic'")
    lead, rest = slide.join(mapped, ["dataset_id", "joint"], "left_semi"), slide.join(mapped, ["dataset_id", "joint"], "left_anti")
    a, b = lead.alias("a"), rest.alias("b")
    dot = F.aggregate(F.zip_with("a.axis", "b.axis", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = lambda x, y: F.abs(F.col(x) + F.col(y)) <= 1e-6
    j = a.join(b, F.col("a.dataset_id") == F.col("b.dataset_id")).where(near("a.lower", "b.upper") & near("a.upper", "b.lower") & (dot < -0.9))
    return j.groupBy(F.col("b.dataset_id").alias("dataset_id"), F.col("b.joint").alias("joint")).agg(F.min("a.joint").alias("follows"))


def mirror_prismatic(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """``values`` (dataset_id, joint, ..., value) with rows of the joints that follow, negated. P20."""
    own = pairs.select("dataset_id", F.col("joint").alias("__own"), F.col("follows").alias("joint"))
    extra = values.join(own, ["dataset_id", "joint"]).withColumn("joint", F.col("__own")).withColumn("value", -F.col("value")).drop("__own")
    return values.unionByName(extra.select(*values.columns))


def joint_key(name: Column) -> Column:
    """Name by which limits are matched."""
    return F.translate(F.lower(F.trim(name)), "- ", "__")


def resolve_constraints(axes: DataFrame, config: DataFrame, feature: DataFrame) -> DataFrame:
    """Limits of each axis, field by field from the configuration, else from the feature; ``source`` names what was used.
    ``axes``: dataset_id, axis_index, axis_name; the others: dataset_id, axis_name and the limits. J8, P14."""

    def keyed(df: DataFrame, tag: str) -> DataFrame:
        best = [F.min(c).alias(f"{tag}_{c}") for c in LIMITS]
        return df.groupBy("dataset_id", joint_key(F.col("axis_name")).alias("__key")).agg(*best)

    a = axes.withColumn("__key", joint_key(F.col("axis_name"))).join(keyed(config, "c"), ["dataset_id", "__key"], "left").join(keyed(feature, "f"), ["dataset_id", "__key"], "left")
    used = lambda tag: F.coalesce(*[F.col(f"{tag}_{c}") for c in LIMITS]).isNotNull()
    source = F.concat_ws("+", F.when(used("c"), "config"), F.when(used("f"), "feature"))
    return a.select("dataset_id", "axis_index", "axis_name", *[F.coalesce(f"c_{c}", f"f_{c}").alias(c) for c in LIMITS], F.when(source != "", source).alias("source"))
