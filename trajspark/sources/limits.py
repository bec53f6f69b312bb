"""Joint names, groups and limits from joint_config.json and from the features' metadata, over many datasets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators.axes import axis_group
from trajspark.operators.joints import LIMITS, joint_key

#: Where limits stand in a configuration, and the names of each limit there and in a feature, first one first. Fixed values.
CONTAINERS = ("joint_constraints", "joint_limits", "constraints")
CONFIG_NAMES = {
    "lower": ("lower", "min_position"),
    "upper": ("upper", "max_position"),
    "velocity_limit": ("velocity", "velocity_limit", "max_velocity"),
    "torque_limit": ("torque", "torque_limit", "effort", "max_torque"),
}
FEATURE_NAMES = {
    "lower": ("lower",),
    "upper": ("upper",),
    "velocity_limit": ("velocity", "velocity_limit", "max_velocity"),
    "torque_limit": ("torque", "torque_limit", "max_torque", "effort"),
}
TEXTS = "map<string, string>"


def joint_configs(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(dataset_id, names, groups, config) of each dataset's joint_config.json: the one beside meta/, else the one in it,
    of those that are JSON and name joints by joint_names or joint_groups. Groups give names where there are none. The
    values of ``config`` are JSON texts. S8."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "joint_config.json").text(roots, wholetext=True)
    path = F.col("_metadata.file_path")
    c = text.select(
        F.regexp_extract(path, r"([^/]+)/(?:meta/)?joint_config\.json$", 1).alias("dataset_id"), F.contains(path, F.lit("/meta/")).alias("inner"),
        F.from_json("value", TEXTS).alias("config"), F.from_json("value", "joint_names array<string>, joint_groups map<string, array<string>>").alias("c"),
    )
    named = F.when(F.size("c.joint_names") > 0, F.col("c.joint_names")).otherwise(F.flatten(F.map_values("c.joint_groups")))
    c = c.select("dataset_id", "inner", named.alias("names"), F.col("c.joint_groups").alias("groups"), "config").where(F.size("names") > 0)
    return c.groupBy("dataset_id").agg(F.min_by(F.struct("names", "groups", "config"), "inner").alias("c")).select("dataset_id", "c.*")


def config_axes(configs: DataFrame) -> DataFrame:
    """(dataset_id, axis_index, axis_name, grp): joints of the configurations with their groups, the first group that
    lists the joint; without groups, those that the names suggest. S8."""
    a = configs.select("dataset_id", "groups", F.posexplode("names").alias("axis_index", "axis_name"))
    member = F.filter(F.map_entries("groups"), lambda e: F.array_contains(e["value"], F.col("axis_name")))
    given = F.get(F.transform(member, lambda e: e["key"]), F.lit(0))
    return a.select("dataset_id", "axis_index", "axis_name", F.when(F.size("groups") > 0, given).otherwise(axis_group(F.col("axis_name"))).alias("grp"))


def _number(text: Column) -> Column:
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _first_text(texts: Column, names: tuple[str, ...]) -> Column:
    """Value of the first name that is a key; a key without a value hides the later names."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.map_contains_key(texts, n), F.try_element_at(texts, F.lit(n))).otherwise(out)
    return out


def _place(names: Column, key: Column) -> Column:
    """Number of the axis of a name: as it stands, else by the key that ignores case, blanks and hyphens (the last of
    several); null where there is none."""
    exact = F.array_position(names, key)
    alike = F.array_position(F.reverse(F.transform(names, joint_key)), joint_key(key))
    return F.when(exact > 0, exact - 1).when(alike > 0, F.size(names) - alike).cast("int")


def _fields(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One column per limit of (keys, axis_index, axis_name, field, order, value); the last value counts."""
    last = [F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("order"))).alias(f) for f in LIMITS]
    return rows.where("value is not null and axis_index is not null").groupBy(*keys, "axis_index", "axis_name").agg(*last)


def config_limits(configs: DataFrame) -> DataFrame:
    """(dataset_id, axis_index, axis_name, lower, upper, velocity_limit, torque_limit) from the three containers of the
    configurations; of two entries for a joint the later one counts. Entries for unknown joints, and values that are no
    finite numbers, are left out. P14."""
    containers = F.array(*[F.try_element_at("config", F.lit(c)) for c in CONTAINERS])
    c = configs.select("dataset_id", "names", F.posexplode(containers).alias("container", "text")).where("text is not null")
    e = c.select("dataset_id", "names", "container", F.posexplode(F.from_json("text", TEXTS)).alias("entry", "joint", "text"))
    e = e.select("dataset_id", "names", "container", "entry", _place(F.col("names"), F.col("joint")).alias("axis_index"), F.from_json("text", TEXTS).alias("limits"))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), _number(_first_text(F.col("limits"), n)).alias("value")) for f, n in CONFIG_NAMES.items()])
    rows = e.select("dataset_id", "axis_index", F.get("names", F.col("axis_index")).alias("axis_name"), F.struct("container", "entry").alias("order"), F.inline(cells))
    return _fields(rows, ["dataset_id"])


def feature_limits(features: DataFrame, axes: DataFrame) -> DataFrame:
    """The same columns and ``feature`` from the features' own metadata and from its object ``limits``, which counts more:
    a list gives the axes' values in order, an object those of its joints, by name or number. ``features``: dataset_id,
    feature, raw VARIANT; ``axes``: dataset_id, feature, axis_index, axis_name. P14."""
    keys = ["dataset_id", "feature"]
    names = axes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("axis_index", "axis_name"))), lambda s: s["axis_name"]).alias("names"))
    f = features.select(*keys, F.from_json(F.to_json("raw"), TEXTS).alias("own")).join(names, keys)
    c = f.select(*keys, "names", F.posexplode(F.array(F.col("own"), F.from_json(F.try_element_at("own", F.lit("limits")), TEXTS))).alias("container", "limits")).where("limits is not null")
    cells = F.array(*[F.struct(F.lit(k).alias("field"), _first_text(F.col("limits"), n).alias("text")) for k, n in FEATURE_NAMES.items()])
    c = c.select(*keys, "names", "container", F.inline(cells)).where("text is not null")
    listed = c.where(F.startswith(F.ltrim("text"), F.lit("["))).select(*keys, "names", "container", "field", F.posexplode(F.from_json("text", "array<string>")).alias("entry", "value")).withColumn("axis_index", F.col("entry")).where(F.col("entry") < F.size("names"))
    named = c.where(F.startswith(F.ltrim("text"), F.lit("{"))).select(*keys, "names", "container", "field", F.posexplode(F.from_json("text", TEXTS)).alias("entry", "joint", "value"))
    number = F.trim("joint").try_cast("int")
    place = F.coalesce(_place(F.col("names"), F.col("joint")), F.when(number.between(0, F.size("names") - 1), number))
    rows = listed.unionByName(named.withColumn("axis_index", place).drop("joint"))
    rows = rows.select(*keys, "axis_index", F.get("names", F.col("axis_index")).alias("axis_name"), F.struct("container", "entry").alias("order"), "field", _number(F.col("value")).alias("value"))
    return _fields(rows, keys)
