"""Queries on packing and layout conversion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators import axes, layouts
from trajspark.operators.stats import QUANTILES, episode_lengths
from trajspark.plans import views
from trajspark.plans.rounding import rounded
from trajspark.plans.views import with_views
from trajspark.session import shared_dir
from trajspark.sources import footers, readers, writers


def pack_files_part(spark: SparkSession, d: str) -> DataFrame:
    return rounded(layouts.pack_files(views.files_part(spark, d), 10_000, 50), 2)


def video_offsets_part(spark: SparkSession, d: str) -> DataFrame:
    v = views.files_part(spark, d).withColumn("camera", F.lit("cam")).withColumn("duration", F.col("bytes"))
    return rounded(layouts.video_offsets(v, 20_000, 50), 2)


def layout_round_trip_lineitem(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_lineitem(spark, d).withColumn("dataset_id", F.concat(F.lit("part"), F.col("episode_index") % 50))
    sizes = episode_lengths(f).withColumn("bytes", F.col("length") * 100)
    shared = layouts.to_shared_layout(f, sizes, 5000)
    back = layouts.from_shared_layout(shared, layouts.pack_files(sizes, 5000))
    return rounded(back.select("dataset_id", "episode_index", "pos", F.get("state", F.lit(1)).alias("price")))


def _written(spark: SparkSession, d: str, write) -> tuple[str, DataFrame]:
    """A new folder in the shared one with the frames, and the frames."""
    f = views.frames_embeddings(spark, d)
    tasks = spark.createDataFrame([("embeddings", 0, "hold")], "dataset_id string, task_index long, task string")
    episodes = f.select("dataset_id", "episode_index").distinct().withColumn("tasks", F.array(F.lit("hold")))
    root = f"{shared_dir(spark).rstrip('/')}/trajspark/dataset-{uuid.uuid4().hex}"
    write(f, episodes, tasks, root)
    return root, f


def _firsts(f: DataFrame) -> DataFrame:
    return rounded(f.select("dataset_id", "episode_index", "pos", F.get("state", F.lit(0)).alias("s0"), F.get("action", F.lit(31)).alias("a31")))


def dataset_round_trip_embeddings(spark: SparkSession, d: str) -> DataFrame:
    root, _ = _written(spark, d, writers.write_dataset)
    return _firsts(readers.scan_frames(spark, [root]))


def shared_round_trip_embeddings(spark: SparkSession, d: str) -> DataFrame:
    root, _ = _written(spark, d, lambda *a: writers.write_shared_dataset(*a, limit=300_000))
    return _firsts(writers.read_shared_dataset(spark, [f"{root}/embeddings"]))


def shared_statistics_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Statistics in the table of episodes of the written dataset, a row per feature, axis and metric."""
    root, _ = _written(spark, d, lambda *a: writers.write_shared_dataset(*a, limit=300_000))
    t = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/embeddings/meta/episodes")
    cells = [F.struct(F.lit(c.split("/")[1]).alias("feature"), F.lit(c.split("/")[2]).alias("metric"), F.col(f"`{c}`").alias("v")) for c in t.columns if c.startswith("stats/")]
    t = t.select("episode_index", F.inline(F.array(*cells)))
    return rounded(t.select("episode_index", "feature", "metric", F.posexplode("v").alias("axis_index", "value")))


def tolerant_scan_embeddings(spark: SparkSession, d: str) -> DataFrame:
    root, _ = _written(spark, d, writers.write_dataset)
    frames, quarantine = footers.scan_frames_tolerant(spark, [root])
    return _firsts(frames.join(quarantine, "dataset_id", "left_anti"))


def written_statistics_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Every number of the statistics file of the written dataset."""
    root, _ = _written(spark, d, writers.write_dataset)
    s = readers.read_stats(spark, [root]).select("feature", "metric", F.col("axis_index").cast("long").alias("axis_index"), "value")
    return rounded(s)


def episode_paths_orders(spark: SparkSession, d: str) -> DataFrame:
    return views.tasks_orders(spark, d).select("episode_index", layouts.episode_path(F.col("episode_index")).alias("path"))


def group_axes_part(spark: SparkSession, d: str) -> DataFrame:
    name = F.replace(F.lower(F.concat_ws("_", F.when(F.col("p_partkey") % 3 == 0, "left").when(F.col("p_partkey") % 3 == 1, "right"), F.when(F.col("p_partkey") % 2 == 0, "elbow").otherwise("neck"), F.col("p_partkey").cast("string"))), F.lit(" "), F.lit("_"))
    p = views.table(spark, d, "part").select("p_partkey", name.alias("name"))
    return rounded(p.select(F.col("p_partkey").alias("part"), axes.axis_group(F.col("name")).alias("grp"), axes.group_label(axes.axis_group(F.col("name"))).alias("label"), axes.normalize_joint_name(F.concat("name", F.lit("_joint"))).alias("norm")))


QUERIES = {f.__name__: f for f in (pack_files_part, video_offsets_part, layout_round_trip_lineitem, dataset_round_trip_embeddings, shared_round_trip_embeddings, shared_statistics_embeddings, tolerant_scan_embeddings, written_statistics_embeddings, episode_paths_orders, group_axes_part)}

_PACK = """WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey::BIGINT AS episode_index, p_retailprice::DOUBLE AS bytes FROM part),
 r AS (SELECT i, episode_index, bytes, 0::BIGINT AS f, bytes AS used, 0::BIGINT AS lo FROM s WHERE i = 1
 UNION ALL SELECT s.i, s.episode_index, s.bytes, CASE WHEN used + s.bytes >= {limit} THEN f + 1 ELSE f END, CASE WHEN used + s.bytes >= {limit} THEN s.bytes ELSE used + s.bytes END,
 CASE WHEN used + s.bytes >= {limit} THEN 0 ELSE lo + 1 END FROM r JOIN s ON s.i = r.i + 1)"""

_FIRSTS = with_views(["frames_embeddings"], " SELECT dataset_id, episode_index, pos, round(state[1], 6) AS s0, round(action[32], 6) AS a31 FROM frames_embeddings")

_SERIES = """, axes AS (
  SELECT 'observation.state' AS feature, episode_index, axis_index, s AS v FROM axis_embeddings UNION ALL SELECT 'action', episode_index, axis_index, a FROM axis_embeddings
  UNION ALL SELECT 'timestamp', episode_index, 0, pos / 30.0 FROM frames_embeddings UNION ALL SELECT 'frame_index', episode_index, 0, pos FROM frames_embeddings
  UNION ALL SELECT 'episode_index', episode_index, 0, episode_index FROM frames_embeddings)"""

ORACLE = {
    "shared_statistics_embeddings": with_views(["frames_embeddings"], _SERIES + f""", each AS (SELECT episode_index, feature, axis_index::BIGINT AS axis_index, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max, avg(v)::DOUBLE AS mean, stddev_pop(v)::DOUBLE AS std,
  {', '.join(f"quantile_cont(v, {q})::DOUBLE AS {k}" for k, q in QUANTILES.items())}, count(*)::DOUBLE AS count FROM axes GROUP BY ALL),
 u AS (UNPIVOT each ON COLUMNS(* EXCLUDE (episode_index, feature, axis_index)) INTO NAME metric VALUE value) SELECT episode_index, feature, metric, axis_index, round(value, 6) AS value FROM u"""),
    "pack_files_part": _PACK.replace("{limit}", "10000") + """ SELECT 'part' AS dataset_id, episode_index, f // 50 AS chunk, f % 50 AS file, round(bytes, 2) AS bytes, lo AS from_index, lo + 1 AS to_index FROM r""",
    "video_offsets_part": _PACK.replace("{limit}", "20000") + """ SELECT 'part' AS dataset_id, 'cam' AS camera, episode_index, f // 50 AS chunk, f % 50 AS file,
 round(sum(bytes) OVER (PARTITION BY f ORDER BY episode_index) - bytes, 2) AS from_timestamp, round(sum(bytes) OVER (PARTITION BY f ORDER BY episode_index), 2) AS to_timestamp FROM r""",
    "layout_round_trip_lineitem": with_views(["frames_lineitem"], " SELECT 'part' || (episode_index % 50) AS dataset_id, episode_index, pos, round(v1, 6) AS price FROM frames_lineitem"),
    "dataset_round_trip_embeddings": _FIRSTS,
    "shared_round_trip_embeddings": _FIRSTS,
    "tolerant_scan_embeddings": _FIRSTS,
    "written_statistics_embeddings": with_views(["frames_embeddings"], f""", axes AS (
  SELECT 'observation.state' AS feature, episode_index, axis_index, s AS v FROM axis_embeddings UNION ALL SELECT 'action', episode_index, axis_index, a FROM axis_embeddings
  UNION ALL SELECT 'timestamp', episode_index, 0, pos / 30.0 FROM frames_embeddings UNION ALL SELECT 'frame_index', episode_index, 0, pos FROM frames_embeddings
  UNION ALL SELECT 'episode_index', episode_index, 0, episode_index FROM frames_embeddings
), each AS (
  SELECT feature, episode_index, axis_index, count(*) AS n, {', '.join(f"quantile_cont(v, {q}) AS {k}" for k, q in QUANTILES.items())} FROM axes GROUP BY ALL
), whole AS (
  SELECT feature, axis_index, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std, count(*)::DOUBLE AS count FROM axes GROUP BY ALL
), merged AS (
  SELECT feature, axis_index, {', '.join(f"sum(n * {k}) / sum(n) AS {k}" for k in QUANTILES)} FROM each GROUP BY ALL
), told AS (
  SELECT feature, axis_index, unnest(['min', 'max', 'mean', 'std', 'count', {', '.join(repr(k) for k in QUANTILES)}]) AS metric, unnest([min, max, mean, std, count, {', '.join(QUANTILES)}]) AS value FROM whole JOIN merged USING (feature, axis_index)
) SELECT feature, metric, axis_index, round(value, 6) AS value FROM told WHERE metric <> 'count' OR axis_index = 0"""),
    "episode_paths_orders": "SELECT o_orderkey::BIGINT AS episode_index, format('data/chunk-{:03d}/episode_{:06d}.parquet', o_orderkey // 1000, o_orderkey) AS path FROM orders",
    "group_axes_part": """WITH n AS (SELECT p_partkey::BIGINT AS part, CASE p_partkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS side, CASE WHEN p_partkey % 2 = 0 THEN 'elbow' ELSE 'neck' END AS joint FROM part),
 g AS (SELECT *, concat_ws('_', side, CASE joint WHEN 'elbow' THEN 'arm' ELSE 'head' END) AS grp FROM n)
 SELECT part, grp, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(grp, '_')], ' ') AS label, coalesce(side, '') || joint || part AS norm FROM g""",
}
