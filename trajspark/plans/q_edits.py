"""Queries on deleting, renumbering, merging and editing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.operators import edits
from trajspark.operators.stats import episode_lengths, length_outliers
from trajspark.plans import views
from trajspark.plans.q_motion import TRIM
from trajspark.plans.rounding import rounded
from trajspark.plans.views import with_views


def renumber_after_delete_lineitem(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_lineitem(spark, d)
    out = edits.delete_episodes(f, length_outliers(episode_lengths(f)))
    return rounded(out.select("episode_index", "orig_episode_index", "pos", "index"))


def delete_frames_lineitem(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_lineitem(spark, d)
    out = edits.delete_frames(f, f.where(F.get("state", F.lit(0)) > 25))
    return rounded(out.select("episode_index", "orig_episode_index", "pos", "index", F.get("state", F.lit(1)).alias("price")))


def batch_plan_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(edits.batch_plan(views.frames_embeddings(spark, d), threshold=1.1)[2])


def apply_batch_plan_embeddings(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_embeddings(spark, d)
    gone, trims, _ = edits.batch_plan(f, threshold=1.1)
    return rounded(edits.apply_batch_plan(f, gone, trims).select("episode_index", "pos", "index", F.get("state", F.lit(0)).alias("s0")))


def rebuild_timestamps_lineitem(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_lineitem(spark, d)
    before = episode_lengths(f).withColumnRenamed("length", "orig_length")
    cut = f.where((F.get("state", F.lit(0)) <= 45)).withColumn("timestamp", F.col("timestamp") + 1)
    cut = cut.withColumn("pos", (F.row_number().over(Window.partitionBy("dataset_id", "episode_index").orderBy("pos")) - 1).cast("long"))
    return rounded(edits.rebuild_timestamps(cut, before).select("episode_index", "pos", "timestamp"))


def find_junctions_lineitem(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_lineitem(spark, d)
    return rounded(edits.find_junctions(f, f.where(F.get("state", F.lit(0)) > 25)))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    t = views.tasks_orders(spark, d).select("dataset_id", "task").distinct()
    return t.withColumn("task_index", (F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc("task"))) - 1).cast("long"))


def task_merge_orders(spark: SparkSession, d: str) -> DataFrame:
    order = spark.createDataFrame([("finished", 0), ("open", 1)], "dataset_id string, dataset_order int")
    t = _tasks(spark, d).where("dataset_id = 'open' or task < '4'")
    return rounded(edits.remap_tasks(t, order))


def resolve_episode_task_orders(spark: SparkSession, d: str) -> DataFrame:
    e = views.tasks_orders(spark, d)
    episodes = e.select("dataset_id", "episode_index", F.when(F.col("episode_index") % 3 == 0, "7").alias("task_index"), F.array(F.lit("none"), F.col("task")).alias("tasks"))
    frames = e.where("episode_index % 3 = 1").select("dataset_id", "episode_index", F.lit(0).alias("pos"), F.lit(5).cast("long").alias("task_index"))
    return rounded(edits.resolve_episode_task(episodes, frames, _tasks(spark, d)))


def append_datasets_orders(spark: SparkSession, d: str) -> DataFrame:
    o = views.tasks_orders(spark, d)
    f = views.frames_lineitem(spark, d).drop("dataset_id").join(o.select("dataset_id", "episode_index"), "episode_index")
    order = spark.createDataFrame([("open", 0), ("finished", 1)], "dataset_id string, dataset_order int")
    return rounded(edits.append_datasets(f, order, "both").select("episode_index", "orig_dataset_id", "orig_episode_index", "pos", "index"))


def refresh_totals_orders(spark: SparkSession, d: str) -> DataFrame:
    o = views.tasks_orders(spark, d)
    f = views.frames_lineitem(spark, d).drop("dataset_id").join(o.select("dataset_id", "episode_index"), "episode_index")
    return rounded(edits.refresh_totals(f, _tasks(spark, d)))


def assign_expression_embeddings(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_embeddings(spark, d)
    out = edits.assign_field(f, "action", edits.assign_expression(f, "state", "(x * 2 + 1) / (x - x)", True), [1, 2])
    out = edits.assign_field(out, "state", edits.assign_expression(f, "state", "x * 100 - 3"), [3])
    return rounded(out.select("episode_index", "pos", F.get("state", F.lit(0)).alias("s0"), F.get("action", F.lit(0)).alias("a0")))


QUERIES = {f.__name__: f for f in (
    renumber_after_delete_lineitem, delete_frames_lineitem, batch_plan_embeddings, apply_batch_plan_embeddings, rebuild_timestamps_lineitem, find_junctions_lineitem,
    task_merge_orders, resolve_episode_task_orders, append_datasets_orders, refresh_totals_orders, assign_expression_embeddings,
)}

_TASKS = """WITH ta AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'open' END AS dataset_id, o_orderkey::BIGINT AS episode_index, o_orderpriority AS task FROM orders),
 tk AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY task DESC) - 1 AS task_index FROM (SELECT DISTINCT dataset_id, task FROM ta))"""
_RENUMBER = """, el AS (SELECT episode_index, count(*) AS length FROM kept GROUP BY 1),
 n AS (SELECT episode_index, row_number() OVER (ORDER BY episode_index) - 1 AS new_index, sum(length) OVER (ORDER BY episode_index) - length AS first_frame FROM el),
 k AS (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY pos) - 1 AS p FROM kept)"""
_SIZES = ", q AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS length FROM frames_lineitem), b AS (SELECT quantile_cont(length, 0.25) AS q1, quantile_cont(length, 0.75) AS q3 FROM (SELECT DISTINCT episode_index, length FROM q))"
_PLAN = TRIM + """, qu AS (SELECT quantile_cont(length, 0.25) AS q1, quantile_cont(length, 0.75) AS q3 FROM e),
 g AS (SELECT episode_index, length FROM e, qu WHERE length < q1 - 1.5 * (q3 - q1) OR length > q3 + 1.5 * (q3 - q1)), kt AS (SELECT * FROM tr WHERE episode_index NOT IN (SELECT episode_index FROM g))"""

ORACLE = {
    "batch_plan_embeddings": with_views(["frames_embeddings"], _PLAN + """, t AS (SELECT (SELECT count(*) FROM e) AS episodes, (SELECT sum(length) FROM e)::BIGINT AS frames, (SELECT count(*) FROM g) AS deleted_episodes,
 (SELECT coalesce(sum(length), 0) FROM g)::BIGINT AS deleted_frames, (SELECT coalesce(sum(trim_start + trim_end), 0) FROM kt)::BIGINT AS trimmed_frames, (SELECT count(*) FROM kt WHERE trim_start + trim_end > 0) AS trimmed_episodes)
 SELECT 'embeddings' AS dataset_id, *, episodes - deleted_episodes AS kept_episodes, frames - deleted_frames - trimmed_frames AS kept_frames FROM t"""),
    "apply_batch_plan_embeddings": with_views(["frames_embeddings"], _PLAN + ", kept AS (SELECT f.* FROM frames_embeddings f JOIN kt USING (episode_index) WHERE f.pos >= trim_start AND f.pos < kt.length - trim_end)" + _RENUMBER
     + ' SELECT new_index AS episode_index, p AS pos, (first_frame + p)::BIGINT AS "index", round(state[1], 6) AS s0 FROM k JOIN n USING (episode_index)'),
    "renumber_after_delete_lineitem": with_views(["frames_lineitem"], _SIZES + """, kept AS (SELECT q.* FROM q, b WHERE length BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))""" + _RENUMBER
     + ' SELECT new_index AS episode_index, episode_index AS orig_episode_index, p AS pos, (first_frame + p)::BIGINT AS "index" FROM k JOIN n USING (episode_index)'),
    "delete_frames_lineitem": with_views(["frames_lineitem"], ", kept AS (SELECT * FROM frames_lineitem WHERE v0 <= 25)" + _RENUMBER
     + ' SELECT new_index AS episode_index, episode_index AS orig_episode_index, p AS pos, (first_frame + p)::BIGINT AS "index", round(v1, 6) AS price FROM k JOIN n USING (episode_index)'),
    "rebuild_timestamps_lineitem": with_views(["frames_lineitem"], """, q AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS length FROM frames_lineitem),
 k AS (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY pos) - 1 AS p, count(*) OVER (PARTITION BY episode_index) AS n FROM q WHERE v0 <= 45)
 SELECT episode_index, p AS pos, round(CASE WHEN n <> length THEN p / 30.0::DOUBLE ELSE pos / 30.0::DOUBLE + 1 END, 6) AS "timestamp" FROM k"""),
    "find_junctions_lineitem": with_views(["frames_lineitem"], """, k AS (SELECT dataset_id, episode_index, pos AS "left", lead(pos) OVER (PARTITION BY episode_index ORDER BY pos) AS "right" FROM frames_lineitem WHERE v0 <= 25)
 SELECT dataset_id, episode_index, "left", "right", "right" - "left" - 1 AS n_between FROM k WHERE "right" - "left" > 1"""),
    "task_merge_orders": _TASKS + """, t AS (SELECT tk.*, CASE WHEN dataset_id = 'finished' THEN 0 ELSE 1 END AS o FROM tk WHERE dataset_id = 'open' OR task < '4'),
 f AS (SELECT task, min(o * 1000 + task_index) AS seen FROM t GROUP BY 1), n AS (SELECT task, row_number() OVER (ORDER BY seen) - 1 AS new_index FROM f) SELECT dataset_id, task_index, new_index FROM t JOIN n USING (task)""",
    "resolve_episode_task_orders": _TASKS + """ SELECT ta.dataset_id, ta.episode_index, CASE WHEN ta.episode_index % 3 = 0 THEN 7 WHEN ta.episode_index % 3 = 1 THEN 5 ELSE tk.task_index END::BIGINT AS task_index
 FROM ta JOIN tk ON ta.dataset_id = tk.dataset_id AND ta.task = tk.task""",
    "append_datasets_orders": with_views(["frames_lineitem"], """, j AS (SELECT f.*, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'open' END AS ds FROM frames_lineitem f JOIN orders ON o_orderkey = episode_index),
 e AS (SELECT ds, episode_index, count(*) AS length, CASE WHEN ds = 'open' THEN 0 ELSE 1 END AS o FROM j GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (ORDER BY o, episode_index) - 1 AS new_index, sum(length) OVER (ORDER BY o, episode_index) - length AS first_frame FROM e)
 SELECT new_index AS episode_index, j.ds AS orig_dataset_id, j.episode_index AS orig_episode_index, pos, (first_frame + pos)::BIGINT AS "index" FROM j JOIN n ON j.ds = n.ds AND j.episode_index = n.episode_index"""),
    "refresh_totals_orders": _TASKS + """ SELECT ta.dataset_id, count(DISTINCT l_orderkey) AS total_episodes, count(*) AS total_frames, (SELECT count(*) FROM tk WHERE tk.dataset_id = ta.dataset_id) AS total_tasks
 FROM ta JOIN lineitem ON l_orderkey = episode_index GROUP BY ta.dataset_id""",
    "assign_expression_embeddings": with_views(["frames_embeddings"], """ SELECT episode_index, pos, round(CASE WHEN episode_index = 3 THEN state[1] * 100 - 3 ELSE state[1] END, 6) AS s0,
 CASE WHEN episode_index NOT IN (1, 2) THEN round(action[1], 6) WHEN state[1] * 2 + 1 > 0 THEN 'inf'::DOUBLE WHEN state[1] * 2 + 1 < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS a0 FROM frames_embeddings"""),
}
