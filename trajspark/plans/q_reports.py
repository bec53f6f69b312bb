"""Queries on reports and deletion analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators import axes, deletion, motion, report, stats
from trajspark.plans import views
from trajspark.plans.rounding import rounded
from trajspark.plans.views import with_views


def _axis(spark: SparkSession, d: str) -> DataFrame:
    return axes.explode_axes(views.frames_embeddings(spark, d), "state")


def joint_report_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.joint_report(_axis(spark, d)))


def top_axes_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.top_axes(motion.temporal_metrics(motion.derivatives(_axis(spark, d))), "jerk"))


def temporal_summary_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.temporal_summary(motion.temporal_metrics(motion.derivatives(_axis(spark, d)))))


def temporal_leaders_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.temporal_leaders(motion.temporal_metrics(motion.derivatives(_axis(spark, d)))))


def constraint_leaders_embeddings(spark: SparkSession, d: str) -> DataFrame:
    a = _axis(spark, d)
    limits = a.select("dataset_id", "source", "axis_index").distinct().withColumns({"lower": F.lit(-0.2), "upper": F.lit(0.25), "velocity_limit": F.when(F.col("axis_index") < 20, 8.0)})
    return rounded(report.constraint_leaders(motion.constraint_metrics(motion.derivatives(a), limits)))


def junction_report_embeddings(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_embeddings(spark, d)
    return rounded(deletion.junction_report(_axis(spark, d), f.where("pos % 9 in (4, 5)")).select("episode_index", "left", "right", "n_between", "ratio", "smooth"))


def bridge_frames_embeddings(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_embeddings(spark, d)
    gone = f.where("pos % 20 between 5 and 14")
    return deletion.bridge_frames(f, deletion.junction_report(_axis(spark, d), gone, 1.0), gone)


def analyze_deletion_embeddings(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_embeddings(spark, d)
    out = deletion.analyze_deletion(f, _axis(spark, d), f.where("pos % 20 between 5 and 14"), 1.0)
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("frames", "alternative")})


QUERIES = {f.__name__: f for f in (joint_report_embeddings, top_axes_embeddings, temporal_summary_embeddings, temporal_leaders_embeddings, constraint_leaders_embeddings, junction_report_embeddings, bridge_frames_embeddings, analyze_deletion_embeddings)}

#: Columns of the joint report.
_REPORT = {
    "mean": "avg(s)", "var": "var_pop(s)", "std": "stddev_pop(s)", "min": "min(s)", "max": "max(s)", "range": "max(s) - min(s)",
    **{n: f"quantile_cont(s, {q})" for n, q in stats.METRIC_QUANTILES.items()},
    "within_1": "avg((abs(s - m) <= sd)::INT)", "within_2": "avg((abs(s - m) <= 2 * sd)::INT)",
    "smoothness": "avg(abs(d))", "max_delta": "max(abs(d))", "jerk": "avg(abs(dd))", "max_jerk": "max(abs(dd))", "mean_velocity": "avg(abs(velocity))", "max_velocity": "max(abs(velocity))",
    "mean_acceleration": "avg(abs(acceleration))", "max_acceleration": "max(abs(acceleration))", "mean_true_jerk": "avg(abs(third))", "max_true_jerk": "max(abs(third))",
    "spike_ratio": "coalesce(avg((spike > 0 AND abs(dd) > spike)::INT) FILTER (dd IS NOT NULL), 0)",
}

_T = """, d1 AS (SELECT episode_index, axis_index, pos, s - lag(s) OVER w AS d FROM axis_embeddings WINDOW w AS (PARTITION BY episode_index, axis_index ORDER BY pos)),
 d2 AS (SELECT axis_index, d, d - lag(d) OVER (PARTITION BY episode_index, axis_index ORDER BY pos) AS dd FROM d1),
 m AS (SELECT axis_index::BIGINT AS axis_index, avg(abs(d)) AS smoothness, avg(abs(dd)) AS jerk FROM d2 GROUP BY 1)"""
_D4 = """, d1 AS (SELECT episode_index, axis_index, pos, s, s - lag(s) OVER w AS d, pos / 30.0::DOUBLE - lag(pos / 30.0::DOUBLE) OVER w AS dt
  FROM axis_embeddings WINDOW w AS (PARTITION BY episode_index, axis_index ORDER BY pos)),
 d2 AS (SELECT *, d - lag(d) OVER w AS dd, d / dt AS velocity FROM d1 WINDOW w AS (PARTITION BY episode_index, axis_index ORDER BY pos)),
 d3 AS (SELECT *, (velocity - lag(velocity) OVER w) / dt AS acceleration FROM d2 WINDOW w AS (PARTITION BY episode_index, axis_index ORDER BY pos)),
 d4 AS (SELECT *, (acceleration - lag(acceleration) OVER w) / dt AS third FROM d3 WINDOW w AS (PARTITION BY episode_index, axis_index ORDER BY pos))"""
_RANK = """ SELECT 'embeddings' AS dataset_id, 'state' AS source, metric, row_number() OVER (PARTITION BY metric ORDER BY value DESC, axis_index) AS rank, axis_index, round(value, 6) AS value FROM u QUALIFY rank <= 5"""

ORACLE = {
    "temporal_leaders_embeddings": with_views(["frames_embeddings"], _D4 + """, m AS (SELECT axis_index::BIGINT AS axis_index, avg(abs(dd)) AS jerk, avg(abs(velocity)) AS mean_velocity, avg(abs(acceleration)) AS mean_acceleration, avg(abs(third)) AS mean_true_jerk FROM d4 GROUP BY 1),
 u AS (UNPIVOT m ON jerk, mean_velocity, mean_acceleration, mean_true_jerk INTO NAME metric VALUE value)""" + _RANK),
    "constraint_leaders_embeddings": with_views(["frames_embeddings"], _D4 + """, m AS (SELECT axis_index::BIGINT AS axis_index, avg((s < -0.2 - 1e-9 OR s > 0.25 + 1e-9)::INT) AS position_ratio,
 CASE WHEN axis_index < 20 THEN avg((abs(velocity) > 8 + 1e-9)::INT) FILTER (velocity IS NOT NULL) END AS velocity_ratio FROM d4 GROUP BY axis_index),
 u AS (UNPIVOT m ON position_ratio, velocity_ratio INTO NAME metric VALUE value)""" + _RANK),
    "joint_report_embeddings": with_views(["frames_embeddings"], _D4 + """,
 b AS (SELECT axis_index, avg(s) AS m, stddev_pop(s) AS sd, avg(abs(dd)) + 3 * stddev_pop(abs(dd)) AS spike FROM d4 GROUP BY 1)
 SELECT 'embeddings' AS dataset_id, 'state' AS source, axis_index::BIGINT AS axis_index, count(s) AS n, """ + ", ".join(f"round({x}, 6) AS {n}" for n, x in _REPORT.items()) + " FROM d4 JOIN b USING (axis_index) GROUP BY axis_index"),
    "junction_report_embeddings": with_views(["frames_embeddings"], """, st AS (SELECT *, s - lag(s) OVER w AS before, lead(s) OVER w - s AS nxt, abs(s - 2 * lag(s) OVER w + lag(s, 2) OVER w) AS acc FROM axis_embeddings WINDOW w AS (PARTITION BY episode_index, axis_index ORDER BY pos)),
 md AS (SELECT episode_index, axis_index, median(acc) AS med, max(s) - min(s) AS width FROM st GROUP BY 1, 2),
 th AS (SELECT episode_index, axis_index, greatest(1e-6, any_value(med) + 3 * 1.4826 * median(abs(acc - med))) AS threshold FROM st JOIN md USING (episode_index, axis_index) WHERE acc IS NOT NULL GROUP BY 1, 2),
 sc AS (SELECT episode_index, max(width) AS width FROM md GROUP BY 1), si AS (SELECT episode_index, count(*) AS n FROM frames_embeddings GROUP BY 1),
 k AS (SELECT *, lead(pos) OVER w AS r, lead(s) OVER w - s AS jump, lead(nxt) OVER w AS aft FROM st WHERE pos % 9 NOT IN (4, 5) WINDOW w AS (PARTITION BY episode_index, axis_index ORDER BY pos)),
 ra AS (SELECT k.episode_index, pos, r, CASE WHEN abs(jump) <= 0.001 * sc.width THEN 0 ELSE least(999, coalesce(greatest(coalesce(abs(jump - before), 0), coalesce(abs(aft - jump), 0)) / threshold, 0)) END AS ratio
  FROM k JOIN sc USING (episode_index) LEFT JOIN th ON th.episode_index = k.episode_index AND th.axis_index = k.axis_index WHERE r - pos > 1)
 SELECT ra.episode_index, pos AS "left", r AS "right", r - pos - 1 AS n_between, round(max(ratio), 6) AS ratio, max(ratio) <= 1 OR any_value(n) < 4 AS smooth FROM ra JOIN si USING (episode_index) GROUP BY ra.episode_index, pos, r"""),
    "top_axes_embeddings": with_views(["frames_embeddings"], _T + """ SELECT 'embeddings' AS dataset_id, 'state' AS source, axis_index, round(jerk, 6) AS jerk, row_number() OVER (ORDER BY jerk DESC, axis_index) AS rank
 FROM m QUALIFY rank <= 5"""),
    "temporal_summary_embeddings": with_views(["frames_embeddings"], _T + " SELECT 'embeddings' AS dataset_id, 'state' AS source, count(*) AS n_axes, round(avg(smoothness), 6) AS smoothness, round(avg(jerk), 6) AS jerk FROM m"),
}
