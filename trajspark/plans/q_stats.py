"""Queries on statistics by episode and axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators import axes, stats
from trajspark.plans import views
from trajspark.plans.rounding import rounded
from trajspark.plans.views import with_views


def _axis_events(spark: SparkSession, d: str) -> DataFrame:
    return axes.explode_axes(views.frames_events(spark, d), "state")


def _axis_embeddings(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_embeddings(spark, d)
    return axes.explode_axes(f, "state").unionByName(axes.explode_axes(f, "action"))


def merge_stats_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.merge_stats(stats.episode_stats(_axis_events(spark, d))))


def episode_stats_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.episode_stats(_axis_embeddings(spark, d)))


def recompute_stats_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.recompute_stats(views.frames_lineitem(spark, d), ["state"], ["pos", "timestamp"], views.LINEITEM_WIDTHS), 4)


def axis_metrics_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.axis_metrics(_axis_embeddings(spark, d)))


def sigma_coverage_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.sigma_coverage(_axis_embeddings(spark, d)))


def histogram_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.histogram(_axis_events(spark, d)))


def anomaly_threshold_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.anomaly_threshold(_axis_events(spark, d), ["dataset_id", "source", "episode_index", "axis_index"]))


def acceleration_threshold_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.acceleration_threshold(axes.explode_axes(views.frames_embeddings(spark, d), "state")))


def episode_lengths_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.episode_lengths(views.frames_lineitem(spark, d)))


def length_iqr_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.length_iqr_bounds(stats.episode_lengths(views.frames_lineitem(spark, d))))


def length_outliers_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.length_outliers(stats.episode_lengths(views.frames_lineitem(spark, d))))


def flatten_stats_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.flatten_stats(stats.episode_stats(_axis_events(spark, d)), ["min", "max", "mean", "std", "q50"]), 4)


def unflatten_stats_events(spark: SparkSession, d: str) -> DataFrame:
    names = ["min", "max", "mean", "std", "q50"]
    return rounded(stats.unflatten_stats(stats.flatten_stats(stats.episode_stats(_axis_events(spark, d)), names), names), 4)


QUERIES = {f.__name__: f for f in (
    merge_stats_events, episode_stats_embeddings, recompute_stats_lineitem, axis_metrics_embeddings, sigma_coverage_embeddings, histogram_events,
    anomaly_threshold_events, acceleration_threshold_embeddings, episode_lengths_lineitem, length_iqr_lineitem, length_outliers_lineitem,
    flatten_stats_events, unflatten_stats_events,
)}

_Q = ", ".join(f"quantile_cont(value, {q}) AS {n}" for n, q in stats.QUANTILES.items())
_STATS = f"count(value) AS n, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std, {_Q}"
_ROUND = lambda names, digits=6: ", ".join(f"round({n}, {digits}) AS {n}" for n in names)
_FIVE = ["min", "max", "mean", "std", *stats.QUANTILES]
_EVENT_STATS = f""", s AS (SELECT dataset_id, 'state' AS source, episode_index, 0::BIGINT AS axis_index, {_STATS} FROM frames_events GROUP BY dataset_id, episode_index)"""
_MERGE = f""", c AS (SELECT *, sum(n * mean) OVER w / sum(n) OVER w AS m FROM s WINDOW w AS (PARTITION BY dataset_id, source, axis_index)),
m AS (SELECT dataset_id, source, axis_index, sum(n)::BIGINT AS n, min(min) AS min, max(max) AS max, sum(n * mean) / sum(n) AS mean,
      sqrt(sum(n * (std * std + (mean - m) * (mean - m))) / sum(n)) AS std, {", ".join(f"sum(n * {q}) / sum(n) AS {q}" for q in stats.QUANTILES)}
      FROM c GROUP BY dataset_id, source, axis_index)
SELECT dataset_id, source, axis_index, n, """
_LONG = """, a AS (SELECT dataset_id, episode_index, pos, axis_index::BIGINT AS axis_index, 'state' AS source, s AS value FROM axis_embeddings
 UNION ALL SELECT dataset_id, episode_index, pos, axis_index::BIGINT, 'action', a FROM axis_embeddings)"""

ORACLE = {
    "merge_stats_events": with_views(["frames_events"], _EVENT_STATS + _MERGE + _ROUND(_FIVE) + " FROM m"),
    "episode_stats_embeddings": with_views(
        ["frames_embeddings"],
        _LONG + f", s AS (SELECT dataset_id, source, episode_index, axis_index, {_STATS} FROM a GROUP BY ALL) SELECT dataset_id, source, episode_index, axis_index, n, {_ROUND(_FIVE)} FROM s",
    ),
    "recompute_stats_lineitem": with_views(
        ["frames_lineitem"],
        f""", a AS (SELECT dataset_id, 'state' AS source, episode_index, unnest(range(3)) AS axis_index, unnest([v0, v1, v2]) AS value FROM frames_lineitem
 UNION ALL SELECT dataset_id, 'pos', episode_index, 0, pos::DOUBLE FROM frames_lineitem UNION ALL SELECT dataset_id, 'timestamp', episode_index, 0, pos / 30.0 FROM frames_lineitem),
 s AS (SELECT dataset_id, source, episode_index, axis_index, {_STATS} FROM a GROUP BY ALL)""" + _MERGE + _ROUND(_FIVE, 4) + " FROM m",
    ),
    "axis_metrics_embeddings": with_views(
        ["frames_embeddings"],
        _LONG + f""", s AS (SELECT dataset_id, source, axis_index, count(value) AS n, avg(value) AS mean, var_pop(value) AS var, stddev_pop(value) AS std, min(value) AS min,
 max(value) AS max, max(value) - min(value) AS range, {", ".join(f"quantile_cont(value, {q}) AS {n}" for n, q in stats.METRIC_QUANTILES.items())} FROM a GROUP BY ALL)
 SELECT dataset_id, source, axis_index, n, {_ROUND(["mean", "var", "std", "min", "max", "range", *stats.METRIC_QUANTILES])} FROM s""",
    ),
    "sigma_coverage_embeddings": with_views(
        ["frames_embeddings"],
        _LONG + """, m AS (SELECT dataset_id, source, axis_index, avg(value) AS m, stddev_pop(value) AS s FROM a GROUP BY ALL)
 SELECT dataset_id, source, axis_index, round(avg(CASE WHEN abs(value - m) <= s THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_1,
 round(avg(CASE WHEN abs(value - m) <= 2 * s THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_2 FROM a JOIN m USING (dataset_id, source, axis_index) GROUP BY ALL""",
    ),
    "histogram_events": with_views(
        ["frames_events"],
        """, l AS (SELECT min(value) AS lo, max(value) AS hi, least(20, greatest(8, floor(sqrt(count(*)))))::BIGINT AS k FROM frames_events),
 c AS (SELECT least(floor((value - lo) / ((hi - lo) / k)), k - 1)::BIGINT AS bin, count(*) AS n FROM frames_events, l GROUP BY 1),
 b AS (SELECT unnest(range(k)) AS bin, lo, hi, k FROM l)
 SELECT 'events' AS dataset_id, 'state' AS source, 0::BIGINT AS axis_index, bin, round(lo + bin * ((hi - lo) / k), 6) AS "left",
 round(lo + (bin + 1) * ((hi - lo) / k), 6) AS "right", coalesce(n, 0) AS count FROM b LEFT JOIN c USING (bin)""",
    ),
    "anomaly_threshold_events": with_views(
        ["frames_events"],
        """, v AS (SELECT episode_index, abs(value) AS v FROM frames_events),
 f AS (SELECT episode_index, median(v) AS med, avg(v) AS mean, stddev_pop(v) AS std, max(v) AS most FROM v GROUP BY 1),
 d AS (SELECT episode_index, median(abs(v - med)) AS mad FROM v JOIN f USING (episode_index) GROUP BY 1)
 SELECT 'events' AS dataset_id, 'state' AS source, episode_index, 0::BIGINT AS axis_index,
 round(coalesce(greatest(CASE WHEN med + 6 * mad > 0 THEN med + 6 * mad END, CASE WHEN mean + 3 * std > 0 THEN mean + 3 * std END), most), 6) AS threshold
 FROM f JOIN d USING (episode_index)""",
    ),
    "acceleration_threshold_embeddings": with_views(
        ["frames_embeddings"],
        """, d AS (SELECT episode_index, axis_index::BIGINT AS axis_index, abs(s - 2 * lag(s, 1) OVER w + lag(s, 2) OVER w) AS v FROM axis_embeddings
 WINDOW w AS (PARTITION BY episode_index, axis_index ORDER BY pos)), x AS (SELECT * FROM d WHERE v IS NOT NULL),
 m AS (SELECT episode_index, axis_index, median(v) AS med FROM x GROUP BY 1, 2)
 SELECT 'embeddings' AS dataset_id, 'state' AS source, episode_index, axis_index,
 round(greatest(1e-6, any_value(med) + 3 * 1.4826 * median(abs(v - med))), 6) AS accel_threshold FROM x JOIN m USING (episode_index, axis_index) GROUP BY 3, 4""",
    ),
    "episode_lengths_lineitem": "SELECT 'lineitem' AS dataset_id, l_orderkey::BIGINT AS episode_index, count(*) AS length FROM lineitem GROUP BY 2",
    "length_iqr_lineitem": """WITH e AS (SELECT l_orderkey, count(*) AS length FROM lineitem GROUP BY 1), q AS (SELECT quantile_cont(length, 0.25) AS q1,
 quantile_cont(length, 0.5) AS median, quantile_cont(length, 0.75) AS q3, min(length) AS shortest, max(length) AS longest FROM e)
 SELECT 'lineitem' AS dataset_id, q1, median, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, shortest, longest FROM q""",
    "length_outliers_lineitem": """WITH e AS (SELECT l_orderkey::BIGINT AS episode_index, count(*) AS length FROM lineitem GROUP BY 1),
 q AS (SELECT quantile_cont(length, 0.25) AS q1, quantile_cont(length, 0.75) AS q3 FROM e)
 SELECT 'lineitem' AS dataset_id, episode_index, length, CASE WHEN length < q1 - 1.5 * (q3 - q1) THEN 'too short' ELSE 'too long' END AS reason
 FROM e, q WHERE length < q1 - 1.5 * (q3 - q1) OR length > q3 + 1.5 * (q3 - q1)""",
    "flatten_stats_events": with_views(
        ["frames_events"],
        _EVENT_STATS + """, u AS (UNPIVOT (SELECT dataset_id, episode_index, axis_index, min, max, mean, std, q50 FROM s) ON min, max, mean, std, q50 INTO NAME metric VALUE value)
 SELECT dataset_id, episode_index, axis_index, 'stats/state/' || metric AS name, round(value, 4) AS value FROM u""",
    ),
    "unflatten_stats_events": with_views(
        ["frames_events"], _EVENT_STATS + f" SELECT dataset_id, episode_index, source, axis_index, {_ROUND(['min', 'max', 'mean', 'std', 'q50'], 4)} FROM s"
    ),
}
