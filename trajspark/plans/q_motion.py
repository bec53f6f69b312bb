"""Queries on derivatives, spikes, smoothing, trims and lags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.operators import axes, lag, motion
from trajspark.plans import views
from trajspark.plans.rounding import rounded
from trajspark.plans.views import with_views


def _axis_events(spark: SparkSession, d: str) -> DataFrame:
    return axes.explode_axes(views.frames_events(spark, d), "state")


def derivatives_events(spark: SparkSession, d: str) -> DataFrame:
    out = motion.derivatives(_axis_events(spark, d))
    return rounded(out.select("episode_index", "pos", "velocity", "acceleration", "jerk", "d2"), 4)


def temporal_metrics_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.temporal_metrics(motion.derivatives(_axis_events(spark, d))), 4)


def spike_ratio_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.spike_ratio(motion.derivatives(_axis_events(spark, d))))


def constraint_metrics_events(spark: SparkSession, d: str) -> DataFrame:
    limits = spark.createDataFrame([("events", "state", 0, 5.0, 100.0, 0.01)], "dataset_id string, source string, axis_index int, lower double, upper double, velocity_limit double")
    return rounded(motion.constraint_metrics(motion.derivatives(_axis_events(spark, d)), limits))


def timestamp_summary_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.timestamp_summary(axes.sanitize_timestamps(views.frames_events(spark, d))), 3)


def flag_anomalies_events(spark: SparkSession, d: str) -> DataFrame:
    out = motion.flag_anomalies(motion.derivatives(_axis_events(spark, d)))
    return rounded(out.where("anomaly").select("episode_index", "pos", "velocity"), 4)


def smooth_actions_events(spark: SparkSession, d: str) -> DataFrame:
    out = motion.smooth_jumps(motion.derivatives(_axis_events(spark, d)))
    return rounded(out.select("episode_index", "pos", "touched", "smoothed"))


def smoothing_report_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.smoothing_report(motion.smooth_jumps(motion.derivatives(_axis_events(spark, d)))))


def window_motion_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.window_motion(views.frames_embeddings(spark, d)))


def static_edge_trim_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.static_edge_trim(views.frames_embeddings(spark, d), threshold=1.1))


def trimmed_frames_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.trimmed_frames(motion.static_edge_trim(views.frames_embeddings(spark, d), threshold=1.1)))


def max_joint_speed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.max_joint_speed(views.frames_embeddings(spark, d)))


def max_action_jump_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.max_action_jump(views.frames_embeddings(spark, d)))


def static_axes_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(motion.static_axes(axes.explode_axes(views.frames_embeddings(spark, d), "action"), 0.122))


def temporal_preview_events(spark: SparkSession, d: str) -> DataFrame:
    out = motion.temporal_preview(_axis_events(spark, d))
    return rounded(out.select("dataset_id", "episode_index", "pos", "value", "velocity", "anomaly", "shown"), 4)


def curve_preview_embeddings(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_embeddings(spark, d)
    out = motion.curve_preview(f, motion.static_edge_trim(f, threshold=1.1))
    return rounded(out.select("dataset_id", "episode_index", "pos", "trimmed", *[F.get("curve", F.lit(i)).alias(f"c{i}") for i in range(8)]))


def sample_frames_lineitem(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_lineitem(spark, d).withColumn("episode_index", F.floor(F.col("episode_index") / 1000))
    f = f.withColumn("pos", F.row_number().over(Window.partitionBy("episode_index").orderBy("state")).cast("long") - 1)
    return motion.sample_frames(f).select("dataset_id", "episode_index", "pos")


def lagged_correlation_embeddings(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_embeddings(spark, d)
    a = axes.explode_axes(f, "state").unionByName(axes.explode_axes(f, "action"))
    return rounded(lag.lagged_correlations(lag.pair_state_action(a), lag.max_lag()))


def state_action_lag_embeddings(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_embeddings(spark, d)
    return rounded(lag.state_action_lag(axes.explode_axes(f, "state").unionByName(axes.explode_axes(f, "action"))))


def lag_summary_embeddings(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_embeddings(spark, d)
    return rounded(lag.lag_summary(lag.state_action_lag(axes.explode_axes(f, "state").unionByName(axes.explode_axes(f, "action")))))


def compress_ranges_events(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").where("event_type in ('click', 'view')")
    return rounded(axes.compress_ranges(e, "event_id", ["event_type"]))


QUERIES = {f.__name__: f for f in (
    derivatives_events, temporal_metrics_events, spike_ratio_events, constraint_metrics_events, timestamp_summary_events, flag_anomalies_events,
    smooth_actions_events, smoothing_report_events, window_motion_embeddings, static_edge_trim_embeddings, trimmed_frames_embeddings,
    max_joint_speed_embeddings, max_action_jump_embeddings, static_axes_embeddings, temporal_preview_events, curve_preview_embeddings, sample_frames_lineitem,
    lagged_correlation_embeddings, state_action_lag_embeddings, lag_summary_embeddings, compress_ranges_events,
)}

_D = """, t AS (SELECT episode_index, pos, value, value - lag(value) OVER w AS d1, ts - lag(ts) OVER w AS gap FROM frames_events WINDOW w AS (PARTITION BY episode_index ORDER BY pos)),
 t1 AS (SELECT *, CASE WHEN gap <= 1e-9 THEN 1 / 30.0::DOUBLE ELSE gap END AS dt FROM t),
 t2 AS (SELECT *, d1 - lag(d1) OVER w AS d2, d1 / dt AS velocity FROM t1 WINDOW w AS (PARTITION BY episode_index ORDER BY pos)),
 t3 AS (SELECT *, (velocity - lag(velocity) OVER w) / dt AS acceleration FROM t2 WINDOW w AS (PARTITION BY episode_index ORDER BY pos)),
 d AS (SELECT *, (acceleration - lag(acceleration) OVER w) / dt AS jerk FROM t3 WINDOW w AS (PARTITION BY episode_index ORDER BY pos))"""
_FLAG = """, v AS (SELECT episode_index, abs(velocity) AS v FROM d WHERE velocity IS NOT NULL),
 f AS (SELECT episode_index, median(v) AS med, avg(v) AS mean, stddev_pop(v) AS std, max(v) AS most FROM v GROUP BY 1),
 g AS (SELECT episode_index, median(abs(v - med)) AS mad FROM v JOIN f USING (episode_index) GROUP BY 1),
 th AS (SELECT episode_index, coalesce(greatest(CASE WHEN med + 6 * mad > 0 THEN med + 6 * mad END, CASE WHEN mean + 3 * std > 0 THEN mean + 3 * std END), most) AS threshold FROM f JOIN g USING (episode_index)),
 fl AS (SELECT d.*, coalesce(abs(velocity) > threshold, false) AS anomaly FROM d LEFT JOIN th USING (episode_index))"""
_SMOOTH = """, n AS (SELECT *, max(anomaly::INT) OVER (PARTITION BY episode_index ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1
 AND lag(pos) OVER w IS NOT NULL AND lead(pos) OVER w IS NOT NULL AS touched FROM fl WINDOW w AS (PARTITION BY episode_index ORDER BY pos)),
 k AS (SELECT *, max(CASE WHEN NOT touched THEN pos END) OVER (PARTITION BY episode_index ORDER BY pos ROWS UNBOUNDED PRECEDING) AS lp,
 min(CASE WHEN NOT touched THEN pos END) OVER (PARTITION BY episode_index ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rp FROM n),
 sm AS (SELECT k.episode_index, k.pos, k.touched, k.anomaly, k.value, CASE WHEN k.touched THEN l.value + ((k.pos - lp) / (rp - lp)::DOUBLE) * (r.value - l.value) ELSE k.value END AS smoothed
 FROM k LEFT JOIN frames_events l ON l.episode_index = k.episode_index AND l.pos = k.lp LEFT JOIN frames_events r ON r.episode_index = k.episode_index AND r.pos = k.rp)"""
_MOVE = """, w AS (SELECT episode_index, pos, action, lead(action, 4) OVER (PARTITION BY episode_index ORDER BY pos) AS later, count(*) OVER (PARTITION BY episode_index) AS length FROM frames_embeddings),
 mo AS (SELECT episode_index, pos, length, CASE WHEN later IS NOT NULL THEN sqrt(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(action, later)])) END AS motion FROM w)"""
TRIM = _MOVE + """, e AS (SELECT episode_index, any_value(length) AS length, min(CASE WHEN motion > 1.1 THEN pos END) AS a, max(CASE WHEN motion > 1.1 THEN pos END) AS b,
 max(motion) AS max_motion, avg(motion) AS mean_motion FROM mo GROUP BY 1),
 tr AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE a END AS trim_start, CASE WHEN a IS NULL THEN 0 ELSE length - 1 - least(length - 1, b + 4) END AS trim_end,
 CASE WHEN a IS NULL THEN 0 ELSE a END AS keep_start, CASE WHEN a IS NULL THEN length - 1 ELSE least(length - 1, b + 4) END AS keep_end,
 CASE WHEN length < 2 THEN 'episode too short' WHEN length < 5 THEN 'episode shorter than the window' WHEN a IS NULL THEN 'no moving segment found'
 WHEN a = 0 AND length - 1 - least(length - 1, b + 4) = 0 THEN 'static edge shorter than the least' END AS why FROM e)"""
_PAIRS = """, p AS (SELECT episode_index, axis_index::BIGINT AS axis_index, pos, s AS x, a AS y FROM axis_embeddings),
 l AS (SELECT unnest(range(-15, 16)) AS lag),
 j AS (SELECT p.episode_index, p.axis_index, lag, count(*) AS weight, CASE WHEN count(*) >= 4 AND stddev_pop(p.x) >= 1e-9 AND stddev_pop(q.y) >= 1e-9
 THEN covar_pop(p.x, q.y) / (stddev_pop(p.x) * stddev_pop(q.y)) END AS correlation
 FROM p, l, p AS q WHERE q.episode_index = p.episode_index AND q.axis_index = p.axis_index AND q.pos = p.pos + lag GROUP BY ALL)"""
BEST = _PAIRS + """, c AS (SELECT axis_index, lag, sum(abs(correlation) * weight) / sum(weight) AS size, sum(correlation * weight) / sum(weight) AS correlation, sum(weight)::BIGINT AS weight
 FROM j WHERE correlation IS NOT NULL GROUP BY 1, 2), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY axis_index ORDER BY round(size, 9) DESC, abs(lag), lag) = 1)"""

#: Numbers of an even sample of k out of n.
_EVEN = "[round_even(t * (({n} - 1) / greatest({k} - 1, 1)::DOUBLE), 0)::BIGINT FOR t IN range({k})]"

ORACLE = {
    "temporal_preview_events": with_views(["frames_events"], _D + _FLAG + """, lo AS (SELECT episode_index FROM frames_events GROUP BY 1 ORDER BY count(*) DESC, episode_index LIMIT 1),
 x AS (SELECT fl.*, row_number() OVER (ORDER BY pos) - 1 AS i, row_number() OVER (PARTITION BY anomaly ORDER BY pos) - 1 AS j, count(*) OVER () AS n, (sum(anomaly::INT) OVER ())::BIGINT AS m FROM fl JOIN lo USING (episode_index)),
 y AS (SELECT *, n <= greatest(96 - m, 2) OR list_contains(""" + _EVEN.format(n="n", k="greatest(96 - m, 2)") + """, i) AS sampled, list_contains(""" + _EVEN.format(n="m", k="96") + """, j) AS crowded FROM x)
 SELECT 'events' AS dataset_id, episode_index, pos, round(value, 4) AS value, round(velocity, 4) AS velocity, anomaly, CASE WHEN m > 96 THEN anomaly AND crowded ELSE anomaly OR sampled END AS shown FROM y"""),
    "curve_preview_embeddings": with_views(["frames_embeddings"], TRIM + """, so AS (SELECT episode_index, keep_start, keep_end, length FROM tr WHERE trim_start + trim_end > 0 ORDER BY episode_index LIMIT 80)
 SELECT 'embeddings' AS dataset_id, episode_index, pos, pos NOT BETWEEN keep_start AND keep_end AS trimmed, """ + ", ".join(f"round(action[{i + 1}], 6) AS c{i}" for i in range(8)) + """
 FROM frames_embeddings f JOIN so USING (episode_index) WHERE so.length <= 260 OR list_contains(""" + _EVEN.format(n="so.length", k="260") + """, pos)"""),
    "sample_frames_lineitem": """WITH n AS (SELECT l_orderkey // 1000 AS episode_index, count(*) AS n FROM lineitem GROUP BY 1),
 k AS (SELECT *, least(greatest(least(100, n), floor(n ** 0.75)::BIGINT), 10000) AS k FROM n)
 SELECT DISTINCT 'lineitem' AS dataset_id, episode_index, unnest(CASE WHEN n <= k THEN range(n) ELSE """ + _EVEN.format(n="n", k="k") + """ END) AS pos FROM k""",
    "derivatives_events": with_views(["frames_events"], _D + " SELECT episode_index, pos, round(velocity, 4) AS velocity, round(acceleration, 4) AS acceleration, round(jerk, 4) AS jerk, round(d2, 4) AS d2 FROM d"),
    "temporal_metrics_events": with_views(["frames_events"], _D + """ SELECT 'events' AS dataset_id, 'state' AS source, 0::BIGINT AS axis_index, round(avg(abs(d1)), 4) AS smoothness, round(max(abs(d1)), 4) AS max_delta,
 round(avg(abs(d2)), 4) AS jerk, round(max(abs(d2)), 4) AS max_jerk, round(avg(abs(velocity)), 4) AS mean_velocity, round(max(abs(velocity)), 4) AS max_velocity,
 round(avg(abs(acceleration)), 4) AS mean_acceleration, round(max(abs(acceleration)), 4) AS max_acceleration, round(avg(abs(d.jerk)), 4) AS mean_true_jerk, round(max(abs(d.jerk)), 4) AS max_true_jerk FROM d"""),
    "spike_ratio_events": with_views(["frames_events"], _D + """, v AS (SELECT abs(d2) AS v FROM d WHERE d2 IS NOT NULL), m AS (SELECT avg(v) + 3 * stddev_pop(v) AS limit_ FROM v)
 SELECT 'events' AS dataset_id, 'state' AS source, 0::BIGINT AS axis_index, round(avg(CASE WHEN limit_ > 0 AND v > limit_ THEN 1.0::DOUBLE ELSE 0 END), 6) AS spike_ratio FROM v, m"""),
    "constraint_metrics_events": with_views(["frames_events"], _D + """ SELECT 'events' AS dataset_id, 'state' AS source, 0::BIGINT AS axis_index, count(value) AS n_position,
 count(*) FILTER (value < 5 - 1e-9 OR value > 100 + 1e-9) AS n_beyond, count(velocity) AS n_velocity, count(*) FILTER (abs(velocity) > 0.01 + 1e-9) AS n_fast, round(max(abs(velocity)), 6) AS max_speed,
 round(count(*) FILTER (value < 5 - 1e-9 OR value > 100 + 1e-9) / count(value)::DOUBLE, 6) AS position_ratio, round(count(*) FILTER (abs(velocity) > 0.01 + 1e-9) / count(velocity)::DOUBLE, 6) AS velocity_ratio FROM d"""),
    "timestamp_summary_events": with_views(["frames_events"], """, t AS (SELECT ts - lag(ts) OVER (PARTITION BY episode_index ORDER BY pos) AS dt FROM frames_events)
 SELECT 'events' AS dataset_id, count(dt) AS n, round(avg(dt), 3) AS mean_dt, round(stddev_pop(dt), 3) AS std_dt, round(min(dt), 3) AS min_dt, round(max(dt), 3) AS max_dt,
 round(avg(abs(dt - 1 / 30.0::DOUBLE)), 3) AS mean_jitter, round(max(abs(dt - 1 / 30.0::DOUBLE)), 3) AS max_jitter FROM t WHERE dt IS NOT NULL"""),
    "flag_anomalies_events": with_views(["frames_events"], _D + _FLAG + " SELECT episode_index, pos, round(velocity, 4) AS velocity FROM fl WHERE anomaly"),
    "smooth_actions_events": with_views(["frames_events"], _D + _FLAG + _SMOOTH + " SELECT episode_index, pos, touched, round(smoothed, 6) AS smoothed FROM sm"),
    "smoothing_report_events": with_views(["frames_events"], _D + _FLAG + _SMOOTH + """ SELECT 'events' AS dataset_id, 'state' AS source, episode_index, 0::BIGINT AS axis_index, count(*) FILTER (touched) AS n_changed,
 count(*) FILTER (anomaly) AS n_anomalies, round(max(abs(smoothed - value)), 6) AS max_change FROM sm GROUP BY episode_index HAVING count(*) FILTER (touched) > 0"""),
    "window_motion_embeddings": with_views(["frames_embeddings"], _MOVE + " SELECT 'embeddings' AS dataset_id, episode_index, pos, round(motion, 6) AS motion FROM mo WHERE motion IS NOT NULL"),
    "static_edge_trim_embeddings": with_views(["frames_embeddings"], TRIM + """ SELECT 'embeddings' AS dataset_id, episode_index, length, CASE WHEN why IS NULL THEN 'ok' ELSE 'skipped' END AS status,
 coalesce(why, 'static edges') AS reason, trim_start, trim_end, keep_start, keep_end, round(max_motion, 6) AS max_motion, round(mean_motion, 6) AS mean_motion FROM tr"""),
    "trimmed_frames_embeddings": with_views(["frames_embeddings"], TRIM + """ SELECT 'embeddings' AS dataset_id, f.episode_index, f.pos FROM frames_embeddings f JOIN tr USING (episode_index)
 WHERE f.pos < trim_start OR f.pos >= tr.length - trim_end"""),
    "max_joint_speed_embeddings": with_views(["frames_embeddings"], """, s AS (SELECT episode_index, pos, state, lag(state) OVER (PARTITION BY episode_index ORDER BY pos) AS p FROM frames_embeddings)
 SELECT 'embeddings' AS dataset_id, episode_index, pos, round(CASE WHEN p IS NULL THEN 0 ELSE list_max([abs(z[1] - z[2]) for z in list_zip(state, p)]) * 30 END, 6) AS speed FROM s"""),
    "max_action_jump_embeddings": with_views(["frames_embeddings"], """, s AS (SELECT action, lag(action) OVER (PARTITION BY episode_index ORDER BY pos) AS p FROM frames_embeddings)
 SELECT 'embeddings' AS dataset_id, round(max(sqrt(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(action, p)]))), 6) AS max_jump FROM s WHERE p IS NOT NULL"""),
    "static_axes_embeddings": with_views(["frames_embeddings"], """ SELECT 'embeddings' AS dataset_id, 'action' AS source, axis_index::BIGINT AS axis_index, round(stddev_pop(a), 6) AS std
 FROM axis_embeddings GROUP BY axis_index HAVING stddev_pop(a) < 0.122"""),
    "lagged_correlation_embeddings": with_views(["frames_embeddings"], _PAIRS + " SELECT 'embeddings' AS dataset_id, episode_index, axis_index, lag, round(correlation, 6) AS correlation, weight FROM j WHERE correlation IS NOT NULL"),
    "state_action_lag_embeddings": with_views(["frames_embeddings"], BEST + """ SELECT 'embeddings' AS dataset_id, axis_index, lag AS lag_frames, round(lag / 30.0::DOUBLE, 6) AS lag_seconds, round(size, 6) AS abs_correlation,
 round(correlation, 6) AS correlation, weight AS sample_weight FROM b"""),
    "lag_summary_embeddings": with_views(["frames_embeddings"], BEST + """ SELECT 'embeddings' AS dataset_id, count(*) AS n_axes, median(lag)::DOUBLE AS median_lag, round(avg(abs(lag)), 6) AS mean_abs_lag, max(abs(lag)) AS max_abs_lag,
 round(avg(size), 6) AS mean_abs_correlation FROM b"""),
    "compress_ranges_events": """WITH e AS (SELECT DISTINCT event_type, event_id FROM events WHERE event_type IN ('click', 'view')),
 i AS (SELECT *, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM e) SELECT event_type, min(event_id) AS first, max(event_id) AS last FROM i GROUP BY event_type, g""",
}
