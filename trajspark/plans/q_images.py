"""Queries on frame images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators import images, motion
from trajspark.plans import views
from trajspark.plans.rounding import rounded
from trajspark.plans.views import with_views


def gray_metrics_embeddings(spark: SparkSession, d: str) -> DataFrame:
    out = images.gray_metrics(views.gray_embeddings(spark, d))
    return rounded(out.select("episode_index", "pos", "brightness", "brightness_content", "dark_ratio", "overexposed", "underexposed", "entropy", "contrast"))


def frame_difference_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(images.frame_difference(views.gray_embeddings(spark, d)))


def frame_quality_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(images.analyze_frames(views.gray_embeddings(spark, d)).select("episode_index", "pos", "quality"), 4)


def problem_reasons_embeddings(spark: SparkSession, d: str) -> DataFrame:
    out = images.analyze_frames(views.gray_embeddings(spark, d))
    return rounded(out.select("episode_index", "pos", F.array_join("reasons", ",").alias("reasons")))


def episode_image_summary_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(images.episode_image_summary(images.analyze_frames(views.gray_embeddings(spark, d))), 4)


def image_report_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(images.image_report(images.episode_image_summary(images.analyze_frames(views.gray_embeddings(spark, d)))), 4)


def problem_reason_counts_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(images.problem_reason_counts(images.analyze_frames(views.gray_embeddings(spark, d))))


def speed_blur_correlation_embeddings(spark: SparkSession, d: str) -> DataFrame:
    m = images.analyze_frames(views.gray_embeddings(spark, d))
    return rounded(images.speed_blur_correlation(images.join_speed(m, motion.max_joint_speed(views.frames_embeddings(spark, d)))))


def channel_stats_embeddings(spark: SparkSession, d: str) -> DataFrame:
    g = views.gray_embeddings(spark, d)
    p = g.select(*images.CAMERA_EPISODE, "pos", F.lit(2).alias("channels"), F.col("gray").alias("data"))
    return rounded(images.channel_stats(p))


QUERIES = {f.__name__: f for f in (
    gray_metrics_embeddings, frame_difference_embeddings, frame_quality_embeddings, problem_reasons_embeddings, episode_image_summary_embeddings,
    image_report_embeddings, problem_reason_counts_embeddings, speed_blur_correlation_embeddings, channel_stats_embeddings,
)}

_PIX = ", px AS (SELECT episode_index, pos, unnest(gray)::DOUBLE AS v, unnest(range(64)) AS i FROM gray_embeddings)"
_M = _PIX + """, hs AS (SELECT episode_index, pos, v, count(*) / 64.0::DOUBLE AS p FROM px GROUP BY 1, 2, 3), en AS (SELECT episode_index, pos, -sum(p * log2(p)) AS entropy FROM hs GROUP BY 1, 2),
 ga AS (SELECT episode_index, pos, i // 8 AS y, i % 8 AS x, v FROM px),
 nb AS (SELECT g.episode_index, g.pos, any_value(g.v) AS v, sum(n.v * w) - 4 * any_value(g.v) AS lap FROM ga g,
  (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx), ga n, (SELECT 1 AS w)
  WHERE n.episode_index = g.episode_index AND n.pos = g.pos AND n.y = CASE WHEN g.y + dy < 0 THEN 1 WHEN g.y + dy > 7 THEN 6 ELSE g.y + dy END AND n.x = CASE WHEN g.x + dx < 0 THEN 1 WHEN g.x + dx > 7 THEN 6 ELSE g.x + dx END
  GROUP BY g.episode_index, g.pos, g.y, g.x),
 bl AS (SELECT episode_index, pos, var_pop(lap) AS blur FROM nb GROUP BY 1, 2),
 df AS (SELECT a.episode_index, a.pos, coalesce(avg(abs(a.v - b.v)) / 255, 0) AS frame_diff FROM px a LEFT JOIN px b ON b.episode_index = a.episode_index AND b.pos = a.pos - 1 AND b.i = a.i GROUP BY 1, 2),
 m AS (SELECT px.episode_index, px.pos, avg(v) / 255 AS brightness, coalesce(avg(v) FILTER (v >= 15), avg(v)) / 255 AS brightness_content, avg((v < 15)::INT) AS dark_ratio, avg((v > 250)::INT) AS overexposed,
  avg((v < 5)::INT) AS underexposed, stddev_pop(v) / 255 AS contrast FROM px GROUP BY 1, 2),
 mm AS (SELECT m.*, entropy, blur, frame_diff FROM m JOIN en USING (episode_index, pos) JOIN bl USING (episode_index, pos) JOIN df USING (episode_index, pos)),
 q AS (SELECT *, greatest(overexposed, underexposed) AS bad,
  0.35 * CASE WHEN blur >= 200 THEN 100 WHEN blur >= 50 THEN 50 + 50 * (blur - 50) / 150 ELSE blur / 50 * 50 END
  + 0.15 * CASE WHEN brightness_content BETWEEN 0.15 AND 0.85 THEN 100 WHEN brightness_content < 0.15 THEN brightness_content / 0.15 * 100 ELSE (1 - brightness_content) / 0.15 * 100 END
  + 0.20 * CASE WHEN entropy >= 6.5 THEN 100 WHEN entropy >= 4 THEN (entropy - 4) / 2.5 * 100 ELSE entropy / 4 * 50 END
  + 0.15 * CASE WHEN contrast >= 0.15 THEN 100 WHEN contrast >= 0.05 THEN (contrast - 0.05) / 0.10 * 100 ELSE contrast / 0.05 * 50 END
  + 0.15 * CASE WHEN greatest(overexposed, underexposed) < 0.01 THEN 100 WHEN greatest(overexposed, underexposed) < 0.1 THEN 100 - (greatest(overexposed, underexposed) - 0.01) / 0.09 * 80
    ELSE greatest(0, 20 - (greatest(overexposed, underexposed) - 0.1) / 0.9 * 20) END AS quality,
  concat_ws(',', CASE WHEN blur < 50 THEN 'blurry' END, CASE WHEN brightness_content < 0.15 THEN 'dark' END, CASE WHEN brightness_content > 0.85 THEN 'bright' END, CASE WHEN entropy < 4 THEN 'low_info' END,
   CASE WHEN overexposed > 0.1 THEN 'overexposed' END, CASE WHEN underexposed > 0.1 THEN 'underexposed' END, CASE WHEN pos > 0 AND frame_diff < 0.002 THEN 'static' END,
   CASE WHEN pos > 0 AND frame_diff > 0.3 THEN 'scene_change' END) AS reasons FROM mm)"""
_R = lambda names, n=6: ", ".join(f"round({x}, {n}) AS {x}" for x in names)
SUMMARY = _M + """, s AS (SELECT 'embeddings' AS dataset_id, 'cam' AS camera, episode_index, count(*) AS n_frames, """ + ", ".join(f"avg({x}) AS {x}" for x in images.MEANS) + """,
 min(q.blur) AS min_blur, max(q.blur) AS max_blur, count(*) FILTER (pos > 0 AND q.frame_diff < 0.002) / (count(*) - 1)::DOUBLE AS static_ratio, count(*) FILTER (reasons <> '') AS n_problems,
 avg((reasons <> '')::INT) AS problem_ratio FROM q GROUP BY episode_index)"""

ORACLE = {
    "speed_blur_correlation_embeddings": with_views(["gray_embeddings", "frames_embeddings"], _M + """, sl AS (SELECT episode_index, pos, state, lag(state) OVER (PARTITION BY episode_index ORDER BY pos) AS p FROM frames_embeddings),
 sp AS (SELECT episode_index, pos, CASE WHEN p IS NULL THEN 0 ELSE list_max([abs(z[1] - z[2]) for z in list_zip(state, p)]) * 30 END AS speed FROM sl),
 c AS (SELECT CASE WHEN count(*) > 10 THEN corr(speed, blur) END AS r FROM mm JOIN sp USING (episode_index, pos))
 SELECT 'embeddings' AS dataset_id, 'cam' AS camera, round(r, 6) AS correlation, CASE WHEN r < -0.3 THEN 'bad' WHEN r < -0.1 THEN 'poor' WHEN r < 0.1 THEN 'good' WHEN r IS NOT NULL THEN 'acceptable' END AS class FROM c"""),
    "gray_metrics_embeddings": with_views(["gray_embeddings"], _M + f" SELECT episode_index, pos, {_R(['brightness', 'brightness_content', 'dark_ratio', 'overexposed', 'underexposed', 'entropy', 'contrast'])} FROM mm"),
    "frame_difference_embeddings": with_views(["gray_embeddings"], _M + " SELECT 'embeddings' AS dataset_id, 'cam' AS camera, episode_index, pos, round(frame_diff, 6) AS frame_diff FROM df"),
    "frame_quality_embeddings": with_views(["gray_embeddings"], _M + " SELECT episode_index, pos, round(quality, 4) AS quality FROM q"),
    "problem_reasons_embeddings": with_views(["gray_embeddings"], _M + " SELECT episode_index, pos, reasons FROM q"),
    "episode_image_summary_embeddings": with_views(["gray_embeddings"], SUMMARY + f" SELECT dataset_id, camera, episode_index, n_frames, n_problems, {_R([*images.MEANS, 'min_blur', 'max_blur', 'static_ratio', 'problem_ratio'], 4)} FROM s"),
    "image_report_embeddings": with_views(["gray_embeddings"], SUMMARY + """ SELECT dataset_id, camera, count(*) AS n_episodes, round(avg(s.quality), 4) AS quality, round(sum(n_problems) / sum(n_frames), 4) AS problem_ratio,
 arg_max(episode_index, s.quality) AS best_episode, arg_min(episode_index, s.quality) AS worst_episode,
 CASE WHEN avg(s.quality) >= 90 THEN 'excellent' WHEN avg(s.quality) >= 75 THEN 'good' WHEN avg(s.quality) >= 60 THEN 'acceptable' WHEN avg(s.quality) >= 40 THEN 'poor' ELSE 'bad' END AS grade FROM s GROUP BY 1, 2"""),
    "problem_reason_counts_embeddings": with_views(["gray_embeddings"], _M + """, b AS (SELECT * FROM q WHERE reasons <> ''), r AS (SELECT unnest(string_split(reasons, ',')) AS reason FROM b)
 SELECT 'embeddings' AS dataset_id, 'cam' AS camera, reason, count(*) AS n_frames, round(count(*) / (SELECT count(*) FROM b)::DOUBLE, 6) AS share FROM r GROUP BY reason"""),
    "channel_stats_embeddings": with_views(["gray_embeddings"], _PIX + """, c AS (SELECT episode_index, (i % 2)::BIGINT AS channel, v / 255 AS v FROM px)
 SELECT 'embeddings' AS dataset_id, 'cam' AS camera, episode_index, channel, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
 """ + ", ".join(f"round(quantile_cont(v, {q}), 6) AS q{round(q * 100):02d}" for q in (0.01, 0.1, 0.5, 0.9, 0.99)) + """,
 (SELECT count(*) FROM gray_embeddings g WHERE g.episode_index = c.episode_index) AS frames FROM c GROUP BY episode_index, channel"""),
}
