from pyspark.sql import functions as F

from trajspark.operators import layouts, quality, stats


def test_codecs(spark):
    v = spark.createDataFrame([("d", "k1", "avc1", 1_000_000), ("d", "k2", " H264", 500_000), ("d", "k1", "hvc1", 100_000), ("d", "k1", None, 1), ("e", "k", "av01", 10)], "dataset_id string, video_key string, codec string, bytes long")
    got = {r.dataset_id: r for r in layouts.codec_summary(v).collect()}
    assert got["d"].codecs == {"h264": 2, "hevc": 1, "unknown": 1} and got["d"].mixed and got["d"].video_keys == ["k1", "k2"] and (got["d"].n_videos, got["d"].total_mb) == (4, 1.6)
    assert got["e"].codecs == {"av1": 1} and not got["e"].mixed


def test_video_and_info_checks(spark):
    d = spark.createDataFrame([("a",), ("b",)], "dataset_id string")
    e = spark.createDataFrame([(x, i) for x in "ab" for i in range(8)], "dataset_id string, episode_index long")
    f = spark.createDataFrame([("a", "observation.images.top"), ("b", "top")], "dataset_id string, feature string")
    v = spark.createDataFrame([("a", 0, "top")] + [("b", i, "top") for i in range(8)], "dataset_id string, episode_index long, camera string")
    got = {r.dataset_id: r for r in quality.video_checks(e, f, v, d).collect()}
    assert got["a"].level == "error" and got["a"].detail.startswith("7 missing: episode 1 observation.images.top; ") and got["a"].detail.count(";") == 4
    assert (got["b"].level, got["b"].detail) == ("pass", "")
    info = spark.createDataFrame([("a", '{"fps": 30}'), ("b", "[1]"), ("c", "no json")], "dataset_id string, t string").select("dataset_id", F.try_parse_json("t").alias("info"))
    assert {r.dataset_id: r.level for r in quality.info_checks(info).collect()} == {"a": "pass", "b": "error", "c": "error"}


def test_safe_aggregates(spark):
    x = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 4.0), ("b", float("inf")), ("b", None)], "k string, v double")
    got = {r.k: (r.m, r.x) for r in x.groupBy("k").agg(quality.safe_mean(F.col("v")).alias("m"), quality.safe_max(F.col("v")).alias("x")).collect()}
    assert got == {"a": (2.5, 4.0), "b": (0.0, 0.0)}


def test_sketched_thresholds_are_close(spark):
    x = spark.range(0, 40_000, 1, 4).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919 % 40_009) / 40_009.0).alias("value"))
    exact, sketched = ({r.k: r.threshold for r in stats.anomaly_threshold(x, ["k"], exact=e).collect()} for e in (True, False))
    # values are spread evenly over 0 to 1, so the median and the MAD, six times of it, err by some ten-thousandths each
    assert set(exact) == {0, 1} and all(abs(exact[k] - sketched[k]) <= 7 * 2e-4 for k in exact)
