"""Operators of the robot-data library on hand-made micro data, and a few registered queries against DuckDB."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from trajspark.operators import alignment, axes, edits, images, lag, layouts, motion, quality, stats


def frames_of(spark, episodes, **extra):
    rows = [("d", e, i, None if t is None else float(t), list(map(float, v))) for e, (times, values) in episodes.items() for i, (t, v) in enumerate(zip(times, values))]
    return spark.createDataFrame(rows, "dataset_id string, episode_index long, pos long, timestamp double, state array<double>")


def test_sanitize_replaces_whole_episode(spark):
    f = frames_of(spark, {0: ([0.0, 0.5, 0.4], [[1]] * 3), 1: ([0.0, None, 2.0], [[1]] * 3), 2: ([0.0, 0.2, 0.3], [[1]] * 3)})
    got = {(r.episode_index, r.pos): r.timestamp for r in axes.sanitize_timestamps(f, 10).collect()}
    assert [got[0, i] for i in range(3)] == [0.0, 0.1, 0.2] and [got[1, i] for i in range(3)] == [0.0, 0.1, 0.2] and [got[2, i] for i in range(3)] == [0.0, 0.2, 0.3]


def test_ragged_rows_are_left_out(spark):
    f = frames_of(spark, {0: ([0, 1, 2, 3], [[1, 2], [3], [5, 6], [7, float("nan")]])})
    a = axes.explode_axes(f, "state")
    assert a.count() == 6 and a.where("value is null").count() == 1


def test_split_columns_by_number(spark):
    df = spark.createDataFrame([tuple(float(i) for i in range(12))], [f"action_{i}" for i in range(12)])
    assert axes.materialize_vector(df, "action").first().action == [float(i) for i in range(12)]


def test_merge_is_whole_for_moments(spark):
    rng = random.Random(1)
    f = frames_of(spark, {e: (range(n), [[rng.random()] for _ in range(n)]) for e, n in ((0, 5), (1, 9), (2, 1))})
    m = stats.merge_stats(stats.episode_stats(axes.explode_axes(f, "state"))).first()
    w = axes.explode_axes(f, "state").agg(F.avg("value"), F.stddev_pop("value"), F.min("value"), F.max("value"), F.count("value")).first()
    assert [m["mean"], m["std"], m["min"], m["max"], m["n"]] == pytest.approx(list(w))


def test_lag_sign(spark):
    rng = random.Random(2)
    x = [rng.random() for _ in range(40)]
    rows = [("d", s, 0, i, i / 30, 0, v) for s, values in (("state", x), ("action", [0.0] * 3 + x[:-3])) for i, v in enumerate(values)]
    a = spark.createDataFrame(rows, "dataset_id string, source string, episode_index int, pos int, ts double, axis_index int, value double")
    assert lag.state_action_lag(a).first().lag_frames == 3


def test_smoothing_spares_ends(spark):
    v = [0.0] * 20
    v[0], v[10], v[19] = 9.0, 9.0, 9.0
    a = axes.explode_axes(frames_of(spark, {0: ([i / 30 for i in range(20)], [[x] for x in v])}), "state")
    out = {r.pos: r for r in motion.smooth_jumps(motion.derivatives(a)).collect()}
    assert out[0].smoothed == 9.0 and out[19].smoothed == 9.0 and not out[0].touched


def test_align_ties_and_ends(spark):
    rng = random.Random(3)
    m, t0 = [], {}
    for topic in ("base", "b", "c"):
        times = sorted(rng.choices(range(0, 60, 2), k=25))
        t0[topic] = times
        m += [("x", topic, "t", t, 100 * (ord(topic[0])) + i) for i, t in enumerate(times)]
    msgs = spark.createDataFrame(m, "bag string, topic string, msg_type string, ts_ns long, seq long")
    out = alignment.align_nearest(msgs, alignment.build_anchors(msgs, "base")).where("topic <> 'base'").collect()
    assert len(out) == 50
    for r in out:
        times = t0[r.topic]
        i = bisect.bisect_left(times, r.anchor_ns)
        late = times[i] if i < len(times) else None
        early = times[i - 1] if i else None
        want = late if early is None or (late is not None and late - r.anchor_ns <= r.anchor_ns - early) else early
        assert r.ts_ns == want
        assert r.seq % 100 == (bisect.bisect_left(times, want) if want >= r.anchor_ns else bisect.bisect_right(times, want) - 1)


def test_delete_nothing_changes_nothing(spark):
    f = frames_of(spark, {0: ([0, 1], [[1], [2]]), 1: ([0], [[3]])})
    out = edits.delete_frames(f, f.limit(0)).orderBy("index").collect()
    assert [(r.episode_index, r.pos, r["index"], r.state) for r in out] == [(0, 0, 0, [1.0]), (0, 1, 1, [2.0]), (1, 0, 2, [3.0])]


def test_emptied_episode_vanishes(spark):
    f = frames_of(spark, {0: ([0], [[1]]), 1: ([0, 1], [[3], [4]])})
    out = edits.delete_frames(f, f.where("episode_index = 0")).collect()
    assert {(r.episode_index, r.orig_episode_index) for r in out} == {(0, 1)}


def test_rename_report():
    assert [x[2] for x in edits.rename_report(["a", "b", "index"], [("a", "a"), ("z", "y"), ("index", "i"), ("a", "b"), ("a", "c"), ("c", "d")])] == ["same name", "no such field", "reserved", "target exists", "applied", "applied"]


def test_expression_division(spark):
    df = spark.createDataFrame([(1.0, [0.0, 2.0])], "a double, v array<double>")
    four = df.select(F.lit(4.0).alias("q"))
    for text, want in (("x / 2 + 1", 3.0), ("(x / 2) + (x / 4)", 3.0), ("-x * (1 - 3) / 2", 4.0), ("any_name - 1.5e0", 2.5)):
        assert four.select(edits.assign_expression(four, "q", text).alias("r")).first().r == want
    for text in ("java_method('java.lang.System','getProperty','user.name')", "x; 1", "x if x else 1", "'a'"):
        with pytest.raises(ValueError):
            edits.assign_expression(four, "q", text)
    assert df.select(edits.assign_expression(df, "v", "1 / x").alias("r")).first().r == [None, 0.5]
    assert df.select(edits.assign_expression(df, "v", "1 / x", True).alias("r")).first().r == [float("inf"), 0.5]
    assert df.select(edits.assign_expression(df, "a", "x * 2").alias("r")).first().r == 2.0


def test_tasks_are_numbered_in_the_order_they_are_first_seen(spark):
    rows = [("b", 0, "x"), ("b", 1, "y"), ("a", 5, "z"), ("a", 2, "y"), ("c", 0, "w"), ("c", 1, "z")]
    t = spark.createDataFrame(rows, "dataset_id string, task_index long, task string")
    order = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "dataset_id string, dataset_order int")
    got = {(r.dataset_id, r.task_index): r.new_index for r in edits.remap_tasks(t, order).collect()}
    assert got == {("b", 0): 0, ("b", 1): 1, ("a", 2): 1, ("a", 5): 2, ("c", 0): 3, ("c", 1): 2}


def test_pack_and_slice(spark):
    sizes = spark.createDataFrame([("d", e, float(b), 3) for e, b in enumerate([5, 5, 5, 12, 1, 1])], "dataset_id string, episode_index long, bytes double, length long")
    got = [(r.chunk, r.file, r.from_index) for r in layouts.pack_files(sizes, 10, 2).orderBy("episode_index").collect()]
    assert got == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 0, 3)]


def test_image_scores_are_not_monotone(spark):
    df = spark.createDataFrame([(3.9,), (4.0,), (6.5,)], "v double")
    got = [r[0] for r in df.select(images.score_entropy(F.col("v"))).collect()]
    assert got[0] > got[1] == 0.0 and got[2] == 100.0


def test_health_leaves_out_unavailable(spark):
    d = spark.createDataFrame([("x", "integrity", 100.0, True), ("x", "constraint", 0.0, False), ("x", "coverage", 50.0, True)], "dataset_id string, dimension string, score double, available boolean")
    assert quality.health_report(d).first().score == pytest.approx((100 * 0.2 + 50 * 0.15) / 0.35, abs=0.06)


def test_topic_names(spark):
    df = spark.createDataFrame([("/camera/left/image_raw/compressed",), ("/robot/arm_state",)], "t string")
    assert [r[0] for r in df.select(alignment.topic_names(F.col("t"))).collect()] == ["cam_left", "cam_robot_arm_state"]


QUERIES = ["merge_stats_events", "derivatives_events", "align_nearest_events", "renumber_after_delete_lineitem", "pack_files_part", "state_action_lag_embeddings",
           "verify_stale_stats_lineitem", "junction_report_embeddings", "training_status_embeddings", "constraint_leaders_embeddings", "temporal_preview_events", "apply_batch_plan_embeddings"]


@pytest.mark.parametrize("name", QUERIES)
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("events", "embeddings", "lineitem", "orders", "part"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in got.description].index(c) for c in columns]
    key = lambda row: [str(x) for x in row]
    want = sorted(([row[i] for i in at] for row in got.fetchall()), key=key)
    have = sorted(([r[c] for c in columns] for r in df.collect()), key=key)
    assert have == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
