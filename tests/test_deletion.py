import numpy as np
from pyspark.sql import functions as F

from trajspark.operators import axes, deletion, report


def test_junctions_and_bridges(spark):
    v = [float(i) for i in range(10)] + [9.0 + 3 * float(np.sin(i)) for i in range(1, 12)] + [20.0 + i for i in range(10)]
    f = spark.createDataFrame([("d", 0, i, i / 30, [x]) for i, x in enumerate(v)], "dataset_id string, episode_index long, pos long, timestamp double, state array<double>")
    a = axes.explode_axes(f, "state")
    smooth = deletion.junction_report(a, f.where("pos in (3, 4)"), 3.0).first()
    assert (smooth.left, smooth.right, smooth.n_between) == (2, 5, 2)
    j = deletion.junction_report(a, f.where("pos between 10 and 20"))
    assert j.count() == 1
    forced = j.withColumn("smooth", F.lit(False))
    for out in (deletion.bridge_frames(f, forced, f.where("pos between 10 and 20")), deletion.bridge_frames_curve(a, forced), deletion.bridge_frames_filter(f, a, forced)):
        pos = [r.pos for r in out.collect()]
        assert pos and all(10 <= p <= 20 for p in pos) and len(pos) == len(set(pos))


def test_farthest_points():
    path = np.array([[0.0], [0.0], [5.0], [0.0], [0.0]])
    assert deletion.farthest_points(path, 1.0) == [1, 2, 3] and deletion.farthest_points(path, 9.0) == []


def test_joint_report(spark):
    f = spark.createDataFrame([("d", e, i, i / 30, [float(i * e), 1.0]) for e in range(3) for i in range(12)], "dataset_id string, episode_index long, pos long, timestamp double, state array<double>")
    r = report.joint_report(axes.explode_axes(f, "state"))
    assert r.count() == 2 and report.top_axes(r, "jerk", 1).count() == 1


def _kept(path, left, right, tolerance):
    """Positions that the recursive rule keeps strictly between left and right."""
    if right - left < 2:
        return []
    off = [max(abs(x - (a + (b - a) * (i - left) / (right - left))) for x, a, b in zip(path[i], path[left], path[right])) for i in range(left + 1, right)]
    if max(off) <= tolerance:
        return []
    k = left + 1 + off.index(max(off))
    return _kept(path, left, k, tolerance) + [k] + _kept(path, k, right, tolerance)


def test_bridges_against_the_rules_in_plain_python(spark):
    rng = np.random.default_rng(9)
    rows, junctions, dp, curve = [], [], {}, {}
    for e, (left, right) in enumerate([(3, 9), (5, 20), (2, 5), (0, 7), (10, 29), (4, 6), (6, 12)]):
        path = np.cumsum(rng.normal(0, 1 + e % 3, (30, 2)), axis=0).tolist() if e != 6 else [[float(i), 0.0] for i in range(30)]
        rows += [("d", e, i, i / 30, x) for i, x in enumerate(path)]
        n = right - left - 1
        junctions.append(("d", e, left, right, n, False))
        stay = [x for i, x in enumerate(path) if not left < i < right]
        steps = np.abs(np.diff(np.array(stay), axis=0)).mean(0).max() / 2
        least, own = max(2, n // 3), path[left : right + 1]
        kept = _kept(own, 0, len(own) - 1, steps)
        if len(kept) < least:
            off = sorted((max(abs(x - (a * (1 - i / (n + 1)) + b * i / (n + 1))) for x, a, b in zip(own[i], own[0], own[-1])) for i in range(1, n + 1)), reverse=True)
            kept = _kept(own, 0, len(own) - 1, 0.99 * off[min(least, n) - 1])
        dp[e] = [left + i for i in kept]
        p, width = np.array(path), right - left
        m0 = (p[left] - p[left - 1]) * width if left else np.zeros(2)
        m1 = (p[right + 1] - p[right]) * width if right < 29 else np.zeros(2)
        far = []
        for i in range(left + 1, right):
            t = (i - left) / width
            ideal = (2 * t**3 - 3 * t**2 + 1) * p[left] + (t**3 - 2 * t**2 + t) * m0 + (3 * t**2 - 2 * t**3) * p[right] + (t**3 - t**2) * m1
            far.append(float(np.linalg.norm(p[i] - ideal)))
        k = min(n, max(2, 1 + n // 3))
        cuts = [int(i * (n / k)) for i in range(k)] + [n]
        curve[e] = sorted(left + 1 + a + int(np.argmin(far[a:b])) for a, b in zip(cuts, cuts[1:]) if a < b)
    f = spark.createDataFrame(rows, "dataset_id string, episode_index long, pos long, timestamp double, state array<double>")
    j = spark.createDataFrame(junctions, "dataset_id string, episode_index long, left long, right long, n_between long, smooth boolean")
    gone = f.join(j, ["dataset_id", "episode_index"]).where("pos > left and pos < right")
    for df, want in ((deletion.bridge_frames(f, j, gone), dp), (deletion.bridge_frames_curve(axes.explode_axes(f, "state"), j), curve)):
        got = {e: [] for e in want}
        for r in df.collect():
            got[r.episode_index].append(r.pos)
        assert {e: sorted(v) for e, v in got.items()} == want


def test_low_pass():
    ramp = np.stack([np.full(40, 3.0), np.arange(40.0)], axis=1)
    assert np.allclose(deletion.low_pass(ramp)[:, 0], 3) and np.allclose(deletion.low_pass(ramp), ramp, atol=0.01)  # the run settles at the ends
    # the gain forth and back is that of the square of the filter: 1 / (1 + (tan(w / 2) / tan(pi / 8)) ** 6)
    for w in (0.2, np.pi / 4, 1.5):
        wave = np.sin(w * np.arange(400))[:, None]
        gain = 1 / (1 + (np.tan(w / 2) / np.tan(np.pi / 8)) ** 6)
        assert np.allclose(deletion.low_pass(wave)[100:300], gain * wave[100:300], atol=1e-6)


def test_steps_beside_a_junction_are_those_of_the_recording(spark):
    v = [0.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0]
    f = spark.createDataFrame([("d", 0, i, i / 30, [x]) for i, x in enumerate(v)], "dataset_id string, episode_index long, pos long, timestamp double, state array<double>")
    got = {r.left: r.ratio for r in deletion.splice_check(axes.explode_axes(f, "state"), f.where("pos in (1, 3)")).collect()}
    # threshold: median 0 and MAD 0, so 1e-6; frame 2 is between two deletions, its steps are 1.0 on both sides
    assert got == {0: 999.0, 2: 999.0}
    wide = spark.createDataFrame([("d", 0, i, i / 30, [x]) for i, x in enumerate([0.0, 2.0, 1.0, 3.0, 2.0, 4.0, 3.0, 9.0])], f.schema)
    r = {r.left: r for r in deletion.splice_check(axes.explode_axes(wide, "state"), wide.where("pos in (1, 3)")).collect()}
    # second differences: 3, 3, 3, 3, 3, 7: median 3, MAD 0; jump of 1 after the step -1 and before the step 2
    assert abs(r[2].ratio - 2 / 3) < 1e-9 and not r[2].bad


def test_analysis_of_a_deletion(spark):
    rng = np.random.default_rng(3)
    rows = [("d", 0, i, i / 30, [float(i), 1.0]) for i in range(20)]
    path = np.cumsum(rng.normal(0, 1, 40))
    rows += [("d", 1, i, i / 30, [float(x), 1.0]) for i, x in enumerate(path)]
    rows += [("d", 2, i, i / 30, [float(np.sin(2 * i)) * 9, 0.0]) for i in range(10)]
    f = spark.createDataFrame(rows, "dataset_id string, episode_index long, pos long, timestamp double, state array<double>")
    gone = f.where("(episode_index = 0 and pos > 15) or (episode_index = 1 and pos between 8 and 30) or (episode_index = 2 and pos in (4, 5))")
    a = axes.explode_axes(f, "state")
    got = {r.episode_index: r for r in deletion.analyze_deletion(f, a, gone, 0.0).collect()}
    assert set(got) == {1, 2}  # frames cut at the end leave no junction
    one = got[1]
    assert (one.n_junctions, one.n_bad, one.method) == (1, 1, "bridge")
    assert one.frames == sorted(one.frames) and all(8 <= p <= 30 for p in one.frames + one.alternative)
    j = deletion.junction_report(a, gone, 0.0)
    for mine, kept in ((one.frames, deletion.bridge_frames(f, j, gone)), (one.alternative, deletion.bridge_frames_filter(f, a, j))):
        assert mine == sorted(r.pos for r in kept.where("episode_index = 1").collect())
    left = f.where("episode_index = 1 and pos between 8 and 30").where(~F.col("pos").isin(one.frames))
    assert one.bad_after == deletion.junction_report(a, left, 0.0).where("episode_index = 1 and not smooth").count()
    filt = deletion.low_pass(np.stack([path, np.ones(40)], axis=1))
    off = np.abs(path - filt[:, 0])
    k = 1 + 23 // 3
    cuts = [int(i * (23 / k)) for i in range(k)] + [23]
    assert one.alternative == [8 + x + int(np.argmin(off[8 + x : 8 + y])) for x, y in zip(cuts, cuts[1:])]
    calm = deletion.analyze_deletion(f, a, gone, 1e6).collect()
    assert {(r.method, r.n_bad, r.frames) for r in calm} == {("smooth", 0, None)}
