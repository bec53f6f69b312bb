import json

from trajspark.operators import joints
from trajspark.sources import limits, readers


def _put(root, files):
    for name, value in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(value if isinstance(value, str) else json.dumps(value))


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_names_and_groups_of_configurations(spark, tmp_path):
    _put(tmp_path, {
        "a/joint_config.json": {"joint_names": ["left_elbow_1", "neck"]}, "a/meta/joint_config.json": {"joint_names": ["inner"]},
        "b/joint_config.json": "no json", "b/meta/joint_config.json": {"joint_groups": {"left": ["x", "y"], "rest": ["z"]}},
        "c/joint_config.json": {"joint_names": ["p", "q", "r"], "joint_groups": {"one": ["q", "p"], "two": ["q"]}},
        "d/joint_config.json": {"other": 1}, "e/joint_config.json": {"joint_names": []},
    })
    got = _rows(limits.config_axes(limits.joint_configs(spark, [str(tmp_path)])), "dataset_id", "axis_index", "axis_name", "grp")
    own = {r[:3]: r[3] for r in got}
    assert [r[:3] for r in got] == [("a", 0, "left_elbow_1"), ("a", 1, "neck"), ("b", 0, "x"), ("b", 1, "y"), ("b", 2, "z"), ("c", 0, "p"), ("c", 1, "q"), ("c", 2, "r")]
    assert own["a", 0, "left_elbow_1"] == "left_arm" and own["b", 2, "z"] == "rest" and own["c", 1, "q"] == "one" and own["c", 2, "r"] is None


def test_limits_of_configurations(spark, tmp_path):
    _put(tmp_path, {"a/joint_config.json": {
        "joint_names": ["J-1", "j 2", "J3"],
        "joint_constraints": {"j_1": {"min_position": -1, "max_position": "2.5", "velocity": None, "max_velocity": 9}, "J3": {"lower": "x", "upper": "inf", "effort": 4}, "none": {"lower": 1}, "j 2": 7},
        "joint_limits": {"J-1": {"lower": -3}, "J_2": {"lower": 0, "min_position": 5}},
        "constraints": [1, 2],
    }, "b/joint_config.json": {"joint_names": ["x"], "joint_limits": None}})
    got = _rows(limits.config_limits(limits.joint_configs(spark, [str(tmp_path)])), "dataset_id", "axis_index", "axis_name", *joints.LIMITS)
    assert got == [("a", 0, "J-1", -3.0, 2.5, None, None), ("a", 1, "j 2", 0.0, None, None, None), ("a", 2, "J3", None, None, None, 4.0)]


def test_limits_of_features(spark, tmp_path):
    _put(tmp_path, {"a/meta/info.json": {"features": {
        "observation.state": {"dtype": "float32", "shape": [3], "lower": [-1, "y", -3, -9], "upper": {"A": 1, "1": 2, "7": 3}, "limits": {"lower": {"c": -4}, "max_velocity": [5, 6]}},
        "action": {"dtype": "float32", "shape": [2]},
    }}, "b/meta/info.json": {"features": {}}, "c/meta/info.json": {}})
    axes = spark.createDataFrame([("a", "observation.state", i, n) for i, n in enumerate("abC")], "dataset_id string, feature string, axis_index int, axis_name string")
    found = limits.feature_limits(readers.features(readers.read_info(spark, [str(tmp_path)])), axes)
    got = _rows(found, "feature", "axis_index", "axis_name", *joints.LIMITS)
    assert got == [("observation.state", 0, "a", -1.0, 1.0, 5.0, None), ("observation.state", 1, "b", None, 2.0, 6.0, None), ("observation.state", 2, "C", -4.0, None, None, None)]
    config = spark.createDataFrame([("a", "B", -7.0, None, None, None)], "dataset_id string, axis_name string, lower double, upper double, velocity_limit double, torque_limit double")
    best = {r.axis_name: r for r in joints.resolve_constraints(axes.drop("feature"), config, found.drop("feature", "axis_index")).collect()}
    assert (best["b"].lower, best["b"].upper, best["b"].source) == (-7.0, 2.0, "config+feature") and best["C"].source == "feature"
