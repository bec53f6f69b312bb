import math

from trajspark.operators import joints


def test_degrees_become_radians(spark):
    axis = spark.createDataFrame([("d", e, 0, k, v) for e, vs in ((0, [180.0, 90.0]), (1, [1.0, 90.0])) for k, v in enumerate(vs)], "dataset_id string, episode_index long, pos long, axis_index int, value double")
    kinds = spark.createDataFrame([("d", 0, "revolute"), ("d", 1, "prismatic")], "dataset_id string, axis_index int, kind string")
    got = {(r.episode_index, r.axis_index): r.value for r in joints.normalize_angle_units(axis, kinds).collect()}
    assert got == {(0, 0): math.pi, (0, 1): 90.0, (1, 0): 1.0, (1, 1): 90.0}


def test_mirrored_joint_follows(spark):
    table = spark.createDataFrame([("d", "a", "prismatic", [1.0, 0.0], 0.0, 0.4), ("d", "b", "prismatic", [-1.0, 0.0], -0.4, 0.0), ("d", "c", "prismatic", [1.0, 0.0], -0.4, 0.0)],
                                  "dataset_id string, joint string, kind string, axis array<double>, lower double, upper double")
    pairs = joints.mirror_pairs(table, spark.createDataFrame([("d", "a")], "dataset_id string, joint string"))
    assert [tuple(r) for r in pairs.collect()] == [("d", "b", "a")]
    values = joints.mirror_prismatic(spark.createDataFrame([("d", "a", 0.2)], "dataset_id string, joint string, value double"), pairs)
    assert sorted((r.joint, r.value) for r in values.collect()) == [("a", 0.2), ("b", -0.2)]


def test_config_limits_win(spark):
    schema = "dataset_id string, axis_name string, lower double, upper double, velocity_limit double, torque_limit double"
    axes = spark.createDataFrame([("d", 0, "Left-Elbow"), ("d", 1, "x")], "dataset_id string, axis_index int, axis_name string")
    out = joints.resolve_constraints(axes, spark.createDataFrame([("d", "left_elbow", -1.0, None, None, None)], schema), spark.createDataFrame([("d", "left elbow", -2.0, 2.0, None, None)], schema))
    got = {r.axis_index: (r.lower, r.upper, r.source) for r in out.collect()}
    assert got == {0: (-1.0, 2.0, "config+feature"), 1: (None, None, None)}
