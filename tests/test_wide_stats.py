"""Statistics of many episodes: one shuffle of frames, axes side by side, episodes merged in groups."""

import math
import random

import pytest

from trajspark.operators import axes, stats

KEYS = ["dataset_id", "source", "episode_index", "axis_index"]


def odd_frames(spark):
    rng = random.Random(3)
    value = lambda: rng.choice([rng.gauss(1e3, 1), rng.gauss(0, 1), None, float("nan"), float("inf")])
    rows = [(d, e, p, p / 30.0, [value() for _ in range(3)], float(p * p) if p % 5 else None) for d in ("a", "b") for e in range(7) for p in range(rng.randrange(1, 30))]
    rows += [("a", 7, p, p / 30.0, v, None) for p, v in enumerate([[], None, [1.0], [1.0, 2.0, 3.0, 4.0]])] + [("b", 8, 0, 0.0, [None, float("nan"), 2.5], 1.5)]
    return spark.createDataFrame(rows, "dataset_id string, episode_index long, pos long, timestamp double, state array<double>, load double")


def as_rows(df):
    rounded = lambda x: float(f"{x:.9g}") if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(rounded(x) for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("quantiles", [True, False])
def test_axes_side_by_side_are_the_long_form(spark, quantiles):
    f = odd_frames(spark)
    long = axes.explode_axes(f, "state").select("dataset_id", "episode_index", "source", "pos", "axis_index", "value").unionByName(stats.scalar_axes(f, ["load", "timestamp"]))
    wide = stats.wide_episode_stats(f, {"state": 3}, ["load", "timestamp"], quantiles)
    want = stats.episode_stats(long).select(*[c for c in wide.columns if c != "__group"])
    assert as_rows(wide.drop("__group")) == as_rows(want)
    merged, old = stats.recompute_stats(f, ["state"], ["load", "timestamp"], {"state": 3}), stats.recompute_stats(f, ["state"], ["load", "timestamp"])
    assert merged.columns == old.columns and merged.dtypes == old.dtypes and as_rows(merged) == as_rows(old)


def test_groups_keep_small_deviations(spark):
    """Values of a large mean and a small spread, in more episodes than there are groups."""
    f = spark.range(20_000).selectExpr("'d' AS dataset_id", "id div 2 AS episode_index", "id % 2 AS pos", "0D AS timestamp", "array(1e9 + id % 4) AS state")
    m = stats.recompute_stats(f, ["state"], [], {"state": 1}).first()
    assert (m.n, m.min, m.max) == (20_000, 1e9, 1e9 + 3) and abs(m["mean"] - 1e9 - 1.5) < 1e-6 and abs(m["std"] - math.sqrt(1.25)) < 1e-6


@pytest.mark.parametrize("name", ["recompute_stats_lineitem", "diff_stats_lineitem", "verify_stats_lineitem", "verify_stale_stats_lineitem"])
def test_queries_merge_in_groups_without_a_pass_for_the_length(spark, name):
    """Windows over a whole axis are one task each, and the length of the first row took a sort of all frames by episode."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "__group" in plan and "min_by" not in plan
