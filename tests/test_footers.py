"""Scans and checks by file footers, on folders with damaged and odd files."""

import json

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from trajspark.sources import footers as X
from trajspark.sources import readers


@pytest.fixture
def root(tmp_path):
    def episode(name, e, columns):
        folder = tmp_path / name / "data/chunk-000"
        folder.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table(columns), folder / f"episode_{e:06d}.parquet")
        return folder / f"episode_{e:06d}.parquet"

    def frames(n, kind=pa.float64()):
        return {"observation.state": pa.array([[float(i), 1.0] for i in range(n)], pa.list_(kind)), "action": pa.array([[float(i)] for i in range(n)]), "timestamp": [i / 10 for i in range(n)]}

    for name in ("good", "broken"):
        (tmp_path / name / "meta").mkdir(parents=True)
        info = {"codebase_version": "v2.1", "total_episodes": 3, "total_frames": 9, "features": {"action": {"dtype": "float64", "shape": [1]}, "observation.state": {"dtype": "float64", "shape": [2]}}}
        (tmp_path / name / "meta/info.json").write_text(json.dumps(info))
        for e in range(3):
            episode(name, e, frames(3, pa.float32() if e == 1 else pa.float64()))
    (tmp_path / "broken/data/chunk-000/episode_000001.parquet").write_bytes(b"PAR1 not a file PAR1")
    (tmp_path / "broken/data/chunk-000/episode_000003.parquet").write_bytes(b"")
    episode("broken", 4, frames(2) | {"timestamp": ["a", "b"]})
    episode("broken", 5, {k: v for k, v in frames(2).items() if k != "action"})
    hurt = episode("broken", 6, {"observation.state": pa.array([[float(i), 1.0] for i in range(2000)]), "action": pa.array([[float(i)] for i in range(2000)]), "timestamp": [i / 10 for i in range(2000)]})
    raw = bytearray(hurt.read_bytes())
    raw[4:4000] = b"\xff" * 3996
    hurt.write_bytes(bytes(raw))
    return tmp_path


def test_good_files_are_scanned_and_bad_ones_told(spark, root):
    foot = X.read_footers(spark, [str(root)]).cache()
    assert {r.path.rpartition("/")[2] + r.path.split("/")[-4]: r.n_rows for r in foot.where("error IS NULL").collect()}["episode_000002.parquetgood"] == 3
    frames, bad = X.scan_frames_tolerant(spark, [str(root)], foot)
    frames = frames.where("episode_index <> 6")
    got = {(r.dataset_id, r.episode_index): r.n for r in frames.groupBy("dataset_id", "episode_index").agg(X.F.count("*").alias("n")).collect()}
    assert got == {("good", 0): 3, ("good", 1): 3, ("good", 2): 3, ("broken", 0): 3, ("broken", 2): 3, ("broken", 5): 2}
    assert frames.where("episode_index = 1").orderBy("pos").first().state == [0.0, 1.0]
    plan = frames.where("timestamp > 0.1").select("dataset_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(timestamp,0.1)" in plan and "action" not in plan.split("ReadSchema")[1].split("\n")[0]
    told = {(r.dataset_id, r.path.rpartition("_")[2]): r.error for r in bad.collect()}
    assert set(told) == {("broken", "000001.parquet"), ("broken", "000004.parquet")}
    assert told["broken", "000004.parquet"] == "column timestamp is string, not double"
    whole, _ = X.scan_frames_tolerant(spark, [str(root)], foot)
    assert [r.path.rpartition("_")[2] for r in X.lost_rows(whole, foot, bad).collect()] == ["000006.parquet"]


def test_load_and_presence_checks(spark, root):
    foot = X.read_footers(spark, [str(root)])
    info = readers.read_info(spark, [str(root)])
    datasets = readers.datasets(info)
    _, bad = X.scan_frames_tolerant(spark, [str(root)], foot)
    load = {r.dataset_id: r for r in X.load_checks(bad, datasets).collect()}
    assert load["good"].level == "pass" and load["broken"].level == "error" and load["broken"].detail.startswith("2 files: episode_000001.parquet: ")
    found = {(r.dataset_id, r.id): (r.level, r.detail) for r in X.presence_checks(foot, readers.features(info), datasets).collect()}
    assert found["good", "feature.action.presence"] == ("pass", "")
    assert found["broken", "feature.action.presence"] == ("error", "declared: true, in 4 of 5 files")
    assert found["broken", "feature.observation.state.presence"][0] == "pass"


def test_task_index_checks(spark, tmp_path):
    tasks = pd.DataFrame({"task_index": [0, 1], "task": ["pick", "place"]})
    for name, frame in {"index": tasks.set_index("task"), "column": tasks, "none": tasks[["task_index"]], "number": tasks.set_index("task_index")}.items():
        (tmp_path / name / "meta").mkdir(parents=True)
        frame.to_parquet(tmp_path / name / "meta/tasks.parquet")
    (tmp_path / "bad/meta").mkdir(parents=True)
    (tmp_path / "bad/meta/tasks.parquet").write_bytes(b"x")
    got = {r.dataset_id: (r.level, r.id, r.fixable) for r in X.task_index_checks(spark, [str(tmp_path)]).collect()}
    name = "task.tasks_parquet_index"
    assert got == {"index": ("pass", name, False), "column": ("warn", name, True), "none": ("error", name, False), "number": ("warn", name, True), "bad": ("error", "task.tasks_parquet_read", False)}
    assert {r.dataset_id: r.level for r in X.task_index_checks(spark, [str(tmp_path)], language=True).collect()}["column"] == "error"
