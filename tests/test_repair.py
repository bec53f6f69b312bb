"""Repair of broken dataset folders in one call."""

import json

import pandas as pd
import pytest

from trajspark.sources import readers, repair


def _dataset(root, name, broken):
    (root / name / "meta").mkdir(parents=True)
    (root / name / "data/chunk-000").mkdir(parents=True)
    (root / name / "videos/chunk-000/cam").mkdir(parents=True)
    (root / name / "videos/chunk-000/cam/episode_000000.mp4").write_bytes(b"v" * 1000)
    features = {"observation.state": {"dtype": "float64", "shape": [2], "names": ["a", "b"]}, "action": {"dtype": "float64", "shape": [1]}, "cam": {"dtype": "video", "shape": [4, 4, 3]}}
    features |= {c: {"dtype": "int64", "shape": [1]} for c in ("frame_index", "episode_index", "index", "task_index")} | {"timestamp": {"dtype": "float64", "shape": [1]}}
    info = {"codebase_version": "v2.1", "robot_type": "arm", "fps": 10, "total_episodes": 99 if broken else 2, "total_frames": 8, "features": features}
    (root / name / "meta/info.json").write_text(json.dumps(info))
    (root / name / "meta/joint_config.json").write_text('{"names": ["a", "b"]}')
    for e in range(2):
        n = 4
        frame = pd.DataFrame({"observation.state": [[float(i), i * e + 0.5] for i in range(n)], "action": [[i + 0.1] for i in range(n)], "timestamp": [0.0, 0.1, 0.1 if broken else 0.2, 0.3], "frame_index": [5] * n if broken else range(n), "task_index": [0] * n})
        if broken:
            frame["task"] = "pick"
        frame.to_parquet(root / name / f"data/chunk-000/episode_{e:06d}.parquet", index=False)
    tasks = pd.DataFrame({"task_index": [0], "task": ["pick"]})
    tasks.to_parquet(root / name / "meta/tasks.parquet", index=False)
    (root / name / "meta/tasks.jsonl").write_text("" if broken else '{"task_index": 0, "task": "pick"}\n')
    (root / name / "meta/episodes.jsonl").write_text('{"episode_index": 0, "length": 1, "task_index": 0}\n')


def test_broken_metadata_come_out_whole(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    _dataset(source, "broken_meta", True)
    before = {p: p.read_bytes() for p in source.rglob("*") if p.is_file()}
    first = {r.id: r.level for r in repair.check_datasets(spark, str(source)).collect()}
    assert {first[k] for k in ("structure.total_episodes", "temporal.frame_index", "temporal.timestamp", "structure.meta/stats.json")} == {"error"}
    # a call that was stopped half way leaves only its staging folder
    (tmp_path / "out.staging/broken_meta/data/chunk-000").mkdir(parents=True)
    (tmp_path / "out.staging/broken_meta/data/chunk-000/episode_000007.parquet").write_bytes(b"half")
    status = repair.repair_dataset(spark, str(source), str(target)).collect()
    checks = repair.check_datasets(spark, str(target)).where("level <> 'pass'").collect()
    assert [(r.dataset_id, r.status) for r in status] == [("broken_meta", "pass")], checks
    assert {p: p.read_bytes() for p in source.rglob("*") if p.is_file()} == before
    own = target / "broken_meta"
    info = json.loads((own / "meta/info.json").read_text())
    assert (info["total_episodes"], info["total_frames"], info["robot_type"]) == (2, 8, "arm") and info["features"]["observation.state"]["names"] == ["a", "b"] and "cam" in info["features"]
    frame = pd.read_parquet(own / "data/chunk-000/episode_000001.parquet")
    assert list(frame["index"]) == [4, 5, 6, 7] and list(frame["frame_index"]) == [0, 1, 2, 3] and list(frame["timestamp"]) == [0.0, 0.1, 0.2, 0.3] and "task" not in frame
    assert list(pd.read_parquet(own / "meta/tasks.parquet").index) == ["pick"] and (own / "meta/tasks.jsonl").read_text() == '{"task_index":0,"task":"pick"}\n'
    assert (own / "videos/chunk-000/cam/episode_000000.mp4").read_bytes() == b"v" * 1000 and (own / "meta/joint_config.json").exists()
    assert not (tmp_path / "out.staging").exists() and not list(own.rglob("episode_000007*"))
    listed = [json.loads(x)["path"] for x in (target / "manifest.jsonl").read_text().splitlines()]
    assert sorted(listed) == sorted({str(p.relative_to(target)) for p in own.rglob("*") if p.is_file()})
    with pytest.raises(ValueError):
        repair.repair_dataset(spark, str(source), str(target))
    assert readers.list_episodes(readers.read_jsonl(spark, [str(target)], "episodes.jsonl", readers.EPISODES)).count() == 2
