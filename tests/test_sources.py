import json

import pytest
from pyspark.sql import functions as F

from trajspark.operators import alignment
from trajspark.sources import limits, readers, writers
from trajspark.streaming.ingest import incremental_ingest


@pytest.fixture
def root(spark, tmp_path):
    root = tmp_path / "clean"
    (root / "meta").mkdir(parents=True)
    info = {"codebase_version": "v2.1", "fps": 10, "total_episodes": 2, "total_frames": 4, "features": {"action": {"dtype": "float32", "shape": [11], "names": ["a"]}, "observation.state": {"dtype": "float32", "shape": [2]}}}
    (root / "meta/info.json").write_text(json.dumps(info))
    (root / "meta/tasks.jsonl").write_text('{"task_index": 0, "task": "pick"}\n\n{"task_index": 1, "task": "place"}\n')
    import pyarrow as pa
    import pyarrow.parquet as pq

    (root / "data/chunk-000").mkdir(parents=True)
    for e in (0, 1):
        columns = {"observation.state": [[1.0, 2.0], [3.0, 4.0]], "timestamp": [0.0, 0.1], "episode_index": [9, 9]} | {f"action_{i}": [float(i)] * 2 for i in range(11)}
        pq.write_table(pa.table(columns), root / f"data/chunk-000/episode_00000{e}.parquet")
    (root / "data/notes.parquet").write_bytes(b"")
    return str(root)


def test_read_dataset(spark, root):
    f = readers.scan_frames(spark, [root])
    rows = f.orderBy("episode_index", "pos").collect()
    assert [(r.dataset_id, r.episode_index, r.pos) for r in rows] == [("clean", e, p) for e in (0, 1) for p in (0, 1)]
    assert rows[0].action == [float(i) for i in range(11)] and rows[0].state == [1.0, 2.0]
    info = readers.read_info(spark, [root])
    assert readers.datasets(info).first()[:4] == ("clean", "v2.1", 10.0, None)
    assert {r.feature: r.shape for r in readers.features(info).collect()} == {"action": [11], "observation.state": [2]}
    assert readers.read_jsonl(spark, [root], "tasks.jsonl", readers.TASKS).where("task is not null").count() == 2
    assert {r.subdir for r in readers.directory_sizes(readers.file_listing(spark, [root])).collect()} == {"meta", "data"}


def test_incremental_ingest(spark, tmp_path):
    schema = "bag string, topic string, ts_ns long, seq long"
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), schema, lambda m: m.groupBy("bag").agg(F.count(F.lit(1)).alias("n")))
    for k in range(2):
        spark.createDataFrame([(f"bag{k}", "a", i, i) for i in range(3 + k)], schema).write.mode("append").parquet(args[0])
        incremental_ingest(spark, *args)
    incremental_ingest(spark, *args)
    assert sorted((r.episode_index, r.bag, r.n) for r in spark.read.parquet(args[1]).collect()) == [(0, "bag0", 3), (1, "bag1", 4)]
    assert alignment.IMAGE_TYPES


def test_written_datasets_are_read_back(spark, tmp_path):
    rows = [("d", e, p, p / 30, [float(e), float(p)], [float(p)], p % 2) for e in range(5) for p in range(3 + e)]
    f = spark.createDataFrame(rows, "dataset_id string, episode_index long, pos long, timestamp double, state array<double>, action array<double>, task_index long")
    tasks = spark.createDataFrame([("d", 0, "pick"), ("d", 1, "plätze")], "dataset_id string, task_index long, task string")
    episodes = spark.createDataFrame([("d", e, ["pick"]) for e in range(5)], "dataset_id string, episode_index long, tasks array<string>")
    want = sorted((r[1], r[2], r[4], r[5]) for r in rows)
    read = lambda df: sorted((r.episode_index, r.pos, r.state, r.action) for r in df.collect())
    root = str(tmp_path / "v21")
    paths = {r.path for r in writers.write_dataset(f, episodes, tasks, root, fps=30.0, robot="arm", chunk_size=2).collect()}
    assert {"d/data/chunk-002/episode_000004.parquet", "d/meta/info.json", "d/meta/episodes_stats.jsonl", "d/meta/stats.json"} <= paths and len(paths) == 10
    assert read(readers.scan_frames(spark, [root])) == want
    info = readers.read_info(spark, [root])
    d = readers.datasets(info).first()
    assert (d.version, d.robot_type, d.total_episodes, d.total_frames, d.chunks_size) == ("v2.1", "arm", 5, 25, 2)
    assert {r.feature: r.shape for r in readers.features(info).collect()}["observation.state"] == [2]
    assert [json.loads(x)["task"] for x in (tmp_path / "v21/d/meta/tasks.jsonl").read_text().splitlines()] == ["pick", "plätze"]
    line = json.loads((tmp_path / "v21/d/meta/episodes_stats.jsonl").read_text().splitlines()[1])
    assert line["episode_index"] == 1 and line["stats"]["observation.state"]["max"] == [1.0, 3.0] and line["stats"]["action"]["count"] == [4]
    assert {r.feature for r in readers.stats_keys(spark, [root]).collect()} == {"action", "observation.state", "timestamp", "frame_index", "episode_index", "task_index"}
    assert [r.task_index for r in readers.list_episodes(readers.read_jsonl(spark, [root], "episodes.jsonl", readers.EPISODES)).collect()] == [0] * 5
    assert [r.pos for r in readers.episode_frames(readers.scan_frames(spark, [root]), 2).collect()] == list(range(5))
    columns, n, some = readers.table_preview(f, 3)
    assert len(columns) == 7 and n == 25 and some.count() == 3
    old = {r.path for r in writers.write_dataset(f, episodes, tasks, str(tmp_path / "v20"), "v2.0").collect()}
    assert "d/meta/stats.json" in old and "d/meta/episodes_stats.jsonl" not in old
    assert json.loads((tmp_path / "v20/d/meta/info.json").read_text())["codebase_version"] == "v2.0"
    shared = str(tmp_path / "v30")
    files = {r.path: r.n_rows for r in writers.write_shared_dataset(f, episodes, tasks, shared, limit=600).collect()}
    assert sum("/data/" in p for p in files) > 1 and sum(n for p, n in files.items() if "/data/" in p) == 25
    assert read(writers.read_shared_dataset(spark, [f"{shared}/d"])) == want
    import pandas as pd

    table = pd.read_parquet(f"{shared}/d/meta/episodes/chunk-000/file-000.parquet").set_index("episode_index")
    for name, metric in (("observation.state", "max"), ("action", "q10"), ("timestamp", "mean"), ("frame_index", "count")):
        assert list(table.loc[1, f"stats/{name}/{metric}"]) == line["stats"][name][metric]
    named = spark.createDataFrame([("d", i, f"joint {i}") for i in (1, 0)], "dataset_id string, axis_index int, axis_name string")
    assert "d/meta/joint_config.json" in {r.path for r in writers.write_dataset(f, episodes, tasks, str(tmp_path / "named"), joints=named).collect()}
    config = limits.config_axes(limits.joint_configs(spark, [str(tmp_path / "named")]))
    assert sorted((r.axis_index, r.axis_name) for r in config.collect()) == [(0, "joint 0"), (1, "joint 1")]

    assert list(pd.read_parquet(f"{shared}/d/meta/tasks.parquet").index) == ["pick", "plätze"]


def test_written_datasets_pass_their_own_checks_and_lose_stale_files(spark, tmp_path):
    from trajspark.operators import quality

    rows = [("d", e, p, p / 30, [float(e), float(p)], [float(p)], 0) for e in range(3) for p in range(4)]
    f = spark.createDataFrame(rows, "dataset_id string, episode_index long, pos long, timestamp double, state array<double>, action array<double>, task_index long")
    tasks = spark.createDataFrame([("d", 0, "pick")], "dataset_id string, task_index long, task string")
    episodes = f.select("dataset_id", "episode_index").distinct().withColumn("tasks", F.array(F.lit("pick")))
    root = str(tmp_path / "out")
    writers.write_dataset(f, episodes, tasks, root)
    written = writers.write_dataset(f.where("episode_index < 2"), episodes.where("episode_index < 2"), tasks, root)
    assert sorted(p.name for p in (tmp_path / "out").rglob("episode_*.parquet")) == ["episode_000000.parquet", "episode_000001.parquet"]
    assert written.count() == 7 and (tmp_path / "out/d/meta/episodes_stats.jsonl").read_text().count("\n") == 2
    info = readers.read_info(spark, [root])
    d, features = readers.datasets(info), readers.features(info).select("dataset_id", "feature", F.get("shape", F.lit(0)).alias("dim"))
    n = spark.createDataFrame([("d", 2)], "dataset_id string, n long")
    checks = quality.stats_checks(readers.read_stats(spark, [root]), d, features, n).collect()
    assert len(checks) == 7 and {r.level for r in checks} == {"pass"}


def test_a_table_larger_than_a_row_group_is_written_in_parts(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(writers, "ROW_GROUP", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    rows = spark.range(1000).selectExpr("id % 2 AS k", "id", "concat('x', id) AS t")
    told = writers.write_tables(rows, str(tmp_path), F.concat(F.lit("f"), F.col("k"), F.lit(".parquet")), ["id"]).collect()
    assert sorted((r.path, r.n_rows) for r in told) == [("f0.parquet", 500), ("f1.parquet", 500)]
    own = pq.ParquetFile(tmp_path / "f1.parquet")
    assert own.read().column("id").to_pylist() == list(range(1, 1000, 2)) and own.num_row_groups > 3
    lines = rows.select(F.concat(F.lit("l"), F.col("k")).alias("path"), (-F.col("id")).alias("at"), "t").withColumnRenamed("t", "line")
    writers.write_lines(lines, str(tmp_path)).collect()
    assert (tmp_path / "l0").read_text().split() == [f"x{i}" for i in range(998, -1, -2)]
