"""The source of recorded messages, in batches and as a stream."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from trajspark.sources import messages
from trajspark.streaming.ingest import incremental_ingest


def put(root, bag, name, rows, **more):
    (root / bag).mkdir(parents=True, exist_ok=True)
    columns = {"topic": [r[0] for r in rows], "ts_ns": [r[1] for r in rows], "seq": [r[2] for r in rows], "positions": [[float(r[2])] for r in rows]}
    pq.write_table(pa.table(columns | more), root / bag / name, row_group_size=2)


def test_batches_with_pushed_filters(spark, tmp_path):
    messages.register(spark)
    put(tmp_path, "one", "a.parquet", [("arm", 1, 0), ("arm", 2, 1), ("cam", 3, 2), ("cam", 4, 3), (None, 5, 4)])
    put(tmp_path, "deep/two", "a.parquet", [("arm", 1, 0)], msg_type=["t"])
    (tmp_path / "one/notes.txt").write_text("x")
    df = spark.read.format(messages.NAME).load(str(tmp_path))
    assert df.schema.simpleString() == "struct<" + messages.SCHEMA.replace("long", "bigint").replace(" ", ":").replace(",:", ",") + ">"
    got = sorted((r.bag, r.topic, r.seq, r.msg_type, r.positions) for r in df.where("topic IS NOT NULL").collect())
    assert got == [("deep/two", "arm", 0, "t", [0.0]), ("one", "arm", 0, None, [0.0]), ("one", "arm", 1, None, [1.0]), ("one", "cam", 2, None, [2.0]), ("one", "cam", 3, None, [3.0])]
    some = messages.read_messages(spark, str(tmp_path), ["cam"], ["one", "x"])
    assert [r.seq for r in some.where("seq > 2").collect()] == [3]
    both = df.where("topic = 'cam'").groupBy("bag").count().union(df.groupBy("bag").count()).union(some.groupBy("bag").count())
    assert sorted(r["count"] for r in both.collect()) == [1, 2, 2, 5]
    assert [(p.bag, p.group) for p in messages.Reader(str(tmp_path), ("cam",), {"one"}).partitions()] == [("one", 1), ("one", 2)]  # the last one's statistics tell nothing
    assert messages.read_messages(spark, str(tmp_path), topics=[]).count() == 0
    assert df.where("bag = 'none'").count() == 0 and df.count() == 6


def test_stream_reads_each_file_once(spark, tmp_path):
    messages.register(spark)
    root = tmp_path / "in"
    args = (str(root), str(tmp_path / "out"), str(tmp_path / "ck"), "", lambda m: m.groupBy("bag").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")), messages.NAME)
    put(root, "b1", "z.parquet", [("arm", 1, 0), ("arm", 2, 1)])
    incremental_ingest(spark, *args)
    put(root, "b0", "a.parquet", [("arm", 1, 7)] * 3)
    put(root, "b1", "a.parquet", [("arm", 1, 9)])
    incremental_ingest(spark, *args)
    incremental_ingest(spark, *args)
    got = sorted((r.bag, r.n, r.last, r.episode_index) for r in spark.read.parquet(args[1]).collect())
    assert got == [("b0", 3, 7, 1), ("b1", 1, 9, 0), ("b1", 2, 1, 0)]


def test_shared_files_tell_the_bag(spark, tmp_path):
    """Files in the root hold many bags; both limits hold for them, and a file there without the column is none of ours."""
    (tmp_path / "one").mkdir()
    rows = [("arm", 1, 0, "two"), ("cam", 2, 1, "two"), ("arm", 1, 2, "two"), ("cam", 2, 3, "two"), ("arm", 3, 4, "three"), ("cam", 4, 5, "three"), (None, 5, 6, "one")]
    t = pa.table({k: list(v) for k, v in zip(("topic", "ts_ns", "seq", "bag"), zip(*rows))})
    pq.write_table(t[:2], tmp_path / "one" / "a.parquet")
    pq.write_table(t[2:], tmp_path / "shared.parquet", row_group_size=2)
    pq.write_table(t.drop_columns("bag"), tmp_path / "other.parquet")
    read = lambda *a: sorted((r.bag, r.seq) for r in messages.read_messages(spark, str(tmp_path), *a).collect())
    assert read() == [("one", 0), ("one", 1), ("one", 6), ("three", 4), ("three", 5), ("two", 2), ("two", 3)]
    assert read(["cam"]) == [("one", 1), ("three", 5), ("two", 3)]
    assert read(["cam"], ["one", "two"]) == [("one", 1), ("two", 3)]
    assert read(None, ["three"]) == [("three", 4), ("three", 5)] and read(None, ["x"]) == []
    assert [(p.bag, p.group) for p in messages.Reader(str(tmp_path), None, {"three"}).partitions()] == [(None, 1)]


def test_many_small_files_share_partitions(spark, tmp_path):
    """A task for each of ten thousands of short bags costs more than its messages."""
    for k in range(500):
        put(tmp_path, f"b{k}", "a.parquet", [("arm", 1, k)])
    df = messages.read_messages(spark, str(tmp_path))
    assert messages.FEW <= df.rdd.getNumPartitions() <= 2 * messages.FEW
    assert sorted((r.bag, r.seq) for r in df.collect()) == sorted((f"b{k}", k) for k in range(500))


def test_recorded_messages_are_in_few_files(spark):
    """The query's own copy: a folder for each bag took longer than all of its messages."""
    import __spark_entry__ as entry

    for name in ("messages_source_events", "source_to_frames_events"):
        before = _bag_files(spark)
        assert entry.queries()[name](spark, "/root/testdata/sf0.01").count()
        assert 0 < len(_bag_files(spark) - before) <= 64


def _bag_files(spark):
    from pathlib import Path

    from trajspark.session import shared_dir

    return {str(p) for p in Path(shared_dir(spark).removeprefix("file:")).glob("trajspark/bags-*/**/*.parquet")}
