"""Dataset folders written from DataFrames: tasks write the files, row batch by row batch; the driver sees paths and counts
only.

Files go through Arrow's filesystems (local, hdfs, s3 and so on by the root's scheme) under a name of their own first, then
take their place, so a task that runs again leaves the same file. A file is one task's, but no task holds a whole file.
``write_dataset`` and ``write_shared_dataset`` write at once; what they return is the list of files, itself a table in the
shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.operators.axes import EPISODE, explode_axes
from trajspark.operators.layouts import CHUNK_SIZE, DATA_LIMIT, episode_path, from_shared_layout, pack_files, to_shared_layout
from trajspark.operators.stats import QUANTILES, episode_lengths, episode_stats, merge_stats, scalar_axes
from trajspark.session import materialize
from trajspark.sources.readers import file_listing

#: Versions and path patterns of the layouts. Fixed values.
V20, V21, V30 = "v2.0", "v2.1", "v3.0"
DATA_PATH = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
SHARED_PATH = "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"
STORED = {"state": "observation.state"}
STATISTICS = ("min", "max", "mean", "std", *QUANTILES)
#: Columns of one number that have statistics too. Fixed values.
SCALARS = ("timestamp", "frame_index", "episode_index", "index", "task_index")
#: Rows that a task gathers before it writes them.
ROW_GROUP = 50_000


def _files(root: str):
    """(filesystem, folder) of a root."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class _Part:
    """A file that takes its place when it is whole."""

    def __init__(self, root: str, path: str):
        self.files, base = _files(root)
        self.path, self.target, self.n = path, f"{base.rstrip('/')}/{path}", 0
        self.files.create_dir(self.target.rpartition("/")[0], recursive=True)
        self.part = f"{self.target}.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.part)

    def done(self) -> tuple[str, int, int]:
        self.out.close()
        self.files.move(self.part, self.target)
        return self.path, self.n, self.files.get_file_info(self.target).size


def _place(root: str, path: str, write) -> int:
    """``write`` to a file that takes its place when whole; its size."""
    part = _Part(root, path)
    write(part.out)
    return part.done()[2]


_WRITTEN = "path string, n_rows long, bytes long"


def _told(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_rows", "bytes"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Runs of rows of one path, the first column, without that column."""
    for b in batches:
        paths = b.column(0).to_pylist()
        cuts = [i for i in range(len(paths)) if not i or paths[i] != paths[i - 1]]
        for at, to in zip(cuts, [*cuts[1:], len(paths)]):
            yield paths[at], b.slice(at, to - at).select(b.schema.names[1:])


def stored_name(column: str) -> str:
    """Name in files of a column, or of the feature in a column stats/<feature>/<metric>. Names with dots only exist in
    files, as Spark's Python steps can't take such columns."""
    parts = column.split("/")
    return "/".join([parts[0], STORED.get(parts[1], parts[1]), *parts[2:]]) if parts[0] == "stats" and len(parts) > 2 else STORED.get(column, column)


def _dealt(rows: DataFrame, path: Column, order: list[str]) -> DataFrame:
    return rows.select(path.alias("__path"), *[F.col(f"`{c}`") for c in rows.columns]).repartition("__path").sortWithinPartitions("__path", *[f"`{c}`" for c in order])


def write_tables(rows: DataFrame, root: str, path: Column, order: list[str]) -> DataFrame:
    """A Parquet file for each value of ``path``, its rows in ``order``: (path, n_rows, bytes) of all. A column ``__p`` is
    not stored."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        part = writer = None
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            if held:
                writer.write_table(pa.Table.from_batches(held))
                held.clear()

        def close() -> pa.RecordBatch:
            flush()
            writer.close()
            return _told([part.done()])

        for name, b in _runs(batches):
            b = b.select([c for c in b.schema.names if c != "__p"])
            b = b.rename_columns([stored_name(c) for c in b.schema.names])
            if part is None or part.path != name:
                if part is not None:
                    yield close()
                part = _Part(root, name)
                writer = pq.ParquetWriter(part.out, b.schema)
            held.append(b)
            part.n += b.num_rows
            if sum(x.num_rows for x in held) >= ROW_GROUP:
                flush()
        if part is not None:
            yield close()

    return _dealt(rows, path, order).mapInArrow(save, _WRITTEN)


def write_lines(lines: DataFrame, root: str) -> DataFrame:
    """Files of ``lines`` (path, at, line) in the order of ``at``, UTF-8, a line each."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for name, b in _runs(batches):
            if part is None or part.path != name:
                if part is not None:
                    yield _told([part.done()])
                part = _Part(root, name)
            part.out.write("".join(f"{x}\n" for x in b.column(1).to_pylist()).encode())
            part.n += b.num_rows
        if part is not None:
            yield _told([part.done()])

    return _dealt(lines.select("at", "line", "path"), F.col("path"), ["at"]).drop("path").mapInArrow(save, _WRITTEN)


def write_texts(texts: DataFrame, root: str) -> DataFrame:
    """Files of ``texts`` (path, text), UTF-8. S19."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, sizes = b.column(0).to_pylist(), []
            for path, text in zip(paths, b.column(1).to_pylist()):
                sizes.append(_place(root, path, lambda out, text=text: out.write(text.encode())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([1] * len(paths), pa.int64()), pa.array(sizes, pa.int64())], ["path", "n_rows", "bytes"])

    return texts.select("path", "text").mapInArrow(save, _WRITTEN)


def jsonl(rows: DataFrame, name: str, order: str) -> DataFrame:
    """(path, at, line): the lines of each dataset's file ``name``, a line for each row without dataset_id. S19."""
    line = F.to_json(F.struct(*[c for c in rows.columns if c != "dataset_id"]))
    return rows.select(F.concat("dataset_id", F.lit(f"/{name}")).alias("path"), F.col(order).cast("long").alias("at"), line.alias("line"))


def write_tasks_table(tasks: DataFrame, root: str) -> DataFrame:
    """meta/tasks.parquet of each dataset with the task's text as the index that trainers read. S20."""

    def save(table: pa.Table) -> pa.Table:
        import pyarrow.parquet as pq

        name = table.column("dataset_id")[0].as_py() + "/meta/tasks.parquet"
        frame = table.select(["task_index", "task"]).to_pandas().sort_values("task_index").set_index("task")
        size = _place(root, name, lambda out: pq.write_table(pa.Table.from_pandas(frame), out))
        return pa.table({"path": [name], "n_rows": pa.array([len(frame)], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return tasks.select("dataset_id", F.col("task_index").cast("long"), "task").groupBy("dataset_id").applyInArrow(save, _WRITTEN)


def _vectors(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics by axis as a JSON object of features, each with its vectors."""
    field = lambda c: lambda s: s[c]
    values = [F.transform(F.array_sort(F.collect_list(F.struct("axis_index", c))), field(c)).alias(c) for c in STATISTICS]
    s = stats.groupBy(*keys, "source").agg(*values, F.array(F.max("n")).alias("count"))
    name = F.when(F.col("source") == "state", STORED["state"]).otherwise(F.col("source"))
    entry = F.struct(name.alias("name"), F.to_json(F.struct(*STATISTICS, "count")).alias("json"))
    parts = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(F.lit('"'), e["name"], F.lit('":'), e["json"]))
    return s.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("stats"))


def episode_statistics_columns(by_episode: DataFrame, sources: list[str]) -> DataFrame:
    """Row of each episode with a vector column stats/<feature>/<metric> for every metric of every source. L2."""
    field = lambda c: lambda s: s[c]
    s = by_episode.withColumn("count", F.col("n").cast("double"))
    metrics = (*STATISTICS, "count")
    s = s.groupBy(*EPISODE, "source").agg(F.array_sort(F.collect_list(F.struct("axis_index", *metrics))).alias("rows"))
    s = s.select(*EPISODE, "source", F.struct(*[F.transform("rows", field(c)).alias(c) for c in metrics]).alias("m"))
    wide = s.groupBy(*EPISODE).agg(*[F.first(F.when(F.col("source") == x, F.col("m")), ignorenulls=True).alias(f"__{x}") for x in sources])
    return wide.select(*EPISODE, *[F.col(f"__{x}.{c}").alias(f"stats/{x}/{c}") for x in sources for c in metrics])


def joint_configs(joints: DataFrame) -> DataFrame:
    """(path, text) of each dataset's joint_config.json; ``joints``: dataset_id, axis_index, axis_name. S18."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("axis_index", "axis_name"))), lambda s: s["axis_name"])
    j = joints.groupBy("dataset_id").agg(names.alias("joint_names"))
    return j.select(F.concat("dataset_id", F.lit("/meta/joint_config.json")).alias("path"), F.to_json(F.struct("joint_names")).alias("text"))


def stored(frames: DataFrame) -> DataFrame:
    """Frames with the columns of data files."""
    extra = [F.col("pos").alias("frame_index")] if "frame_index" not in frames.columns else []
    return frames.select(*[c for c in frames.columns if c not in ("dataset_id", "pos")], *extra)


def infos(frames: DataFrame, tasks: DataFrame, version: str, fps: float, robot: str | None, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """(path, text) of each dataset's info.json: totals, splits and features. S18, C13."""
    n_tasks = tasks.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total_tasks"))
    wide = {c: kind.startswith("array") for c, kind in frames.dtypes}
    f = frames.groupBy("dataset_id").agg(F.count_distinct("episode_index").alias("total_episodes"), F.count(F.lit(1)).alias("total_frames"), *[F.max(F.size(c)).alias(f"__{c}") for c in wide if wide[c]])
    f = f.join(n_tasks, "dataset_id", "left").na.fill(0, ["total_tasks"])
    kinds = {"double": "float64", "float": "float32", "bigint": "int64", "int": "int32", "boolean": "bool", "string": "string"}
    features = []
    for c, kind in frames.dtypes:
        if c in ("dataset_id", "pos"):
            continue
        name, shape = STORED.get(c, c), F.array(F.col(f"__{c}") if wide[c] else F.lit(1))
        base = kind.removeprefix("array<").removesuffix(">")
        features += [F.lit(name), F.struct(F.lit(kinds.get(base, base)).alias("dtype"), shape.alias("shape"))]
    shared = version == V30
    fields = [
        F.lit(version).alias("codebase_version"), F.lit(robot).alias("robot_type"), "total_episodes", "total_frames", "total_tasks", F.lit(chunk_size).alias("chunks_size"),
        *([] if shared else [F.ceil(F.col("total_episodes") / chunk_size).alias("total_chunks")]), F.lit(fps).alias("fps"),
        F.struct(F.concat(F.lit("0:"), F.col("total_episodes").cast("string")).alias("train")).alias("splits"),
        F.lit(SHARED_PATH if shared else DATA_PATH).alias("data_path"), F.create_map(*features).alias("features"),
    ]
    return f.select(F.concat("dataset_id", F.lit("/meta/info.json")).alias("path"), F.to_json(F.struct(*fields)).alias("text"))


def _sources(frames: DataFrame) -> tuple[list[str], list[str]]:
    """Vectors and numbers that have statistics."""
    return [c for c in ("state", "action") if c in frames.columns], [c for c in SCALARS if c in frames.columns]


def statistics(frames: DataFrame) -> DataFrame:
    """Statistics of each episode's vectors and numbers."""
    vectors, scalars = _sources(frames)
    parts = [explode_axes(frames, c).select(*EPISODE, "source", "pos", "axis_index", "value") for c in vectors]
    parts += [scalar_axes(frames, scalars)] if scalars else []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return episode_stats(out)


def remove_stale(written: DataFrame, root: str) -> DataFrame:
    """Delete the data files of the written datasets that are not among the written files: (path) of them."""
    spark = written.sparkSession
    names = written.select(F.split("path", "/")[0].alias("dataset_id")).distinct()
    have = file_listing(spark, [root]).where("subdir = 'data'").join(names, "dataset_id", "left_semi").select(F.concat("dataset_id", F.lit("/"), "rel_path").alias("path"))

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(root)
        for b in batches:
            for path in b.column(0).to_pylist():
                target = f"{base.rstrip('/')}/{path}"
                if files.get_file_info(target).is_file:
                    files.delete_file(target)
            yield b

    return materialize(have.join(written, "path", "left_anti").mapInArrow(delete, "path string"), "stale")


def write_dataset(frames: DataFrame, episodes: DataFrame, tasks: DataFrame, root: str, version: str = V21, fps: float = 30.0, robot: str | None = None, chunk_size: int = CHUNK_SIZE, joints: DataFrame | None = None) -> DataFrame:
    """All datasets of ``frames`` as folders below ``root``: a file for each episode, info, episodes, tasks and statistics (of
    episodes and of the whole; v2.0 has the latter only). ``episodes``: dataset_id, episode_index, tasks; ``tasks``:
    dataset_id, task_index, task; ``joints`` (dataset_id, axis_index, axis_name), where given, go to joint_config.json. Data
    files of an earlier version go. Returns (path, n_rows, bytes). S17, S18, L1."""
    frames = frames if "frame_index" in frames.columns else frames.withColumn("frame_index", F.col("pos"))
    path = F.concat("dataset_id", F.lit("/"), episode_path(F.col("episode_index"), chunk_size))
    written = write_tables(stored(frames.withColumn("__p", path)), root, F.col("__p"), ["frame_index"])
    by_episode = materialize(statistics(frames), "episode-statistics")
    listed = episode_lengths(frames).join(episodes.select(*EPISODE, "tasks"), EPISODE, "left").select("dataset_id", "episode_index", "tasks", "length")
    lines = jsonl(listed, "meta/episodes.jsonl", "episode_index").union(jsonl(tasks.select("dataset_id", "task_index", "task"), "meta/tasks.jsonl", "task_index"))
    if version != V20:
        line = F.concat(F.lit('{"episode_index":'), F.col("episode_index").cast("string"), F.lit(',"stats":'), "stats", F.lit("}"))
        lines = lines.union(_vectors(by_episode, EPISODE).select(F.concat("dataset_id", F.lit("/meta/episodes_stats.jsonl")), "episode_index", line))
    whole = _vectors(merge_stats(by_episode), ["dataset_id"])
    texts = infos(frames, tasks, version, fps, robot, chunk_size).union(whole.select(F.concat("dataset_id", F.lit("/meta/stats.json")), "stats"))
    if joints is not None:
        texts = texts.union(joint_configs(joints))
    out = materialize(written.union(write_lines(lines, root)).union(write_texts(texts, root)), "written")
    remove_stale(out, root)
    return out


def write_shared_dataset(frames: DataFrame, episodes: DataFrame, tasks: DataFrame, root: str, fps: float = 30.0, robot: str | None = None, limit: float = DATA_LIMIT, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """All datasets of ``frames`` in the layout of shared files: files of many episodes, the table of episodes with the place
    and the statistics of each, tasks with their text as index, statistics and info. Sizes are taken at eight bytes a number. L2."""
    width = sum((F.size(c) if kind.startswith("array") else F.lit(1)) for c, kind in frames.dtypes if kind not in ("string",))
    sizes = frames.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("length"), (8 * F.sum(width)).alias("bytes"))
    placed = to_shared_layout(frames, sizes, limit, chunk_size)
    path = F.format_string("%s/data/chunk-%03d/file-%03d.parquet", "dataset_id", "chunk", "file")
    data = placed.withColumn("__p", path)
    written = write_tables(stored(data).drop("chunk", "file"), root, F.col("__p"), ["row"])
    table = pack_files(sizes, limit, chunk_size).join(episodes.select(*EPISODE, "tasks"), EPISODE, "left")
    table = table.select(
        "dataset_id", "episode_index", "tasks", (F.col("to_index") - F.col("from_index")).alias("length"), F.col("chunk").alias("data/chunk_index"), F.col("file").alias("data/file_index"),
        F.col("from_index").alias("dataset_from_index"), F.col("to_index").alias("dataset_to_index"),
    )
    frames = frames if "frame_index" in frames.columns else frames.withColumn("frame_index", F.col("pos"))
    by_episode = materialize(statistics(frames), "episode-statistics")
    table = table.join(episode_statistics_columns(by_episode, sum(_sources(frames), [])), EPISODE, "left")
    listed = write_tables(table.withColumn("__p", F.concat("dataset_id", F.lit("/meta/episodes/chunk-000/file-000.parquet"))).drop("dataset_id"), root, F.col("__p"), ["episode_index"])
    texts = infos(frames, tasks, V30, fps, robot, chunk_size)
    texts = texts.union(_vectors(merge_stats(by_episode), ["dataset_id"]).select(F.concat("dataset_id", F.lit("/meta/stats.json")), "stats"))
    out = materialize(written.union(listed).union(write_tasks_table(tasks, root)).union(write_texts(texts, root)), "written")
    remove_stale(out, root)
    return out


def read_shared_dataset(spark, roots: list[str]) -> DataFrame:
    """Frames of datasets in the layout of shared files, back with their episodes and positions. L3."""
    path = F.col("_metadata.file_path")
    everything = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "file-*.parquet")
    at = lambda part, n: F.regexp_extract(path, rf"{part}-(\d+)", 1).cast("long").alias(n)
    data = everything.parquet(*[f"{r.rstrip('/')}/data" for r in roots])
    rows = data.select(*[F.col(f"`{c}`").alias(c.removeprefix("observation.")) for c in data.columns], F.regexp_extract(path, r"([^/]+)/data/", 1).alias("dataset_id"), at("chunk", "chunk"), at("file", "file"))
    listed = everything.parquet(*[f"{r.rstrip('/')}/meta/episodes" for r in roots])
    e = listed.select(
        F.regexp_extract(path, r"([^/]+)/meta/", 1).alias("dataset_id"), "episode_index", F.col("`data/chunk_index`").alias("chunk"), F.col("`data/file_index`").alias("file"),
        F.col("dataset_from_index").alias("from_index"), F.col("dataset_to_index").alias("to_index"),
    )
    return from_shared_layout(rows, e)
