"""Packing of episodes into files, slices of shared files, and the plans of layout conversion."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trajspark.operators.axes import EPISODE

CHUNK_SIZE, DATA_LIMIT, VIDEO_LIMIT = 1000, 100 * 1024 * 1024, 500 * 1024 * 1024
#: Rows of a file whose episodes are looked up together.
BLOCK = 256


def _fold(batches: Iterator[pa.RecordBatch], n_keys: int, limit: float) -> Iterator[pa.RecordBatch]:
    """Files of episodes that come by key and in order; only the open file's state is kept."""
    last, file, used, rows, n = None, 0, 0.0, 0, 0
    for b in batches:
        keys = list(zip(*(b.column(k).to_pylist() for k in range(n_keys))))
        files, low, high = [], [], []
        for key, size, length in zip(keys, b.column(n_keys + 1).to_pylist(), b.column(n_keys + 2).to_pylist()):
            if key != last:
                last, file, used, rows, n = key, 0, 0.0, 0, 0
            if n and used + size >= limit:
                file, used, rows, n = file + 1, 0.0, 0, 0
            files.append(file)
            low.append(rows)
            used, rows, n = used + size, rows + length, n + 1
            high.append(rows)
        yield pa.RecordBatch.from_arrays([*b.columns[: n_keys + 2], *[pa.array(x, pa.int64()) for x in (files, low, high)]], [*b.schema.names[: n_keys + 2], "file", "from_index", "to_index"])


def pack_files(sizes: DataFrame, limit: float, chunk_size: int = CHUNK_SIZE, keys: tuple[str, ...] = ("dataset_id",), by: str = "bytes") -> DataFrame:
    """File of each episode in order: a new file begins where the size would reach the limit and the file has anything
    in it; file numbers start anew after ``chunk_size`` in the next chunk. Rows from and to in the file by ``length``.
    Each dataset's episodes, some numbers each, pass a fold in order; nothing is gathered. W15."""
    s = sizes.select(*keys, F.col("episode_index").cast("long"), F.coalesce(F.col(by).cast("double"), F.lit(0.0)).alias(by), F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("__length"))
    s = s.repartition(*keys).sortWithinPartitions(*keys, "episode_index", by, "__length")
    schema = StructType([*s.schema.fields[:-1], *[StructField(c, LongType()) for c in ("file", "from_index", "to_index")]])
    packed = s.mapInArrow(lambda b: _fold(b, len(keys), limit), schema)
    chunk, file = F.floor(F.col("file") / chunk_size), F.col("file") % chunk_size
    return packed.select(*keys, "episode_index", chunk.cast("long").alias("chunk"), file.cast("long").alias("file"), by, "from_index", "to_index")


def video_offsets(videos: DataFrame, limit: float = VIDEO_LIMIT, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """File of each video by camera, and its seconds within the merged file. W16."""
    keys = ["dataset_id", "camera"]
    packed = pack_files(videos.withColumn("length", F.lit(1)), limit, chunk_size, tuple(keys)).drop("from_index", "to_index", "bytes")
    v = packed.join(videos.select(*keys, "episode_index", "duration"), [*keys, "episode_index"])
    w = Window.partitionBy(*keys, "chunk", "file").orderBy("episode_index")
    until = F.sum("duration").over(w)
    return v.select(*keys, "episode_index", "chunk", "file", (until - F.col("duration")).alias("from_timestamp"), until.alias("to_timestamp"))


def slice_by_row_range(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Rows of shared files with their episode: ``rows`` (dataset_id, chunk, file, row, ...), ``episodes`` (dataset_id,
    episode_index, chunk, file, from_index, to_index); positions are relative to the least from_index of a file. Ranges
    are cut at every BLOCK rows, so a row meets the episodes of its own block only, not all of its file. J13."""
    base = F.min("from_index").over(Window.partitionBy("dataset_id", "chunk", "file"))
    e = episodes.withColumn("__low", F.col("from_index") - base).withColumn("__high", F.col("to_index") - base).where("__low < __high")
    blocks = F.sequence(F.floor(F.col("__low") / BLOCK), F.floor((F.col("__high") - 1) / BLOCK))
    e = e.select("dataset_id", "chunk", "file", "episode_index", "__low", "__high", F.explode(blocks).alias("__block"))
    j = rows.withColumn("__block", F.floor(F.col("row") / BLOCK)).join(e, ["dataset_id", "chunk", "file", "__block"]).where("row >= __low and row < __high")
    return j.withColumn("pos", F.col("row") - F.col("__low")).drop("__low", "__high", "__block")


def legacy_episode_rows(packed: DataFrame, episodes: DataFrame, tasks: DataFrame, flat_stats: DataFrame | None = None) -> DataFrame:
    """Episode table of the shared-file layout: place, length, tasks, first task's number, and statistics by name. J14."""
    first = F.get("tasks", F.lit(0))
    e = packed.join(episodes.select(*EPISODE, "tasks"), EPISODE, "left").withColumn("__first", first)
    t = tasks.select("dataset_id", F.col("task").alias("__first"), "task_index")
    e = e.join(t, ["dataset_id", "__first"], "left").drop("__first").withColumn("length", F.col("to_index") - F.col("from_index"))
    if flat_stats is not None:
        values = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("/", "name", F.col("axis_index").cast("string")), "value"))))
        e = e.join(flat_stats.groupBy(*EPISODE).agg(values.alias("stats")), EPISODE, "left")
    return e


def to_shared_layout(frames: DataFrame, sizes: DataFrame, limit: float = DATA_LIMIT, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Frames with the chunk, the file and the row that they go to; other columns, the index too, as they are. L2."""
    p = pack_files(sizes, limit, chunk_size)
    return frames.join(p.select(*EPISODE, "chunk", "file", "from_index"), EPISODE).withColumn("row", F.col("from_index") + F.col("pos")).drop("from_index")


def from_shared_layout(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Inverse of ``to_shared_layout``. L3."""
    return slice_by_row_range(rows.drop("episode_index", "pos"), episodes).drop("chunk", "file", "row")


def episode_path(episode: Column, chunk_size: int = CHUNK_SIZE) -> Column:
    """F18."""
    return F.format_string("data/chunk-%03d/episode_%06d.parquet", F.floor(episode / chunk_size).cast("int"), episode.cast("long"))


def update_video_codec(features: DataFrame, codec: str, pix_fmt: str) -> DataFrame:
    """Codec and pixel format of image and video features, and whether they changed. C9."""
    video = F.col("dtype").isin("video", "image")
    changed = video & ~(F.col("codec").eqNullSafe(codec) & F.col("pix_fmt").eqNullSafe(pix_fmt))
    return features.withColumn("changed", changed).withColumn("codec", F.when(video, codec).otherwise(F.col("codec"))).withColumn("pix_fmt", F.when(video, pix_fmt).otherwise(F.col("pix_fmt")))


#: Other names of codecs. Fixed values.
CODEC_NAMES = {"avc1": "h264", "avc": "h264", "libx264": "h264", "hvc1": "hevc", "h265": "hevc", "libx265": "hevc", "av01": "av1", "libsvtav1": "av1", "libaom-av1": "av1"}


def normalize_codec(codec: Column) -> Column:
    names = F.create_map(*[F.lit(x) for p in CODEC_NAMES.items() for x in p])
    low = F.lower(F.trim(codec))
    return F.coalesce(F.try_element_at(names, low), low)


def transcode_candidates(videos: DataFrame, target: str) -> DataFrame:
    """Probed videos of another codec. P22."""
    return videos.where(F.col("codec").isNotNull() & (normalize_codec(F.col("codec")) != target))


def codec_summary(videos: DataFrame) -> DataFrame:
    """Videos, megabytes, files of each codec (unknown where not probed), whether several are in use, and the video keys.
    A20."""
    v = videos.withColumn("codec", F.coalesce(normalize_codec(F.col("codec")), F.lit("unknown")))
    one = v.groupBy("dataset_id", "codec").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.collect_set("video_key").alias("keys"))
    return one.groupBy("dataset_id").agg(
        F.sum("n").alias("n_videos"), F.round(F.sum("bytes") / 1e6, 1).alias("total_mb"), (F.count(F.lit(1)) > 1).alias("mixed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("codec", "n")))).alias("codecs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("video_keys"),
    )


def video_feature_key(videos: DataFrame, features: DataFrame) -> DataFrame:
    """Feature of each camera: the first that ends with its name, else observation.images.<camera>. P23."""
    c = videos.select("dataset_id", "camera").distinct()
    f = features.select(F.col("dataset_id").alias("__d"), "feature", "position")
    j = c.join(f, (c["dataset_id"] == f["__d"]) & F.endswith("feature", "camera"), "left")
    return j.groupBy("dataset_id", "camera").agg(F.coalesce(F.min_by("feature", "position"), F.concat(F.lit("observation.images."), F.first("camera"))).alias("feature"))


def listing_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of two roots by path: left only, right only, same or another size. S21."""
    j = left.select("rel_path", F.col("bytes").alias("a")).join(right.select("rel_path", F.col("bytes").alias("b")), "rel_path", "full_outer")
    kind = F.when(F.col("b").isNull(), "left only").when(F.col("a").isNull(), "right only").when(F.col("a") == F.col("b"), "same").otherwise("size differs")
    return j.select("rel_path", kind.alias("kind"))
