"""Footers of Parquet files as a table, and scans and checks that rest on them.

A footer is opened in a task, through Arrow's filesystem for the path's scheme, and nothing else of the file is read. Where
Arrow does not know the scheme, Spark reads the file and the footer is taken from its bytes. Spark's listings leave out
files of no bytes: they show as episodes that are missing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from trajspark.operators.axes import materialize_vector
from trajspark.operators.quality import check
from trajspark.sources.readers import dataset_of

FOOTERS = "path string, bytes long, n_rows long, columns array<struct<name: string, type: string>>, pandas string, error string"
#: Schemes that Arrow's filesystems open.
SCHEMES = "^(file|hdfs|s3|s3a|gs|gcs|abfs|abfss):"
#: Types that take each other's values.
WIDER = {("int", "bigint"): "bigint", ("float", "double"): "double", ("array<float>", "array<double>"): "array<double>", ("array<int>", "array<bigint>"): "array<bigint>"}


def _footer(source) -> tuple:
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    f = pq.ParquetFile(source)
    fields = [{"name": x.name, "type": x.dataType.simpleString()} for x in from_arrow_schema(f.schema_arrow)]
    pandas = (f.schema_arrow.metadata or {}).get(b"pandas")
    return f.metadata.num_rows, fields, pandas.decode() if pandas else None, None


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    column = pa.struct([("name", pa.string()), ("type", pa.string())])
    kinds = {"bytes": pa.int64(), "n_rows": pa.int64(), "columns": pa.list_(column)}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in ("path", "bytes", "n_rows", "columns", "pandas", "error")])
    for b in batches:
        rows = []
        for row in b.to_pylist():
            try:
                if "content" in row:
                    found = _footer(pa.BufferReader(row["content"]))
                else:
                    files, name = fs.FileSystem.from_uri(row["path"].replace("s3a://", "s3://", 1))
                    with files.open_input_file(name) as source:
                        found = _footer(source)
            except Exception as e:  # noqa: BLE001  whatever is wrong with a file is its row's error
                found = (None, None, None, f"{type(e).__name__}: {e}"[:300])
            rows.append({"path": row["path"], "bytes": row["length"]} | dict(zip(("n_rows", "columns", "pandas", "error"), found)))
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_footers(spark: SparkSession, roots: list[str], pattern: str = "episode_*.parquet") -> DataFrame:
    """(path, bytes, n_rows, columns, pandas, error) of every file below the roots whose name fits the pattern. ``pandas``
    is the writer's entry on its index; a file without a readable footer has its error only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(roots)
    known = files.where(F.col("path").rlike(SCHEMES)).select("path", "length")
    other = files.where(~F.col("path").rlike(SCHEMES)).select("path", "length", "content")
    return known.mapInArrow(_footers, FOOTERS).union(other.mapInArrow(_footers, FOOTERS))


def merged_schema(footers: DataFrame) -> StructType:
    """Columns of all files; of a column's types the wider one where they agree, else the one of most files. As many rows
    reach the driver as there are different columns."""
    c = footers.where("error IS NULL").select(F.explode("columns").alias("c")).groupBy("c.name", "c.type").count().orderBy(F.desc("count"), "type").collect()
    kinds: dict[str, str] = {}
    for r in c:
        have = kinds.setdefault(r.name, r.type)
        kinds[r.name] = WIDER.get((have, r.type)) or WIDER.get((r.type, have)) or have
    return StructType([StructField(n, StructType.fromDDL(f"c {kinds[n]}")["c"].dataType) for n in sorted(kinds)])


def misfits(footers: DataFrame, schema: StructType) -> DataFrame:
    """(path, error) of the files that can't be scanned: no readable footer, or a column of a type that doesn't fit."""
    kinds = {x.name: x.dataType.simpleString() for x in schema}
    takes = [(x, x) for x in set(kinds.values())] + [(x, wide) for pair, wide in WIDER.items() for x in pair]
    fits = F.array(*[F.lit(f"{have}>{want}") for have, want in takes])
    wanted = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]) if kinds else F.create_map().cast("map<string, string>")
    odd = F.filter("columns", lambda c: ~F.array_contains(fits, F.concat(c["type"], F.lit(">"), F.element_at(wanted, c["name"]))))
    text = F.array_join(F.transform(odd, lambda c: F.concat(F.lit("column "), c["name"], F.lit(" is "), c["type"], F.lit(", not "), F.element_at(wanted, c["name"]))), "; ")
    return footers.select("path", F.coalesce("error", F.nullif(text, F.lit(""))).alias("error")).where("error IS NOT NULL")


def scan_frames_tolerant(spark: SparkSession, roots: list[str], footers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, quarantine): the frames of all readable episode files, as ``readers.scan_frames`` gives them, in one scan
    with the merged schema of their footers, and (dataset_id, path, error) of the files that are left out. A file whose
    pages are damaged behind a sound footer loses rows: ``lost_rows`` finds it. S2."""
    footers = read_footers(spark, roots) if footers is None else footers
    schema = merged_schema(footers)
    bad = misfits(footers, schema).select(dataset_of(F.col("path"), "data").alias("dataset_id"), episode_of(F.col("path")).alias("episode_index"), "path", "error")
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "episode_*.parquet").option("ignoreCorruptFiles", True).schema(schema).parquet(*roots)
    path = F.col("_metadata.file_path")
    names = {c: c.removeprefix("observation.") for c in df.columns}
    df = df.select(
        *[F.col(f"`{c}`").alias(names[c]) for c in df.columns if c != "episode_index"], F.col("_metadata.row_index").alias("pos"),
        episode_of(path).alias("episode_index"), dataset_of(path, "data").alias("dataset_id"),
    )
    # whether a file with an odd column can be read depends on the columns asked for, so it is left out in any case
    df = df.join(bad.select("dataset_id", "episode_index"), ["dataset_id", "episode_index"], "left_anti")
    for key in ("state", "action"):
        df = materialize_vector(df, key)
    return df, bad.drop("episode_index")


def episode_of(path: Column) -> Column:
    return F.regexp_extract(path, r"episode_(\d+)\.parquet", 1).cast("long")


def lost_rows(frames: DataFrame, footers: DataFrame, quarantine: DataFrame) -> DataFrame:
    """(dataset_id, path, error) of the files outside the quarantine of which fewer rows were read than the footer says.
    All columns are read for it."""
    read = frames.groupBy("dataset_id", "episode_index").agg(F.count_if(F.xxhash64(*frames.columns) >= -(1 << 63)).alias("n"))
    told = footers.join(quarantine.select("path"), "path", "left_anti")
    told = told.select(dataset_of(F.col("path"), "data").alias("dataset_id"), episode_of(F.col("path")).alias("episode_index"), "path", "n_rows")
    short = told.join(read, ["dataset_id", "episode_index"], "left").where(F.coalesce("n", F.lit(0)) < F.col("n_rows"))
    return short.select("dataset_id", "path", F.format_string("%d of %d rows read", F.coalesce("n", F.lit(0)), "n_rows").alias("error"))


def load_checks(quarantine: DataFrame, datasets: DataFrame, examples: int = 5) -> DataFrame:
    """An error for each dataset with files that can't be read, the first of them as examples. K4."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    first = F.array_join(F.slice(F.array_sort(F.collect_list(F.concat(name, F.lit(": "), "error"))), 1, examples), "; ")
    bad = quarantine.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), first.alias("examples"))
    d = datasets.select("dataset_id").join(bad, "dataset_id", "left")
    return check(d, "load.dataset", F.col("n").isNotNull(), F.format_string("%d files: %s", "n", "examples"))


def presence_checks(footers: DataFrame, features: DataFrame, datasets: DataFrame, required: tuple[str, ...] = ("observation.state", "action")) -> DataFrame:
    """Each required feature is declared and in every readable episode file, whole or as one column an axis. ``features``:
    dataset_id, feature. K7."""
    out = None
    for name in required:
        split = rf"^{name.replace('.', '[.]')}([._]\d+)$"
        has = F.exists("columns", lambda c: (c["name"] == name) | c["name"].rlike(split))  # noqa: B023
        n = footers.where("error IS NULL").groupBy(dataset_of(F.col("path"), "data").alias("dataset_id")).agg(F.count_if(has).alias("have"), F.count(F.lit(1)).alias("files"))
        declared = features.where(F.col("feature") == name).select("dataset_id", F.lit(True).alias("declared")).distinct()
        d = datasets.select("dataset_id").join(n, "dataset_id", "left").join(declared, "dataset_id", "left")
        d = d.select("dataset_id", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("files", F.lit(0)).alias("files"))
        said = F.format_string("declared: %s, in %d of %d files", F.col("declared").cast("string"), "have", "files")
        one = check(d, f"feature.{name}.presence", ~(F.col("declared") & (F.col("have") == F.col("files"))), said)
        out = one if out is None else out.union(one)
    return out


def task_index_checks(spark: SparkSession, roots: list[str], language: bool = False) -> DataFrame:
    """How meta/tasks.parquet holds the tasks' text, by its footer: as the index (pass), as a column beside a plain number
    (fixable; an error for models that read language), or not at all (an error). A file without readable footer gives
    task.tasks_parquet_read. Datasets without the file give no row. K18."""
    f = read_footers(spark, roots, "tasks.parquet").withColumn("dataset_id", dataset_of(F.col("path"), "meta"))
    index = F.from_json(F.get_json_object("pandas", "$.index_columns"), "array<string>")
    # an index that is stored has its column's name here, one that is a range an object
    named = F.exists(index, lambda x: ~F.startswith(F.trim(x), F.lit("{")))
    whole = F.exists("columns", lambda c: (c["name"] == F.get(index, F.lit(0))) & c["type"].isin("bigint", "int", "smallint", "tinyint"))
    number = ~F.coalesce(named, F.lit(False)) | F.coalesce(whole, F.lit(False))
    task = F.exists("columns", lambda c: c["name"] == "task")
    level = F.when(~number, "pass").when(task & F.lit(not language), "warn").otherwise("error")
    detail = F.when(~number, "").when(task, "the task is a column beside a plain index").otherwise("a plain index and no task column")
    good = f.where("error IS NULL").select("dataset_id", level.alias("level"), F.lit("task.tasks_parquet_index").alias("id"), detail.alias("detail"), (number & task).alias("fixable"))
    return good.union(f.where("error IS NOT NULL").select("dataset_id", F.lit("error"), F.lit("task.tasks_parquet_read"), "error", F.lit(False)))
