"""Session helpers: a local session for tests, and tables in the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Files of a table that is written in few, at least; more where there are many cores.
FEW = 16


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the session that is already there."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trajspark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local session gets one of our own where it
    is unset; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="trajspark-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] | list[str] = (), few: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: the lineage ends there, and a lost
    executor costs no recomputation of what lies before. ``partition_by``: columns whose values get folders of their own.
    ``few``: partitions of little data are written one after the other, in four tasks a core or FEW; without Hadoop's native
    library each file on a local disk costs an executor two processes for its permissions."""
    spark = df.sparkSession
    if few:
        df = df.coalesce(max(FEW, 4 * spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark).rstrip('/')}/trajspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` made, once their last reader is done, and let the driver collect
    its garbage: shuffle files of plans that nobody holds any more go with it."""
    context = tables[0].sparkSession.sparkContext
    for table in tables:
        path = context._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    collect_garbage(tables[0].sparkSession)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver collect its garbage: shuffle files of plans that nobody holds any more go with it. Twice, as the first
    time only lets go of the tables that Python has dropped, and the second of what these held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
