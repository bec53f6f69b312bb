"""Recordings that appear over time, taken in once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def incremental_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, to_frames: Callable[[DataFrame], DataFrame], kind: str = "parquet") -> None:
    """Message files that ``source`` has gained since the last call become frames in ``target``; a stopped run goes on
    where it was. Episode numbers follow the largest one there; a batch that is written again replaces its own. ``kind``:
    the source's format; one other than files has its own schema. M2."""
    stream = spark.readStream.format(kind)
    stream = (stream.schema(schema) if kind == "parquet" else stream).load(source)

    numbers = f"{target.rstrip('/')}.numbers"  # a row for each bag that has been numbered, a folder for each batch
    known = spark.read.schema("bag string, episode_index long, batch long").option("recursiveFileLookup", False)
    context = spark.sparkContext

    def there(path: str) -> bool:
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(context._jsc.hadoopConfiguration()).exists(p)

    def write(batch: DataFrame, number: int) -> None:
        frames = to_frames(batch).persist()
        old = known.parquet(numbers).where(F.col("batch") != number) if there(numbers) else spark.createDataFrame([], "bag string, episode_index long, batch long")
        most = old.agg(F.max("episode_index")).first()[0]
        # new bags only, a name each; a bag whose files come in several runs keeps its number
        fresh = frames.select("bag").distinct().join(old, "bag", "left_anti")
        rank = F.row_number().over(Window.orderBy("bag")) + F.lit(-1 if most is None else most)
        fresh.select("bag", rank.cast("long").alias("episode_index")).write.mode("overwrite").parquet(f"{numbers}/batch={number}")
        numbered = frames.join(known.parquet(numbers).select("bag", "episode_index"), "bag")
        numbered.write.mode("overwrite").parquet(f"{target}/batch={number}")
        frames.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
