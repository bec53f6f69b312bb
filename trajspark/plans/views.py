"""The given tables seen as robot data: events and embeddings as frames, events as messages, and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    seconds = F.date_part(F.lit("SECOND"), ts).cast("decimal(18,6)")
    return day * 86_400_000_000 + clock.cast("long") * 1_000_000 + (seconds * 1_000_000).cast("long")


def frames_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An episode per user; one state axis, the value; seconds since the user's first event."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", micros(F.col("ts")).alias("us"), "value")
    user = Window.partitionBy("user_id")
    return e.select(
        F.lit("events").alias("dataset_id"),
        F.col("user_id").alias("episode_index"),
        (F.row_number().over(user.orderBy("us", "event_id")) - 1).cast("long").alias("pos"),
        ((F.col("us") - F.min("us").over(user)) / 1e6).alias("timestamp"),
        F.array("value").alias("state"),
    )


def frames_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An episode per label; state and action are the halves of the vector; 30 frames a second."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    pos = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(
        F.lit("embeddings").alias("dataset_id"),
        F.col("label").cast("long").alias("episode_index"),
        pos.cast("long").alias("pos"),
        (pos / 30.0).alias("timestamp"),
        F.slice(v, 1, 32).alias("state"),
        F.slice(v, 33, 32).alias("action"),
    )


#: Lengths of the vectors of ``frames_lineitem``.
LINEITEM_WIDTHS = {"state": 3}


def frames_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An episode per order, a frame per line."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
    state = [F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount")]
    return table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("dataset_id"),
        F.col("l_orderkey").cast("long").alias("episode_index"),
        pos.cast("long").alias("pos"),
        (pos / 30.0).alias("timestamp"),
        F.array(*state).alias("state"),
    )


def messages_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bag per user, a topic per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("bag"),
        F.col("event_type").alias("topic"),
        F.lit("sensor_msgs/msg/JointState").alias("msg_type"),
        (micros(F.col("ts")) * 1000).alias("ts_ns"),
        F.col("event_id").alias("seq"),
        F.array(F.col("event_type")).alias("names"),
        F.array("value").alias("positions"),
    )


def gray_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 grey frame per vector."""
    e = table(spark, sf_dir, "embeddings")
    pos = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    gray = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint((x + 0.5) * 255))).cast("int"))
    return e.select(
        F.lit("embeddings").alias("dataset_id"), F.lit("cam").alias("camera"), F.col("label").cast("long").alias("episode_index"),
        pos.cast("long").alias("pos"), F.lit(8).alias("height"), F.lit(8).alias("width"), gray.alias("gray"),
    )


def tasks_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An episode per order with its priority as the task; finished orders and the others are two datasets."""
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "finished").otherwise("open").alias("dataset_id"),
        F.col("o_orderkey").cast("long").alias("episode_index"),
        F.col("o_orderpriority").alias("task"),
    )


def files_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An episode per part with its price as size."""
    return table(spark, sf_dir, "part").select(
        F.lit("part").alias("dataset_id"), F.col("p_partkey").cast("long").alias("episode_index"),
        F.col("p_retailprice").cast("double").alias("bytes"), F.lit(1).cast("long").alias("length"),
    )


#: The same views in SQL, to stand before a query that uses them.
SQL = {
    "frames_events": """frames_events AS (
  SELECT 'events' AS dataset_id, user_id AS episode_index,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS ts, value
  FROM events)""",
    "frames_embeddings": """frames_embeddings AS (
  SELECT 'embeddings' AS dataset_id, CAST(label AS BIGINT) AS episode_index,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
         CAST(embedding[1:32] AS DOUBLE[]) AS state, CAST(embedding[33:64] AS DOUBLE[]) AS action
  FROM embeddings),
axis_embeddings AS (
  SELECT dataset_id, episode_index, pos, unnest(range(32)) AS axis_index, unnest(state) AS s, unnest(action) AS a
  FROM frames_embeddings)""",
    "frames_lineitem": """frames_lineitem AS (
  SELECT 'lineitem' AS dataset_id, CAST(l_orderkey AS BIGINT) AS episode_index,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS pos,
         CAST(l_quantity AS DOUBLE) AS v0, CAST(l_extendedprice AS DOUBLE) AS v1, CAST(l_discount AS DOUBLE) AS v2
  FROM lineitem)""",
    "messages_events": """messages_events AS (
  SELECT CAST(user_id AS VARCHAR) AS bag, event_type AS topic, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, value FROM events)""",
    "gray_embeddings": """gray_embeddings AS (
  SELECT CAST(label AS BIGINT) AS episode_index, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
         [CAST(least(255.0, greatest(0.0, round_even((x + 0.5) * 255, 0))) AS INTEGER) FOR x IN CAST(embedding AS DOUBLE[])] AS gray
  FROM embeddings)""",
}


def with_views(names: list[str], query: str) -> str:
    """``query`` after the named views; it may go on with ", name AS (...)"."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + query
