"""Queries on messages and their alignment."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators import alignment
from trajspark.plans import views
from trajspark.plans.rounding import rounded
from trajspark.plans.views import with_views
from trajspark.session import shared_dir
from trajspark.sources import messages

BASE, TOLERANCE_NS = "view", 60_000_000_000


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    m = views.messages_events(spark, d)
    return alignment.align_nearest(m, alignment.build_anchors(m, BASE))


def align_nearest_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_aligned(spark, d).where(F.col("topic") != BASE))


def alignment_report_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(alignment.alignment_report(_aligned(spark, d), BASE, TOLERANCE_NS).drop("first_beyond"))


def anchors_grid_events(spark: SparkSession, d: str) -> DataFrame:
    m = views.messages_events(spark, d)
    return rounded(alignment.build_anchors(m, BASE, 1 / 3600))


def topic_catalog_events(spark: SparkSession, d: str) -> DataFrame:
    m = views.messages_events(spark, d).withColumn("topic", F.concat(F.lit("/robot/"), "topic", F.when(F.col("topic") == "click", "_command").otherwise("_state")))
    t = alignment.topic_catalog(m)
    return rounded(t.select("bag", "topic", "n_messages", "category", "role", "suggested_name"))


def assemble_vectors_events(spark: SparkSession, d: str) -> DataFrame:
    m = views.messages_events(spark, d)
    config = spark.createDataFrame(
        [("state", "click", 0, ["a"], None), ("state", "purchase", 1, ["b"], None), ("action", "error", 0, ["c"], None)],
        "role string, topic string, topic_order int, names array<string>, mapping array<struct<source_index: int, target_index: int, name: string>>",
    )
    v = alignment.assemble_vectors(_aligned(spark, d), m, alignment.build_joint_layout(config))
    return rounded(v.select("bag", "anchor", "role", F.size("vector").alias("width"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).alias("total")))


def _recorded(spark: SparkSession, d: str, topics: list[str] | None = None) -> DataFrame:
    """The messages, or those of some topics, written into the shared folder, in files that bags share, and read back from
    them: a folder for each of ten thousands of short bags would cost more than its messages."""
    m = views.messages_events(spark, d).withColumn("payload", F.lit(None).cast("binary"))
    root = f"{shared_dir(spark).rstrip('/')}/trajspark/bags-{uuid.uuid4().hex}"
    m.repartition("bag").sortWithinPartitions("bag", "topic", "ts_ns").write.parquet(root)
    return messages.read_messages(spark, root, topics)


def messages_source_events(spark: SparkSession, d: str) -> DataFrame:
    m = _recorded(spark, d, ["click", "error"])
    return rounded(m.groupBy("bag", "topic").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ns"), F.max("seq").alias("last_seq"), F.sum(F.get("positions", F.lit(0))).alias("total")), 4)


def source_to_frames_events(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, _recorded(spark, d))


def messages_to_frames_events(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, views.messages_events(spark, d))


def _frames(spark: SparkSession, m: DataFrame) -> DataFrame:
    config = spark.createDataFrame(
        [("state", "click", 0, ["a"], None), ("state", "purchase", 1, ["b"], None), ("action", "error", 0, ["c"], None)],
        "role string, topic string, topic_order int, names array<string>, mapping array<struct<source_index: int, target_index: int, name: string>>",
    )
    f = alignment.messages_to_frames(m, BASE, alignment.build_joint_layout(config), 10.0)
    return rounded(f.select("bag", "pos", "timestamp", F.get("state", F.lit(0)).alias("s0"), F.get("action", F.lit(0)).alias("a0")))


QUERIES = {f.__name__: f for f in (align_nearest_events, alignment_report_events, anchors_grid_events, topic_catalog_events, assemble_vectors_events, messages_to_frames_events, messages_source_events, source_to_frames_events)}

_NEAR = """, an AS (SELECT bag, row_number() OVER (PARTITION BY bag ORDER BY ts_ns, seq) - 1 AS anchor, ts_ns AS anchor_ns FROM messages_events WHERE topic = 'view'),
 al AS (SELECT an.bag, anchor, anchor_ns, m.topic, m.seq, m.ts_ns, m.value, abs(m.ts_ns - anchor_ns) AS delta_ns FROM an JOIN messages_events m USING (bag)
 QUALIFY row_number() OVER (PARTITION BY an.bag, anchor, m.topic ORDER BY abs(m.ts_ns - anchor_ns), m.ts_ns < anchor_ns, CASE WHEN m.ts_ns < anchor_ns THEN -m.seq ELSE m.seq END) = 1)"""

ORACLE = {
    "align_nearest_events": with_views(["messages_events"], _NEAR + " SELECT bag, anchor, anchor_ns, topic, seq, ts_ns, delta_ns FROM al WHERE topic <> 'view'"),
    "alignment_report_events": with_views(["messages_events"], _NEAR + """, f AS (SELECT bag, anchor, coalesce(max(CASE WHEN topic <> 'view' THEN delta_ns END), 0) AS delta FROM al GROUP BY 1, 2)
 SELECT bag, count(*) AS n_frames, round(max(delta) / 1e6, 3) AS max_delta_ms, count(*) FILTER (delta > 60000000000) AS n_beyond FROM f GROUP BY bag"""),
    "anchors_grid_events": with_views(["messages_events"], """, s AS (SELECT bag, min(ts_ns) AS a, max(ts_ns) AS b FROM messages_events WHERE topic = 'view' GROUP BY 1),
 g AS (SELECT bag, unnest(range(a, b + 1800000000000, 3600000000000)) AS anchor_ns FROM s)
 SELECT bag, row_number() OVER (PARTITION BY bag ORDER BY anchor_ns) - 1 AS anchor, anchor_ns FROM g"""),
    "topic_catalog_events": with_views(["messages_events"], """ SELECT bag, '/robot/' || topic || CASE WHEN topic = 'click' THEN '_command' ELSE '_state' END AS topic, count(*) AS n_messages, 'joint_state' AS category,
 CASE WHEN topic = 'click' THEN 'action' ELSE 'state' END AS role, topic || CASE WHEN topic = 'click' THEN '_command' ELSE '_state' END AS suggested_name
 FROM messages_events GROUP BY bag, messages_events.topic"""),
    "assemble_vectors_events": with_views(["messages_events"], _NEAR + """ SELECT bag, anchor, CASE WHEN topic = 'error' THEN 'action' ELSE 'state' END AS role, count(*) AS width, round(sum(value), 6) AS total
 FROM al WHERE topic IN ('click', 'purchase', 'error') GROUP BY 1, 2, 3"""),
    "messages_to_frames_events": with_views(["messages_events"], _NEAR + """, w AS (SELECT bag, anchor, max(CASE WHEN topic = 'click' THEN value END) AS c, max(CASE WHEN topic = 'purchase' THEN value END) AS p, max(CASE WHEN topic = 'error' THEN value END) AS e FROM al
 WHERE topic IN ('click', 'purchase', 'error') GROUP BY 1, 2)
 SELECT bag, row_number() OVER (PARTITION BY bag ORDER BY anchor) - 1 AS pos, round((row_number() OVER (PARTITION BY bag ORDER BY anchor) - 1) / 10.0::DOUBLE, 6) AS "timestamp", round(coalesce(c, p), 6) AS s0, round(e, 6) AS a0 FROM w"""),
}
ORACLE |= {
    "messages_source_events": with_views(["messages_events"], """ SELECT bag, topic, count(*) AS n, min(ts_ns) AS first_ns, max(seq) AS last_seq, round(sum(value), 4) AS total
 FROM messages_events WHERE topic IN ('click', 'error') GROUP BY bag, topic"""),
    "source_to_frames_events": ORACLE["messages_to_frames_events"],
}
