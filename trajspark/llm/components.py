"""Connected components of links between long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.session import materialize

ROUNDS = 40


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (a, b), a > b. Large star: each node hangs its larger neighbours on its smallest one; small star: its
    smaller ones and itself."""
    if large:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = edges.join(least, "a")
    if large:
        new = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return new.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node hangs on one node that hangs on none, which a further round leaves as it is."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest id that each node of (a, b) reaches. Nodes without links don't appear."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "links")
    for _ in range(ROUNDS):
        if _settled(edges):
            break
        edges = materialize(_stars(_stars(edges, True), False), "links")
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
