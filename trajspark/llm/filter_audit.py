"""Audit of how filters interact: what each filter removes, in every order in which they can be applied.

Each filter has a relation of the ids that fail it. Survivors of a prefix are an anti-join of the survivors of a shorter
one with the failing ids of its last filter, what a step removes is a semi-join; as a prefix's survivors don't depend on
its order, each set of filters is joined once, all sets of one length in one join. Rows that fail nothing survive every
prefix and are counted once instead of being carried along.

Ids are the rows' own, so rows that repeat a doc_id count one by one. Null texts are empty, null parts the empty string.
A text is a duplicate if any row of the table with a smaller doc_id has it; a missing doc_id counts as larger than all
others, and rows that share doc_id and text don't fail by one another. A document has a label if any of its label rows
says so; labels of no document and labels without doc_id are left aside, as are other columns. An empty table gives no
rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.session import discard, materialize

BLANK = r"[\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")


def words(text: Column) -> Column:
    """Maximal runs of other characters than blanks."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def text_filters(text: Column, parts: Column) -> dict[str, Column]:
    """Conditions of failure of the filters A to D, over a text and its words."""
    return {
        "A": F.size(parts) < 100,
        "B": 100 * F.size(F.array_distinct(parts)) < 80 * F.size(parts),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, doc_id, part, digest, failed, good, toxic) of every row, texts gone."""
    read = docs.select(
        F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    read = read.withColumn("words", words(F.col("text")))
    failed = [F.when(c, F.lit(k)) for k, c in text_filters(F.col("text"), F.col("words")).items()]
    read = read.select("id", "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.array_compact(F.array(*failed)).alias("failed"))
    said = labels.select("doc_id", *[(F.coalesce(F.col(c), F.lit(0)) == 1).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    said = said.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(c).cast("long").alias(c) for c in COUNTS[1:]])
    return materialize(read.join(said, "doc_id", "left").select(read["*"], *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS[1:]]), "audit-facts")


def failing_ids(facts: DataFrame, duplicate: str) -> DataFrame:
    """(id, filter): a table for each filter, in a folder of its own."""
    firsts = facts.groupBy(F.col("digest").alias("same")).agg(F.min("doc_id").alias("least"))
    # the key has the id too, so that the copies of one text are not one group
    repeats = facts.join(firsts, (F.col("digest") == F.col("same")) & F.col("doc_id").eqNullSafe(F.col("least")), "left_anti")
    found = facts.select("id", F.explode("failed").alias("filter")).union(repeats.select("id", F.lit(duplicate)))
    return materialize(found, "audit-failing", partition_by=["filter"])


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy("part", *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``filter_order``, ``step`` and the counts of every part (a value of lang), order of the filters A to E
    and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    letters = "ABCDE"
    facts = _facts(docs, labels)
    failing = failing_ids(facts, letters[-1])
    row = facts.select("id", "part", "good", "toxic")
    survivors = [materialize(row.join(failing.select("id"), "id", "left_semi").withColumn("prefix", F.lit("")), "audit-survivors")]
    removed = []
    for k in range(len(letters)):
        prefix = F.col("prefix")
        steps = survivors[k].withColumn("filter", F.explode(F.filter(F.split(F.lit(letters), ""), lambda f: (f != "") & ~prefix.contains(f))))
        removed.append(_counted(steps.join(failing, ["id", "filter"], "left_semi"), "prefix", "filter"))
        # a set of filters is reached in alphabetical order only
        onward = steps.where(F.col("filter") > F.substring(prefix, -1, 1)).join(failing, ["id", "filter"], "left_anti")
        survivors.append(materialize(onward.select("id", "part", "good", "toxic", F.concat("prefix", "filter").alias("prefix")), "audit-survivors"))
    union = removed[0]
    for other in removed[1:]:
        union = union.union(other)
    gone = materialize(union, "audit-removed")
    left = _counted(survivors[1], "prefix")
    for other in survivors[2:]:
        left = left.union(_counted(other, "prefix"))
    clean = row.join(failing.select("id"), "id", "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("n_clean"))
    parts = facts.groupBy("part").agg(F.count(F.lit(1)).alias("n_all")).join(clean, "part", "left").select("part", F.coalesce("n_clean", F.lit(0)).alias("n_clean"))
    parts, left = materialize(parts, "audit-parts"), materialize(left, "audit-left")
    fails = materialize(_counted(row.join(failing, "id"), "filter").select("part", "filter", F.col("n").alias("n_fail")), "audit-fails")
    discard(*survivors, failing, facts)
    return _report(parts, gone, left, fails, letters)


def _report(parts: DataFrame, gone: DataFrame, left: DataFrame, fails: DataFrame, letters: str) -> DataFrame:
    rows = [
        (n, "".join(order), step + 1, order[step], "".join(sorted(order[:step])), "".join(sorted(order[: step + 1])), "".join(sorted(set(letters) - {order[step]})))
        for n, (order, step) in enumerate((o, s) for o in permutations(letters) for s in range(len(letters)))
    ]
    orders = parts.sparkSession.createDataFrame(rows, "nth int, filter_order string, step int, filter string, prefix string, after string, others string")
    grid = parts.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1)))).join(orders, "nth")
    alone = gone.select("part", "filter", F.col("prefix").alias("others"), F.col("n").alias("n_alone"))
    kept = left.select("part", F.col("prefix").alias("after"), F.col("n").alias("n_left"))
    grid = grid.join(gone, ["part", "prefix", "filter"], "left").join(kept, ["part", "after"], "left").join(fails, ["part", "filter"], "left").join(alone, ["part", "filter", "others"], "left")
    here = F.coalesce("n", F.lit(0))
    report = grid.select(
        "part", "filter_order", "step", "filter", (F.col("n_clean") + F.coalesce("n_left", F.lit(0))).alias("kept"), here.alias("removed"),
        (F.coalesce("n_fail", F.lit(0)) - here).alias("redundant"), F.coalesce("n_alone", F.lit(0)).alias("unique_fails"),
        F.coalesce("good", F.lit(0)).alias("good_lost"), F.coalesce("toxic", F.lit(0)).alias("toxic_lost"),
    )
    worth = report.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return report.join(worth, ["part", "filter"]).drop("filter")
