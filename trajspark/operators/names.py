"""Joint names of two lists matched by likeness: an inverted index gives candidates, a score ranks them, and each dataset's
names are assigned in order, one to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.operators.axes import PARTS, axis_group, axis_part, axis_side

#: Words that say nothing about which joint it is. Fixed values.
STOP_WORDS = ("joint", "joints", "link", "base", "world", "fixed", "motor", "actuator", "axis", "frame", "root", "arm", "hand")
#: Scores. Fixed values.
EXACT, VARIANT, VARIANT_LENGTH, TOKEN, LAST, FIRST, CONTAINS, SIDE, PART, SUFFIX = 1000, 500, 400, 120, 220, 80, 60, 140, 220, 300
#: Least score of a match, least score of one by name, and the scores of matches by order. Fixed values.
LEAST, BY_NAME, IN_ORDER, LEFT_OVER = 300, 900, 100, 50


def normalized(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", "")), r"[\s\-]+", "_")


def spaced(norm: Column) -> Column:
    """Words and numbers of a normalised name, an underscore between them."""
    apart = F.regexp_replace(F.regexp_replace(norm, "([a-z])([0-9])", "$1_$2"), "([0-9])([a-z])", "$1_$2")
    return F.regexp_replace(apart, "[^a-z0-9]+", "_")


def joint_group(name: Column, context: Column) -> Column:
    """Group of a joint's name (see ``axes.axis_group``) where the words of its topic count too."""
    return axis_group(spaced(normalized(F.concat_ws("_", name, context))))


def tokens(norm: Column) -> Column:
    """Words and numbers of a normalised name, without stop words."""
    return F.filter(F.split(spaced(norm), "_"), lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def variants(norm: Column, words: Column) -> Column:
    """Spellings under which a name may be known: whole, without separators, by its words, by its last two and last one."""
    two = F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2)
    short = F.when(F.size(words) > 1, F.array(F.array_join(two, "_"), F.array_join(two, ""), F.get(words, F.size(words) - 1)))
    all_ = F.concat(F.array(norm, F.replace(norm, F.lit("_"), F.lit("")), F.array_join(words, "_"), F.array_join(words, "")), F.coalesce(short, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(all_, lambda v: v != ""))


def described(names: DataFrame) -> DataFrame:
    """``names``: dataset_id, name_index, name, and optionally context (a topic, whose words count for side and part). Adds
    norm, words, spellings, side, part. Names are dealt out first: a million of them are a few MB of files, which one or
    two tasks would read and describe."""
    names = names.repartition("dataset_id", "name_index")
    context = F.coalesce(F.col("context"), F.lit("")) if "context" in names.columns else F.lit("")
    d = names.select("dataset_id", "name_index", "name", normalized(F.col("name")).alias("norm"), spaced(normalized(F.concat_ws("_", "name", context))).alias("full"))
    d = d.withColumn("words", tokens(F.col("norm"))).withColumn("spellings", variants(F.col("norm"), F.col("words")))
    return d.select("dataset_id", "name_index", "name", "norm", "words", "spellings", axis_side(F.col("full")).alias("side"), axis_part(F.col("full")).alias("part"))


def _sorted(d: DataFrame) -> DataFrame:
    """``d`` to be joined by sorting. Spark sizes a broadcast by the files, and names are many times as large with their terms
    and spellings: half a million parts are 2 MB of files, and their terms don't fit into the driver."""
    return d.hint("merge")


def _features(d: DataFrame, source: bool) -> DataFrame:
    """Hashes of the terms under which a name is found: spellings, words, and its whole form where the other's ends with it.
    Two terms of one hash make a pair too many, which scores nothing."""
    tag = lambda k: lambda x: F.concat(F.lit(k), x)
    ends = F.transform(F.sequence(F.lit(1), F.length("norm")), lambda i: F.substring(F.col("norm"), i, F.length("norm")))
    whole, ending = ("w:", "e:") if source else ("e:", "w:")
    terms = F.concat(F.transform("spellings", tag("v:")), F.transform("words", tag("t:")), F.transform(F.array("norm"), tag(whole)), F.transform(ends, tag(ending)))
    return d.where("norm <> ''").select("dataset_id", "name_index", F.explode(F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))).alias("term"))


def score(grouped: bool) -> Column:
    """Likeness of the names described by the structs ``s`` (source) and ``t`` (target). ``grouped``: side and part count,
    and names of different ones don't match."""
    shared = F.filter("s.spellings", lambda v: F.array_contains("t.spellings", v))
    longest = lambda a: F.array_max(F.transform(a, lambda v: F.length(v)))
    by_variant = F.floor(VARIANT + VARIANT_LENGTH * (longest(shared) / longest(F.col("s.spellings"))) + 0.5)
    overlap = F.size(F.filter("s.words", lambda w: F.array_contains("t.words", w)))
    inside = F.contains("t.norm", "s.norm") | F.contains("s.norm", "t.norm")
    ends = F.endswith("t.norm", "s.norm") | F.endswith("s.norm", "t.norm")
    last, first = (F.try_element_at("s.words", F.lit(k)) == F.try_element_at("t.words", F.lit(k)) for k in (-1, 1))
    points = lambda c, n: F.when(c, n).otherwise(0)
    by_word = TOKEN * overlap + points(last, LAST) + points(first, FIRST) + points(inside, CONTAINS)
    compatible = F.lit(True)
    if grouped:
        by_word = by_word + points(F.col("s.side") == F.col("t.side"), SIDE) + points(F.col("s.part") == F.col("t.part"), PART)
        compatible = F.coalesce(F.col("s.side") == F.col("t.side"), F.lit(True)) & F.coalesce(F.col("s.part") == F.col("t.part"), F.lit(True))
    empty = (F.size("s.words") == 0) | (F.size("t.words") == 0)
    found = F.when(F.col("s.norm") == F.col("t.norm"), EXACT).when(F.size(shared) > 0, by_variant).when(empty, 0).when(overlap > 0, by_word).when(ends, SUFFIX).otherwise(0)
    return F.when((F.col("s.norm") != "") & (F.col("t.norm") != "") & compatible, found).otherwise(0).cast("int")


def name_scores(sources: DataFrame, targets: DataFrame, grouped: bool = False) -> DataFrame:
    """(dataset_id, source_index, source_name, target_index, target_name, score) of all pairs that score. Pairs come from
    an inverted index of terms, as a pair without a common one scores nothing. J10."""
    s, t = described(sources), described(targets)
    one = _features(s, True).withColumnRenamed("name_index", "source_index")
    two = _features(t, False).withColumnRenamed("name_index", "target_index")
    pairs = one.join(_sorted(two), ["dataset_id", "term"]).select("dataset_id", "source_index", "target_index").distinct()
    pack = lambda d, key, as_: d.select("dataset_id", F.col("name_index").alias(key), F.struct("name", "norm", "words", "spellings", "side", "part").alias(as_))
    met = pairs.join(_sorted(pack(s, "source_index", "s")), ["dataset_id", "source_index"]).join(_sorted(pack(t, "target_index", "t")), ["dataset_id", "target_index"])
    return met.select("dataset_id", "source_index", F.col("s.name").alias("source_name"), "target_index", F.col("t.name").alias("target_name"), score(grouped).alias("score")).where("score > 0")


def _pick(candidates: Column, used: Column) -> Column:
    return F.get(F.filter(candidates, lambda c: ~F.array_contains(used, c["name"])), F.lit(0))


def match_names(sources: DataFrame, targets: DataFrame, grouped: bool = False) -> DataFrame:
    """(dataset_id, source_index, source_name, target_name, score, mode): sources in order take the best free target of a
    score of ``LEAST`` or more, the earlier one of equals. The rest is matched in order: all of it if nothing was found by
    score (mode index), else what is left on both sides (index-fallback). ``grouped``: only targets of the source's part
    and side are taken for those, and none if the source has no part and targets have several. A target name that
    repeats counts once, at its first place; a dataset's names are few, so its fold is one row. J10."""
    pack = lambda d: described(d).groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("name_index", "name", "side", "part"))).alias("all"))
    scored = name_scores(sources, targets, grouped).where(F.col("score") >= LEAST)
    best = scored.groupBy("dataset_id", "source_index").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "target_index", F.col("target_name").alias("name")))).alias("best"))
    lists = best.groupBy("dataset_id").agg(F.map_from_entries(F.collect_list(F.struct("source_index", "best"))).alias("best"))
    d = pack(sources).withColumnRenamed("all", "source").join(_sorted(pack(targets).withColumnRenamed("all", "target")), "dataset_id").join(_sorted(lists), "dataset_id", "left")
    out = "array<struct<source_index: int, source_name: string, target_name: string, score: int>>"
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(out).alias("out"))

    def taken(acc: Column, s: Column, target: Column, points: Column) -> Column:
        row = F.struct(s["name_index"].cast("int").alias("source_index"), s["name"].alias("source_name"), target.alias("target_name"), points.cast("int").alias("score"))
        grown = F.struct(F.array_append(acc["used"], target).alias("used"), F.array_append(acc["out"], row).alias("out"))
        return F.when(target.isNull(), acc).otherwise(grown)

    def by_score(acc: Column, s: Column) -> Column:
        c = _pick(F.coalesce(F.try_element_at("best", s["name_index"]), F.array().cast("array<struct<rank: int, target_index: int, name: string>>")), acc["used"])
        return taken(acc, s, c["name"], -c["rank"])

    def fits(s: Column, used: Column) -> Column:
        free = F.filter("target", lambda t: ~F.array_contains(used, t["name"]))
        if not grouped:
            return free
        same = F.filter(free, lambda t: F.coalesce(t["side"] == s["side"], F.lit(True)) & F.when(s["part"].isNull(), True).otherwise(F.coalesce(t["part"] == s["part"], F.lit(False))))
        parts = F.size(F.array_distinct(F.array_compact(F.transform(same, lambda t: t["part"]))))
        return F.when(s["part"].isNull() & (parts > 1), F.array().cast("array<struct<name_index: int, name: string, side: string, part: string>>")).otherwise(same)

    def in_order(acc: Column, s: Column) -> Column:
        done = F.exists(acc["out"], lambda r: r["source_index"] == s["name_index"])
        points = F.when(F.size("first.out") == 0, IN_ORDER).otherwise(LEFT_OVER)
        return F.when(done, acc).otherwise(taken(acc, s, F.get(fits(s, acc["used"]), F.lit(0))["name"], points))

    d = d.withColumn("first", F.aggregate("source", start, by_score))
    d = d.withColumn("second", F.aggregate("source", F.col("first"), in_order))
    mode = F.when(F.col("score") >= BY_NAME, "name").when(F.col("score") >= LEAST, "heuristic").when(F.col("score") == IN_ORDER, "index").otherwise("index-fallback")
    return d.select("dataset_id", F.inline("second.out")).withColumn("mode", mode)


def match_summary(matches: DataFrame) -> DataFrame:
    """Numbers of matches by mode in each dataset, and what the whole is: by index, mixed, or by name."""
    n = matches.groupBy("dataset_id").agg(*[F.count_if(F.col("mode").isin(*m)).alias(k) for k, m in (("n_name", ["name"]), ("n_heuristic", ["heuristic"]), ("n_index", ["index", "index-fallback"]))])
    return n.withColumn("mode", F.when((F.col("n_index") > 0) & (F.col("n_name") + F.col("n_heuristic") == 0), "index").when(F.col("n_heuristic") + F.col("n_index") > 0, "mixed").otherwise("name"))
