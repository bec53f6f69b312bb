"""Queries on the likeness of joint names: parts, by tens, are datasets, their names in two spellings the two lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators import names
from trajspark.plans.views import table


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key, words = F.col("p_partkey"), F.split("p_name", " ")
    p = table(spark, d, "part").select(key, "p_name", "p_size", words.alias("w"))
    spelt = F.when(key % 4 == 0, F.col("p_name")).when(key % 4 == 1, F.concat("p_name", F.lit(" Joint"))).when(key % 4 == 2, F.concat("p_name", F.lit("-1"))).otherwise(F.concat(F.lit("Left "), "p_name"))
    other = (
        F.when(key % 3 == 0, F.concat(F.element_at("w", 2), F.lit("_"), F.element_at("w", 1)))
        .when(key % 3 == 1, F.concat(F.lit("base_link_"), F.replace("p_name", F.lit(" "), F.lit("")), (F.col("p_size") % 2).cast("string"))).otherwise(F.concat("p_name", F.lit("_2")))
    )
    of = lambda k, name: p.select(F.floor(k / 10).cast("long").alias("dataset_id"), (k % 10).cast("int").alias("name_index"), name.alias("name"))
    return of(key, spelt), of(key + 3, other)


def name_scores_part(spark: SparkSession, d: str) -> DataFrame:
    return names.name_scores(*_lists(spark, d))


def name_scores_grouped_part(spark: SparkSession, d: str) -> DataFrame:
    return names.name_scores(*_lists(spark, d), grouped=True)


def match_names_part(spark: SparkSession, d: str) -> DataFrame:
    return names.match_names(*_lists(spark, d))


def match_summary_part(spark: SparkSession, d: str) -> DataFrame:
    return names.match_summary(names.match_names(*_lists(spark, d)))


def _described(view: str, key: str, name: str) -> str:
    return f"""{view}0 AS (
  SELECT ({key}) // 10 AS dataset_id, CAST(({key}) % 10 AS INTEGER) AS name_index, {name} AS name FROM part
), {view}1 AS (
  SELECT *, regexp_replace(lower(trim(name)), '[\\s-]+', '_', 'g') AS norm FROM {view}0
), {view}2 AS (
  SELECT *, [x FOR x IN string_split(regexp_replace(regexp_replace(norm, '([a-z])([0-9])', '\\1_\\2', 'g'), '([0-9])([a-z])', '\\1_\\2', 'g'), '_') IF x <> ''] AS raw FROM {view}1
), {view}3 AS (
  SELECT *, [x FOR x IN raw IF NOT list_contains([{', '.join(f"'{w}'" for w in names.STOP_WORDS)}], x)] AS words,
    CASE WHEN list_contains(raw, 'left') THEN 'left' WHEN list_contains(raw, 'right') THEN 'right' END AS side,
    CASE {' '.join(f"WHEN list_has_any(raw, [{', '.join(repr(w) for w in those)}]) THEN '{p}'" for p, those in names.PARTS.items())} END AS part FROM {view}2
), {view} AS (
  SELECT *, list_distinct([x FOR x IN list_concat([norm, replace(norm, '_', ''), array_to_string(words, '_'), array_to_string(words, '')],
    CASE WHEN len(words) > 1 THEN [array_to_string(words[-2:], '_'), array_to_string(words[-2:], ''), words[-1]] ELSE [] END) IF x <> '']) AS spellings FROM {view}3
)"""


_SPELT = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' Joint' WHEN 2 THEN p_name || '-1' ELSE 'Left ' || p_name END"
_OTHER = "CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 2) || '_' || split_part(p_name, ' ', 1) WHEN 1 THEN 'base_link_' || replace(p_name, ' ', '') || CAST(p_size % 2 AS VARCHAR) ELSE p_name || '_2' END"


def _scores(grouped: bool) -> str:
    more = " + CASE WHEN s.side = t.side THEN 140 ELSE 0 END + CASE WHEN s.part = t.part THEN 220 ELSE 0 END" if grouped else ""
    fits = "coalesce(s.side = t.side, true) AND coalesce(s.part = t.part, true)" if grouped else "true"
    return f"""WITH {_described('s', 'p_partkey', _SPELT)}, {_described('t', 'p_partkey + 3', _OTHER)}, pairs AS (
  SELECT s.dataset_id, s.name_index AS source_index, s.name AS source_name, t.name_index AS target_index, t.name AS target_name, {fits} AS fits,
    s.norm = t.norm AS same, len(s.words) = 0 OR len(t.words) = 0 AS empty, ends_with(s.norm, t.norm) OR ends_with(t.norm, s.norm) AS ends,
    list_max([len(x) FOR x IN s.spellings IF list_contains(t.spellings, x)]) AS longest, list_max([len(x) FOR x IN s.spellings]) AS most,
    len([x FOR x IN s.words IF list_contains(t.words, x)]) AS overlap,
    CASE WHEN s.words[-1] = t.words[-1] THEN 220 ELSE 0 END + CASE WHEN s.words[1] = t.words[1] THEN 80 ELSE 0 END
      + CASE WHEN contains(s.norm, t.norm) OR contains(t.norm, s.norm) THEN 60 ELSE 0 END{more} AS extra
  FROM s JOIN t USING (dataset_id)
)
SELECT dataset_id, source_index, source_name, target_index, target_name, score FROM (
  SELECT *, CAST(CASE WHEN NOT fits THEN 0 WHEN same THEN 1000 WHEN longest IS NOT NULL THEN floor(500 + 400 * (longest / most) + 0.5) WHEN empty THEN 0
    WHEN overlap > 0 THEN 120 * overlap + extra WHEN ends THEN 300 ELSE 0 END AS INTEGER) AS score FROM pairs
) WHERE score > 0"""


QUERIES = {f.__name__: f for f in (name_scores_part, name_scores_grouped_part, match_names_part, match_summary_part)}
ORACLE = {"name_scores_part": _scores(False), "name_scores_grouped_part": _scores(True)}
