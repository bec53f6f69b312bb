"""Deleting, renumbering, appending and merging of episodes, and edits of fields."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.operators.axes import EPISODE, FPS
from trajspark.operators.motion import static_edge_trim, trimmed_frames
from trajspark.operators.stats import episode_lengths, length_outliers

#: Fields that edits must leave alone, and those that need consent to go. Fixed values.
RESERVED = ("episode_index", "frame_index", "index", "timestamp", "task_index", "dataset_id", "pos")
PROTECTED = ("state", "action")


def renumber_frames(frames: DataFrame) -> DataFrame:
    """``pos`` and ``frame_index`` from 0 in each episode. W9."""
    n = (F.row_number().over(Window.partitionBy(*EPISODE).orderBy("pos")) - 1).cast("long")
    return frames.withColumn("__n", n).withColumn("pos", F.col("__n")).withColumn("frame_index", F.col("__n")).drop("__n")


def episode_offsets(frames: DataFrame) -> DataFrame:
    """Row per episode: its new number and the number of frames before it, in the order of old numbers. The running sum
    is over the episode table, so frames are never sorted as a whole. W10, W11."""
    e = episode_lengths(frames)
    order = Window.partitionBy("dataset_id").orderBy("episode_index")
    return e.select(
        *EPISODE, "length", (F.row_number().over(order) - 1).cast("long").alias("new_index"),
        (F.sum("length").over(order) - F.col("length")).cast("long").alias("first_frame"),
    )


def renumber(frames: DataFrame) -> DataFrame:
    """Frames, episodes and the global ``index`` from 0; the old number stays in ``orig_episode_index``. W9, W10, W11."""
    out = renumber_frames(frames).join(episode_offsets(frames).drop("length"), EPISODE)
    out = out.withColumn("index", F.col("first_frame") + F.col("pos")).withColumn("orig_episode_index", F.col("episode_index"))
    return out.withColumn("episode_index", F.col("new_index")).drop("new_index", "first_frame")


def rebuild_timestamps(frames: DataFrame, before: DataFrame, fps: float = FPS) -> DataFrame:
    """Times become pos / fps in episodes whose number of frames is not that of ``before`` (episode, orig_length). W12."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*EPISODE))
    joined = frames.withColumn("__n", n).join(before.select(*EPISODE, "orig_length"), EPISODE, "left")
    changed = F.coalesce(F.col("__n") != F.col("orig_length"), F.lit(True))
    return joined.withColumn("timestamp", F.when(changed, F.col("pos") / fps).otherwise(F.col("timestamp"))).drop("__n", "orig_length")


def delete_episodes(frames: DataFrame, gone: DataFrame) -> DataFrame:
    """G3."""
    return renumber(frames.join(gone.select(*EPISODE).distinct(), EPISODE, "left_anti"))


def delete_frames(frames: DataFrame, gone: DataFrame) -> DataFrame:
    """Frames without those of ``gone`` (episode, pos), renumbered; an episode left without frames is gone. G4."""
    return renumber(frames.join(gone.select(*EPISODE, "pos").distinct(), [*EPISODE, "pos"], "left_anti"))


def delete_except_bridges(gone: DataFrame, bridges: DataFrame) -> DataFrame:
    """The frames to delete without the recommended bridges. G6."""
    return gone.join(bridges.select(*EPISODE, "pos"), [*EPISODE, "pos"], "left_anti")


def batch_plan(frames: DataFrame, k: float = 1.5, column: str = "action", threshold: float = 10.0, window: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(episodes to delete, trims of the others, totals by dataset). A26."""
    lengths = episode_lengths(frames)
    gone = length_outliers(lengths, k)
    trims = static_edge_trim(frames, column, threshold, window=window).join(gone.select(*EPISODE), EPISODE, "left_anti")
    cut = trims.groupBy("dataset_id").agg(F.sum(F.col("trim_start") + F.col("trim_end")).alias("trimmed_frames"), F.count_if(F.col("trim_start") + F.col("trim_end") > 0).alias("trimmed_episodes"))
    lost = gone.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("deleted_episodes"), F.sum("length").alias("deleted_frames"))
    whole = lengths.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("episodes"), F.sum("length").alias("frames"))
    t = whole.join(lost, "dataset_id", "left").join(cut, "dataset_id", "left").na.fill(0)
    t = t.withColumn("kept_episodes", F.col("episodes") - F.col("deleted_episodes"))
    return gone, trims, t.withColumn("kept_frames", F.col("frames") - F.col("deleted_frames") - F.col("trimmed_frames"))


def apply_batch_plan(frames: DataFrame, gone: DataFrame, trims: DataFrame) -> DataFrame:
    """Both deletions on the old numbers, then one renumbering. G5."""
    kept = frames.join(gone.select(*EPISODE), EPISODE, "left_anti").join(trimmed_frames(trims), [*EPISODE, "pos"], "left_anti")
    return renumber(kept)


def task_signature(columns: list[str]) -> Column:
    """What tells tasks apart: all their fields but the number, in order of name."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def remap_tasks(tasks: DataFrame, order: DataFrame) -> DataFrame:
    """(dataset_id, task_index, new_index): distinct tasks over all datasets in the order they are first seen;
    ``order``: dataset_id, dataset_order, no two datasets of one order. J15, G7."""
    fields = [c for c in tasks.columns if c not in ("dataset_id", "task_index")]
    t = tasks.join(order, "dataset_id").withColumn("signature", task_signature(fields))
    # tasks are numbered within the dataset that has them first; datasets, a row each, are summed in order
    first = t.groupBy("signature").agg(F.min(F.struct("dataset_order", "task_index")).alias("seen"))
    through = Window.orderBy("dataset_order").rowsBetween(Window.unboundedPreceding, -1)
    before = first.groupBy(F.col("seen.dataset_order").alias("dataset_order")).agg(F.count(F.lit(1)).alias("n"))
    before = before.select("dataset_order", F.coalesce(F.sum("n").over(through), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("seen.dataset_order").orderBy("seen.task_index")) - 1
    first = first.select("signature", own.alias("own"), F.col("seen.dataset_order").alias("dataset_order")).join(before, "dataset_order")
    first = first.select("signature", (F.col("before") + F.col("own")).alias("new_index"))
    return t.join(first, "signature").select("dataset_id", "task_index", F.col("new_index").cast("long").alias("new_index"))


def resolve_episode_task(episodes: DataFrame, frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """Task of each episode: its own number, else its frames' first, else that of its first known task name, else 0. J7."""
    by_frame = frames.where("task_index is not null").groupBy(*EPISODE).agg(F.min_by("task_index", "pos").alias("frame_task"))
    names = episodes.select(*EPISODE, F.posexplode("tasks").alias("place", "task"))
    known = names.join(tasks.select("dataset_id", "task", F.col("task_index").alias("named")), ["dataset_id", "task"]).groupBy(*EPISODE).agg(F.min_by("named", "place").alias("name_task"))
    e = episodes.join(by_frame, EPISODE, "left").join(known, EPISODE, "left")
    return e.select(*EPISODE, F.coalesce(F.col("task_index").try_cast("long"), "frame_task", "name_task", F.lit(0)).cast("long").alias("task_index"))


def feature_signature(features: DataFrame) -> DataFrame:
    return features.select("dataset_id", "feature", "dtype", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), F.array_join("names", ",").alias("names"))


def merge_conflicts(features: DataFrame, datasets: DataFrame, main: str) -> DataFrame:
    """(dataset_id, problem) of all that cannot be appended to ``main``: other features, frame rate or robot. G2."""
    f = feature_signature(features)
    own = f.where(F.col("dataset_id") == main).drop("dataset_id")
    others = f.where(F.col("dataset_id") != main)
    every = others.select("dataset_id").distinct().crossJoin(own.select("feature", *[F.col(c).alias(f"m_{c}") for c in ("dtype", "shape", "names")]))
    met = every.join(others, ["dataset_id", "feature"], "full_outer")
    differs = ~(F.col("dtype").eqNullSafe(F.col("m_dtype")) & F.col("shape").eqNullSafe(F.col("m_shape")) & F.col("names").eqNullSafe(F.col("m_names")))
    bad = met.where(differs).select("dataset_id", F.concat(F.lit("feature "), "feature").alias("problem"))
    m = datasets.where(F.col("dataset_id") == main).select(F.col("fps").alias("m_fps"), F.col("robot_type").alias("m_robot"))
    d = datasets.where(F.col("dataset_id") != main).crossJoin(m)
    rate = d.where(F.abs(F.col("fps") - F.col("m_fps")) > 1e-9).select("dataset_id", F.lit("frame rate").alias("problem"))
    robot = d.where("robot_type <> '' and m_robot <> '' and robot_type <> m_robot").select("dataset_id", F.lit("robot type").alias("problem"))
    return bad.union(rate).union(robot)


def assert_merge_compatible(features: DataFrame, datasets: DataFrame, main: str) -> None:
    """G2."""
    found = merge_conflicts(features, datasets, main).limit(20).collect()
    if found:
        raise ValueError("cannot be appended: " + "; ".join(f"{r[0]}: {r[1]}" for r in found))


def append_datasets(frames: DataFrame, order: DataFrame, into: str) -> DataFrame:
    """All datasets of ``frames`` as one named ``into``, by dataset_order, then episode; episodes and the global index are
    numbered through. G1."""
    e = episode_lengths(frames).join(order, "dataset_id")
    # datasets, a row each, are summed in order; episodes only within their dataset
    d = e.groupBy("dataset_id", "dataset_order").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("rows"))
    through = Window.orderBy("dataset_order", "dataset_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("dataset_id", F.coalesce(F.sum("n").over(through), F.lit(0)).alias("__n"), F.coalesce(F.sum("rows").over(through), F.lit(0)).alias("__rows"))
    w = Window.partitionBy("dataset_id").orderBy("episode_index")
    new = (F.col("__n") + F.row_number().over(w) - 1).cast("long").alias("__new")
    e = e.join(d, "dataset_id").select(*EPISODE, new, (F.col("__rows") + F.sum("length").over(w) - F.col("length")).alias("__first"))
    f = renumber_frames(frames).join(e, EPISODE)
    f = f.withColumn("index", F.col("__first") + F.col("pos")).withColumn("orig_dataset_id", F.col("dataset_id")).withColumn("orig_episode_index", F.col("episode_index"))
    return f.withColumn("dataset_id", F.lit(into)).withColumn("episode_index", F.col("__new")).drop("__new", "__first")


def find_junctions(frames: DataFrame, gone: DataFrame) -> DataFrame:
    """(episode, left, right, n_between): kept frames that become neighbours once ``gone`` goes. W13."""
    kept = frames.select(*EPISODE, "pos").join(gone.select(*EPISODE, "pos"), [*EPISODE, "pos"], "left_anti")
    nxt = F.lead("pos").over(Window.partitionBy(*EPISODE).orderBy("pos"))
    return kept.select(*EPISODE, F.col("pos").alias("left"), nxt.alias("right")).where("right - left > 1").withColumn("n_between", F.col("right") - F.col("left") - 1)


def refresh_totals(frames: DataFrame, tasks: DataFrame) -> DataFrame:
    """C13."""
    t = tasks.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total_tasks"))
    f = frames.groupBy("dataset_id").agg(F.count_distinct("episode_index").alias("total_episodes"), F.count(F.lit(1)).alias("total_frames"))
    return f.join(t, "dataset_id", "left").na.fill(0, ["total_tasks"])


# --- fields ----------------------------------------------------------------------------------------------------------


def rename_report(columns: list[str], renames: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(old, new, result) of renames one after the other: applied, or why not. C1."""
    have, out = list(columns), []
    for old, new in renames:
        if old == new:
            result = "same name"
        elif old not in have:
            result = "no such field"
        elif old in RESERVED:
            result = "reserved"
        elif new in have:
            result = "target exists"
        else:
            have[have.index(old)], result = new, "applied"
        out.append((old, new, result))
    return out


def rename_fields(df: DataFrame, renames: list[tuple[str, str]]) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """C1, C7: the frame without the old names, and the report."""
    report = rename_report(df.columns, renames)
    for old, new, result in report:
        if result == "applied":
            df = df.withColumnRenamed(old, new)
    return df, report


def add_field(df: DataFrame, name: str, dtype: str, default: float | str | list) -> DataFrame:
    """A field with one value in all rows; a list makes a vector. C2."""
    if name in df.columns:
        raise ValueError(f"field {name} exists")
    if isinstance(default, list):
        return df.withColumn(name, F.array(*[F.lit(x) for x in default]).cast(f"array<{dtype}>"))
    return df.withColumn(name, F.lit(default).cast(dtype))


def drop_fields(df: DataFrame, names: list[str], protected: bool = False) -> DataFrame:
    """C3: reserved fields never go, state and action only with consent."""
    held = [n for n in names if n in RESERVED or (n in PROTECTED and not protected)]
    if held:
        raise ValueError(f"cannot be dropped: {', '.join(held)}")
    return df.drop(*names)


def assign_field(df: DataFrame, target: str, value: Column, episodes: list[int] | None = None) -> DataFrame:
    """A new value for the rows of the given episodes, or all. C4."""
    new = value.cast(df.schema[target].dataType)
    return df.withColumn(target, new if episodes is None else F.when(F.col("episode_index").isin(*episodes), new).otherwise(F.col(target)))


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}


def _built(node: ast.expr, x: Column, ieee: bool) -> Column:
    """Column of an arithmetic expression of numbers and the field; anything else is an error."""
    match node:
        case ast.Constant(value=bool()):
            pass
        case ast.Constant(value=int() | float() as number):
            return F.lit(float(number))
        case ast.Name():
            return x
        case ast.UnaryOp(op=ast.USub() | ast.UAdd(), operand=inner):
            return -_built(inner, x, ieee) if isinstance(node.op, ast.USub) else _built(inner, x, ieee)
        case ast.BinOp(left=left, op=ast.Div(), right=right):
            a, b = _built(left, x, ieee), _built(right, x, ieee)
            if not ieee:
                return F.try_divide(a, b)
            at_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
            return F.when(b != 0, F.try_divide(a, b)).when(b == 0, at_zero)
        case ast.BinOp(left=left, op=op, right=right) if type(op) in _OPERATORS:
            return _OPERATORS[type(op)](_built(left, x, ieee), _built(right, x, ieee))
    raise ValueError(f"not arithmetic of numbers and the field: {ast.unparse(node)}")


def assign_expression(df: DataFrame, source: str, expression: str, ieee: bool = False) -> Column:
    """Value of an arithmetic expression (+ - * / and brackets) over the field, which any name stands for, or over each of
    its entries. Division by zero gives null, or with ``ieee`` infinity or NaN. C5."""
    try:
        tree = ast.parse(expression.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"cannot be read: {expression}") from e
    value = lambda x: _built(tree, x.cast("double"), ieee)
    if dict(df.dtypes)[source].startswith("array"):
        return F.transform(F.col(f"`{source}`"), value)
    return value(F.col(f"`{source}`"))


def rename_axes(features: DataFrame, feature: str, names: list[str]) -> DataFrame:
    """New axis names of one feature, as many as its last dimension. C6."""
    new = F.array(*[F.lit(n) for n in names])
    fits = (F.col("feature") == feature) & (F.element_at("shape", -1) == len(names))
    return features.withColumn("names", F.when(fits, new).otherwise(F.col("names")))


def preview(before: DataFrame, after: DataFrame, field: str, rows: int = 3) -> DataFrame:
    """First values of a field before and after an edit. C7, T7."""
    side = lambda df, name: df.orderBy(*EPISODE, "pos").select(*EPISODE, "pos", F.col(field).alias(name)).limit(rows)
    return side(before, "before").join(side(after, "after"), [*EPISODE, "pos"])
