"""Statistics by episode and axis, their merge, histograms and robust thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.operators.axes import EPISODE, clean_vector, finite

QUANTILES = {"q01": 0.01, "q10": 0.10, "q50": 0.50, "q90": 0.90, "q99": 0.99}
#: Groups by which episodes are dealt out and merged first, and most axes that are aggregated side by side.
GROUPS, WIDE = 4096, 32
METRIC_QUANTILES = {"q01": 0.01, "q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90, "q99": 0.99}


def spread_quantiles(df: DataFrame, quantiles: dict[str, float], keys: list[str], value: str, exact: bool, extra: list[Column]) -> DataFrame:
    """Aggregates ``extra`` and the quantiles of ``value`` by ``keys``. ``exact`` interpolates; else they are sketched,
    which groups of very many rows need."""
    share = F.array(*[F.lit(q) for q in quantiles.values()])
    q = F.percentile(value, share) if exact else F.percentile_approx(value, [*quantiles.values()], 10_000)
    out = df.groupBy(*keys).agg(*extra, q.alias("__q"))
    return out.select(*[c for c in out.columns if c != "__q"], *[F.get("__q", F.lit(i)).alias(n) for i, n in enumerate(quantiles)])


def episode_stats(axis: DataFrame, exact: bool = True) -> DataFrame:
    """Count, min, max, mean, population deviation and five quantiles of each episode, source and axis. A1."""
    extra = [
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
    ]
    return spread_quantiles(axis, QUANTILES, ["dataset_id", "source", "episode_index", "axis_index"], "value", exact, extra)


def _group() -> Column:
    return F.pmod(F.xxhash64(*EPISODE), F.lit(GROUPS)).alias("__group")


def wide_episode_stats(frames: DataFrame, widths: dict[str, int], scalars: list[str] = [], quantiles: bool = True) -> DataFrame:
    """``episode_stats`` of vectors whose lengths are known (rows of another length are left out) and of scalar columns. Frames
    are shuffled once and a row each, not a row for each axis, as the axes are aggregated side by side. Its column __group
    lets ``merge_stats`` go on without another shuffle. A1."""
    axes, used = [], []
    for k, (source, width) in enumerate(widths.items()):
        whole = F.size(f"__v{k}") == width
        axes += [(source, i, F.when(whole, F.get(f"__v{k}", F.lit(i))), F.count_if(whole)) for i in range(width)]
        used.append(clean_vector(F.col(source)).alias(f"__v{k}"))
    for k, source in enumerate(scalars):
        axes.append((source, 0, F.col(f"__s{k}"), F.count(F.lit(1))))
        used.append(F.col(f"`{source}`").cast("double").alias(f"__s{k}"))
    dealt = frames.select(*EPISODE, _group(), *used).repartition("__group")
    dealt = dealt.select(*EPISODE, "__group", *[x[2].alias(f"__x{k}") for k, x in enumerate(axes)], *[c for c in dealt.columns if c.startswith("__v")])
    of = {"n": F.count, "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}
    if quantiles:
        of["q"] = lambda c: F.percentile(c, F.array(*[F.lit(q) for q in QUANTILES.values()]))
    aggregates = [f(f"__x{k}").alias(f"{name}{k}") for k in range(len(axes)) for name, f in of.items()]
    out = dealt.groupBy(*EPISODE, "__group").agg(*aggregates, *[x[3].alias(f"rows{k}") for k, x in enumerate(axes)])
    row = lambda k: F.struct(F.lit(axes[k][0]).alias("source"), F.lit(axes[k][1]).alias("axis_index"), F.col(f"rows{k}").alias("rows"), *[F.col(f"{name}{k}").alias(name) for name in of])
    out = out.select(*EPISODE, "__group", F.inline(F.array(*[row(k) for k in range(len(axes))]))).where("rows > 0")
    return out.select("dataset_id", "source", "episode_index", "axis_index", "__group", *[c for c in of if c != "q"], *([F.get("q", F.lit(i)).alias(n) for i, n in enumerate(QUANTILES)] if quantiles else []))


def scalar_axes(frames: DataFrame, columns: list[str]) -> DataFrame:
    """Scalar columns of frames as axes of their own sources, for ``episode_stats``."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]))
    return frames.select(*EPISODE, "pos", stacked.alias("s")).select(*EPISODE, "s.source", "pos", F.lit(0).alias("axis_index"), "s.value")


def merge_stats(stats: DataFrame) -> DataFrame:
    """Statistics of a dataset from those of its episodes: weighted mean, pooled deviation, and quantiles as weighted
    means of the episodes' quantiles, where they are there. Episodes are merged in groups first, so that no task has all of
    an axis. A2."""
    keys = ["dataset_id", "source", "axis_index"]
    grouped = stats if "__group" in stats.columns else stats.withColumn("__group", _group())
    # sorted by the group first: long strings that are all equal take most of a sort's time
    return _merged(_merged(grouped, ["__group", *reversed(keys)]), keys)


def _merged(stats: DataFrame, keys: list[str]) -> DataFrame:
    whole = Window.partitionBy(*keys)
    centre = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    s = stats.where("n > 0").withColumn("__m", centre)
    weighted = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c)
    pooled = F.sqrt(F.sum(F.col("n") * (F.col("std") ** 2 + (F.col("mean") - F.col("__m")) ** 2)) / F.sum("n"))
    return s.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), weighted("mean"), pooled.alias("std"), *[weighted(q) for q in QUANTILES if q in stats.columns]
    )


def axis_metrics(axis: DataFrame, exact: bool = True) -> DataFrame:
    """Metrics of each source and axis over all episodes, finite values only. A4."""
    keys = ["dataset_id", "source", "axis_index"]
    extra = [
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), (F.max("value") - F.min("value")).alias("range"),
    ]
    return spread_quantiles(axis.withColumn("value", finite(F.col("value"))), METRIC_QUANTILES, keys, "value", exact, extra)


def sigma_coverage(axis: DataFrame) -> DataFrame:
    """Shares of values within one and two deviations of the mean. A5."""
    keys = ["dataset_id", "source", "axis_index"]
    axis = axis.select(*keys, finite(F.col("value")).alias("value")).where("value is not null")
    m = axis.groupBy(*keys).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    inside = lambda k: F.avg(F.when(F.abs(F.col("value") - F.col("m")) <= k * F.col("s"), 1.0).otherwise(0.0))
    return axis.join(m, keys).groupBy(*keys).agg(inside(1).alias("within_1"), inside(2).alias("within_2"))


def histogram(axis: DataFrame, bins: int = 20) -> DataFrame:
    """Counts in equal bins, the last one closed: least(bins, greatest(8, floor(sqrt(n)))) of them; a series without
    spread has one bin half a unit around it. Empty bins are there. A6."""
    keys = ["dataset_id", "source", "axis_index"]
    axis = axis.select(*keys, finite(F.col("value")).alias("value")).where("value is not null")
    lim = axis.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
    flat = F.col("lo") == F.col("hi")
    lim = lim.withColumn("k", F.when(flat, 1).otherwise(F.least(F.lit(bins), F.greatest(F.lit(8), F.floor(F.sqrt("n"))))).cast("int"))
    lim = lim.withColumn("lo", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))).withColumn("hi", F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")))
    place = F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("k"))), F.col("k") - 1)
    counted = axis.join(lim, keys).withColumn("bin", place.cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    every = lim.select(*keys, "lo", "hi", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / F.col("k")
    return every.join(counted, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("lo") + F.col("bin") * step).alias("left"), (F.col("lo") + (F.col("bin") + 1) * step).alias("right"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def anomaly_threshold(series: DataFrame, keys: list[str], value: str = "value", mad_scale: float = 6.0, std_scale: float = 3.0, exact: bool = True) -> DataFrame:
    """(keys, threshold) over absolute values: the larger of median + mad_scale * MAD and mean + std_scale * deviation,
    of those above 0; else the maximum. Where not ``exact``, medians are sketched to a rank within 1 in 10,000, which
    series of very many rows need. A16."""
    middle = F.median if exact else lambda c: F.percentile_approx(c, 0.5, 10_000)
    s = series.select(*keys, F.abs(finite(F.col(value))).alias("v")).where("v is not null")
    first = s.groupBy(*keys).agg(middle("v").alias("med"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max("v").alias("most"))
    mad = s.join(first.select(*keys, "med"), keys).groupBy(*keys).agg(middle(F.abs(F.col("v") - F.col("med"))).alias("mad"))
    robust, usual = F.col("med") + mad_scale * F.col("mad"), F.col("mean") + std_scale * F.col("std")
    best = F.greatest(F.when(robust > 0, robust), F.when(usual > 0, usual))
    return first.join(mad, keys).select(*keys, F.coalesce(best, "most").alias("threshold"))


def acceleration_threshold(axis: DataFrame, k_sigma: float = 3.0) -> DataFrame:
    """(dataset, source, episode, axis, accel_threshold): median + k * 1.4826 * MAD of absolute second differences, at
    least 1e-6; none below three frames. A17."""
    keys = ["dataset_id", "source", "episode_index", "axis_index"]
    w = Window.partitionBy(*keys).orderBy("pos")
    d2 = F.abs(F.col("value") - 2 * F.lag("value", 1).over(w) + F.lag("value", 2).over(w))
    s = axis.select(*keys, d2.alias("v")).where("v is not null")
    med = s.groupBy(*keys).agg(F.median("v").alias("med"))
    mad = s.join(med, keys).groupBy(*keys, "med").agg(F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))
    return mad.select(*keys, F.greatest(F.lit(1e-6), F.col("med") + k_sigma * 1.4826 * F.col("mad")).alias("accel_threshold"))


def episode_lengths(frames: DataFrame, episodes: DataFrame | None = None) -> DataFrame:
    """Frames of each episode; one without frames keeps the length that its metadata gives. A30, J3."""
    counted = frames.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("length"))
    if episodes is None:
        return counted
    declared = episodes.select(*EPISODE, F.col("length").alias("declared"))
    return declared.join(counted, EPISODE, "full_outer").select(*EPISODE, F.coalesce("length", "declared").alias("length"))


def length_iqr_bounds(lengths: DataFrame, k: float = 1.5) -> DataFrame:
    """Quartiles of episode lengths by dataset and the bounds k quartile distances outside. A18."""
    q = lengths.groupBy("dataset_id").agg(
        F.percentile("length", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min("length").alias("shortest"), F.max("length").alias("longest"),
    )
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(2))
    return q.select(
        "dataset_id", q1.alias("q1"), F.get("q", F.lit(1)).alias("median"), q3.alias("q3"), (q3 - q1).alias("iqr"),
        (q1 - k * (q3 - q1)).alias("lower"), (q3 + k * (q3 - q1)).alias("upper"), "shortest", "longest",
    )


def length_outliers(lengths: DataFrame, k: float = 1.5) -> DataFrame:
    """Episodes outside the bounds, with the reason. T2."""
    b = length_iqr_bounds(lengths, k)
    out = lengths.join(b.select("dataset_id", "lower", "upper"), "dataset_id").where("length < lower or length > upper")
    reason = F.when(F.col("length") < F.col("lower"), "too short").otherwise("too long")
    return out.select(*EPISODE, "length", reason.alias("reason"))


def flatten_stats(stats: DataFrame, metrics: list[str]) -> DataFrame:
    """(dataset, episode, name, value): one row per feature, axis and metric, named as stats/<feature>/<metric>. C8."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    s = stats.select(*EPISODE, "source", "axis_index", pairs.alias("p"))
    return s.select(*EPISODE, F.concat(F.lit("stats/"), "source", F.lit("/"), "p.metric").alias("name"), "axis_index", "p.value")


def unflatten_stats(flat: DataFrame, metrics: list[str]) -> DataFrame:
    """Inverse of ``flatten_stats``. C8."""
    parts = F.split("name", "/")
    s = flat.select(*EPISODE, F.get(parts, F.lit(1)).alias("source"), "axis_index", F.get(parts, F.lit(2)).alias("metric"), "value")
    return s.groupBy(*EPISODE, "source", "axis_index").pivot("metric", metrics).agg(F.first("value"))


def recompute_stats(frames: DataFrame, vectors: list[str], scalars: list[str], widths: dict[str, int] | None = None, quantiles: bool = True) -> DataFrame:
    """Merged statistics of all declared numeric columns. ``widths``: declared lengths of all vectors; without them each is
    the length of the dataset's first row, which takes another pass. ``quantiles``: whether they are needed. A3."""
    from trajspark.operators.axes import explode_axes

    if widths is not None and sum(widths[v] for v in vectors) + len(scalars) <= WIDE:
        return merge_stats(wide_episode_stats(frames, {v: widths[v] for v in vectors}, scalars, quantiles))
    parts = [explode_axes(frames, v).select(*EPISODE, "source", "pos", "axis_index", "value") for v in vectors]
    parts += [scalar_axes(frames, scalars)] if scalars else []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return merge_stats(episode_stats(out))
