"""Summaries of sweeps, embeddings and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from . import quality
from .order import buffers


def mean_std(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Mean and population standard deviation."""
    return df.groupBy(*keys).agg(F.round(F.avg(metric), 6).alias("mean"), F.round(F.stddev_pop(metric), 6).alias("std"))


def data_profile(df: DataFrame, solver: str, calls: str, top: int) -> DataFrame:
    """solver, alpha = 0..top, share of its problems that took ``calls`` <= alpha."""
    # a count for each number of calls first, so that only those meet the alphas
    few = df.groupBy(solver, F.least(F.ceil(calls), F.lit(top + 1)).alias("calls")).agg(F.count("*").alias("n"))
    at = few.withColumn("alpha", F.explode(F.sequence(F.lit(0), F.lit(top)).cast("array<bigint>")))
    share = F.sum(F.when(F.col("calls") <= F.col("alpha"), F.col("n")).otherwise(0)) / F.sum("n")
    return at.groupBy(solver, "alpha").agg(F.round(share, 6).alias("share"))


def smoothed(df: DataFrame, at: str, value: str) -> DataFrame:
    """One row, an ordered series of at least two points: each inner point becomes the mean of its left neighbour, which is smoothed, itself and its right one."""
    series = df.agg(F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda s: s[value].cast("double")).alias("y"))

    def step(done: Column, k: Column) -> Column:
        y = F.element_at("y", k.cast("int"))
        inner = (k > 1) & (k < F.size("y"))
        return F.array_append(done, F.when(inner, (F.element_at(done, -1) + y + F.element_at("y", F.least(k + 1, F.size("y")).cast("int"))) / 3).otherwise(y))

    return series.select(F.aggregate(F.sequence(F.lit(1), F.size("y")), F.array().cast("array<double>"), step).alias("y"))


def best_of(df: DataFrame, keys: list[str], metric: str, kept: list[str]) -> DataFrame:
    """The row of the highest metric for each key; ties to the smallest of ``kept``."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(metric), *kept))
    return df.withColumn("_r", best).where("_r = 1").select(*keys, *kept, metric)


def top_models(df: DataFrame, keys: list[str], metric: str, name: str, n: int = 3) -> DataFrame:
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(metric), name))
    return df.withColumn("rank", best.cast("int")).where(F.col("rank") <= n).select(*keys, name, metric, "rank")


def better(candidate: Column, reference: Column, larger_is_better: bool) -> Column:
    return candidate > reference if larger_is_better else candidate < reference


def least_corrupt(edges: DataFrame, assigns: dict[str, DataFrame]) -> DataFrame:
    """name, corruption of the partitioning that loses least; none if all lose every edge. Ties to the first name."""
    found = None
    for name, assign in assigns.items():
        one = quality.corruption(edges, assign).select(F.lit(name).alias("name"), "corruption")
        found = one if found is None else found.unionByName(one)
    return found.where("corruption < 1").orderBy("corruption", "name").limit(1)


def dot_statistics(emb: DataFrame, pairs: DataFrame) -> DataFrame:
    """linked, n, mean, std of the dot products of pairs(i, j, linked)."""
    a = emb.select(F.col("id").alias("i"), F.col("vec").alias("a"))
    b = emb.select(F.col("id").alias("j"), F.col("vec").alias("b"))
    d = pairs.join(a, "i").join(b, "j").select("linked", expr.dot(F.col("a"), F.col("b")).alias("d"))
    return d.groupBy("linked").agg(F.count("*").alias("n"), F.round(F.avg("d"), 5).alias("mean"), F.round(F.stddev_pop("d"), 5).alias("std"))


def bounded_shuffle(events: DataFrame, window: int, key: str, seed: int = 7) -> DataFrame:
    """key, position of the emitted event: each window of events is put in the order of a digest, and times stay ordered.

    Result: the event's key and ``takes``, the key of the event whose time it takes.
    """
    b = buffers(events, window, key)
    times = b.select("buffer", F.col(key).alias("takes"), F.row_number().over(Window.partitionBy("buffer").orderBy(key)).alias("r"))
    drawn = b.select("buffer", key, F.row_number().over(Window.partitionBy("buffer").orderBy(expr.uniform(seed, F.col(key)), key)).alias("r"))
    return drawn.join(times, ["buffer", "r"]).select(key, "takes")


def merged_or_zeros(vertices: DataFrame, emb: DataFrame, dims: int) -> DataFrame:
    """vertices(id) with the mean of their embeddings(vertex, vec); zeros where there is none."""
    from .vectors import merge_mean

    mean = merge_mean(emb).select(F.col("vertex").alias("id"), "vec")
    return vertices.join(mean, "id", "left").select("id", F.coalesce("vec", F.array_repeat(F.lit(0.0), dims)).alias("vec"))


def fresh_rows(vertices: DataFrame, dims: int, seed: int = 7) -> DataFrame:
    """vertices(id) with first vectors, uniform in [-0.5, 0.5) / dims by digests."""
    return vertices.select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: (expr.uniform(seed, F.col("id"), k) - 0.5) / dims).alias("vec"))


def graph_statistics(vertices: DataFrame, edges: DataFrame, bins: int = 5, largest: int = 3) -> DataFrame:
    """statistic, value: sizes of the largest components, components, isolates, vertices of each degree below ``bins``, average clustering.

    vertices(id) has isolates too: each is a component, and counts as 0 in the average.
    """
    from . import graph
    from .stored import degrees_of

    deg = degrees_of(vertices, edges)
    sizes = graph.components(edges).groupBy("component").agg(F.count("*").alias("size")).select("size")
    alone = deg.where("degree = 0").select(F.lit(1).cast("long").alias("size"))
    top = sizes.orderBy(F.desc("size")).limit(largest).unionByName(alone.limit(largest))
    top = top.agg(F.slice(F.sort_array(F.collect_list("size"), False), 1, largest).alias("s")).select(F.posexplode("s").alias("k", "value"))
    top = top.select(F.concat(F.lit("component_"), F.col("k") + 1).alias("statistic"), F.col("value").cast("double").alias("value"))
    counts = deg.agg(F.count_if(F.col("degree") == 0).alias("isolates"), *[F.count_if(F.col("degree") == k).alias(f"degree_{k}") for k in range(bins)])
    counts = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in counts.columns])).alias("x")).select("x.*")
    number = sizes.unionByName(alone).agg(F.count("*").cast("double").alias("value")).select(F.lit("components").alias("statistic"), "value")
    mean = vertices.join(graph.clustering(edges), "id", "left").agg(F.round(F.avg(F.coalesce("clustering", F.lit(0.0))), 6).alias("value"))
    return top.unionByName(counts).unionByName(number).unionByName(mean.select(F.lit("average_clustering").alias("statistic"), "value"))


def with_overrides(base: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """base, with the values that ``overrides`` has for a key in place of its own; a null there keeps base's value."""
    other = overrides.select(key, *[F.col(c).alias(f"_{c}") for c in overrides.columns if c != key and c in base.columns])
    joined = base.join(other, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in other.columns else F.col(c) for c in base.columns])


def time_table(runs: DataFrame, keys: list[str], mode: str, seconds: str, serial, parallel) -> DataFrame:
    """keys, serial, parallel, speedup: mean times of two modes side by side; null where a mode has no run."""
    one, two = (F.avg(F.when(F.col(mode) == x, F.col(seconds))) for x in (serial, parallel))
    rows = runs.groupBy(*keys).agg(one.alias("serial"), two.alias("parallel"))
    return rows.select(*keys, F.round("serial", 6).alias("serial"), F.round("parallel", 6).alias("parallel"), F.round(F.try_divide("serial", "parallel"), 6).alias("speedup"))


def runs_summary(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, runs, and the mean and population deviation of each metric over the runs."""
    both = [f(m, n) for m in metrics for f, n in ((lambda m, n: F.round(F.avg(m), 6).alias(f"{m}_{n}"), "mean"), (lambda m, n: F.round(F.stddev_pop(m), 6).alias(f"{m}_{n}"), "std"))]
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), *both)
