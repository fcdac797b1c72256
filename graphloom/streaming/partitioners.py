"""Online partitioners chosen by name; each turns an assignment and a buffer of events into the next assignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import graph
from . import online


def active(buffer: DataFrame) -> DataFrame:
    """Vertices of a buffer's ADD events."""
    return buffer.where("op = 'ADD'").select(F.explode(F.array("src", "dest")).alias("vertex")).distinct()


def catch_all(vertices: DataFrame, parts: int) -> DataFrame:
    """Every vertex in every part."""
    return vertices.select("vertex", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))


def by_distribution(vertices: DataFrame, weights: DataFrame, seed: int = 7) -> DataFrame:
    """vertex, part: one part of weights(part, weight), which has a row for each part, drawn by the vertex's digest.

    Parts of weight 0 are never drawn; if all weights are 0, all parts are equally likely.
    """
    total = Window.partitionBy(F.lit(0))
    flat = weights.withColumn("w", F.when(F.sum("weight").over(total) > 0, F.col("weight").cast("double")).otherwise(1.0))
    running = total.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # a row for each part
    ends = flat.where("w > 0").select("part", (F.sum("w").over(running) / F.sum("w").over(total)).alias("end"))
    bounds = ends.agg(F.sort_array(F.collect_list(F.struct("end", "part"))).alias("bounds"))
    after = F.filter("bounds", lambda b: b.end > F.col("u"))
    drawn = vertices.withColumn("u", expr.uniform(seed, F.col("vertex"))).crossJoin(F.broadcast(bounds))
    return drawn.select("vertex", F.when(F.size(after) > 0, F.element_at(after, 1)).otherwise(F.element_at("bounds", -1))["part"].alias("part"))


def part_sizes(assign: DataFrame, parts: int) -> DataFrame:
    """part, size, 0 for empty parts."""
    ids = assign.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    return ids.join(assign.groupBy("part").agg(F.count("*").alias("size")), "part", "left").select("part", F.coalesce("size", F.lit(0)).alias("size"))


def uniform_weights(buffer: DataFrame, assign: DataFrame, parts: int) -> DataFrame:
    return part_sizes(assign, parts).select("part", F.lit(1.0).alias("weight"))


def size_weights(buffer: DataFrame, assign: DataFrame, parts: int) -> DataFrame:
    """Fuller parts are less likely: the largest size plus one less the own."""
    return part_sizes(assign, parts).select("part", (F.max("size").over(Window.partitionBy(F.lit(0))) + 1 - F.col("size")).cast("double").alias("weight"))


def degree_weights(buffer: DataFrame, assign: DataFrame, parts: int) -> DataFrame:
    """Parts that hold more ends of the buffer's edges are likelier."""
    ends = buffer.where("op = 'ADD'").select(F.explode(F.array("src", "dest")).alias("vertex"))
    held = ends.join(assign, "vertex").groupBy("part").agg(F.count("*").alias("n"))
    return part_sizes(assign, parts).join(held, "part", "left").select("part", F.coalesce("n", F.lit(0)).cast("double").alias("weight"))


def random_sticky(buffer: DataFrame, assign: DataFrame, parts: int, weights: Callable[[DataFrame, DataFrame, int], DataFrame] = uniform_weights, seed: int = 7) -> DataFrame:
    """Vertices get a part when they are first seen and keep it."""
    fresh = active(buffer).join(assign.select("vertex").distinct(), "vertex", "left_anti")
    return assign.select("vertex", "part").unionByName(by_distribution(fresh, weights(buffer, assign, parts), seed))


def inside_events(events: DataFrame, assign: DataFrame) -> DataFrame:
    """Events with each part that holds both ends; assign may list a vertex in several parts."""
    a = assign.select(F.col("vertex").alias("src"), "part")
    b = assign.select(F.col("vertex").alias("dest"), F.col("part").alias("other"))
    return events.join(a, "src").join(b, "dest").where("part = other").drop("other")


def sampled_events(events: DataFrame, chance: Column, seed: int = 7) -> DataFrame:
    """Events kept with a chance, by the digest of their seq."""
    return events.where(expr.uniform(seed, F.col("seq")) <= chance)


def degree_chance(events: DataFrame) -> DataFrame:
    """events with ``chance``: the sum of its ends' degrees in the events over twice the largest degree."""
    n = graph.degree(graph.canonical(events.where("op = 'ADD'")))
    top = n.agg(F.max("degree").alias("top"))  # one row
    a, b = (n.select(F.col("id").alias(end), F.col("degree").alias(f"d_{end}")) for end in ("src", "dest"))
    both = events.join(a, "src", "left").join(b, "dest", "left").crossJoin(F.broadcast(top))
    chance = (F.coalesce("d_src", F.lit(0)) + F.coalesce("d_dest", F.lit(0))) / (2.0 * F.col("top"))
    return both.withColumn("chance", F.coalesce(chance, F.lit(0.0))).drop("d_src", "d_dest", "top")


def smoothed_capacity(sizes: list[float], slack: float = 0.05, alpha: float = 0.5) -> list[float]:
    """Capacity after each buffer: alpha * (1 + slack) * mean size + (1 - alpha) * the one before."""
    out, before = [], None
    for mean in sizes:
        now = (1 + slack) * mean
        before = now if before is None else alpha * now + (1 - alpha) * before
        out.append(before)
    return out


def most_common_neighbour(buffer: DataFrame, assign: DataFrame, parts: int, mu: float = 0.5, slack: float = 0.05, replicas: int = 1, known: DataFrame | None = None, decay: float = 0.0) -> DataFrame:
    """``online.push``; with ``known``, earlier events with their buffer, neighbours count by age."""
    if known is None:
        return online.push(buffer, assign, parts, mu, slack, replicas)
    moving = active(buffer)
    weight = online.decayed_neighbours(known, assign, decay).join(moving, "vertex", "left_semi")
    sizes = part_sizes(assign, parts)
    mean = sizes.agg(((1 + slack) * F.avg("size")).alias("cap"))
    fines = sizes.crossJoin(F.broadcast(mean)).select("part", (F.lit(mu) * F.greatest(F.lit(0.0), F.col("size") - F.col("cap"))).alias("fine"))
    scores = moving.crossJoin(F.broadcast(fines)).join(weight, ["vertex", "part"], "left").select("vertex", "part", (F.coalesce("weight", F.lit(0.0)) - F.col("fine")).alias("score"))
    chosen = online.choose(scores, replicas).select("vertex", "part")
    return assign.join(moving, "vertex", "left_anti").select("vertex", "part").unionByName(chosen)


def with_deletions(edges: DataFrame, buffer: DataFrame) -> DataFrame:
    """edges(u, v) after a buffer: the last event of a pair says whether it is there."""
    pair = buffer.where("src <> dest").select(F.least("src", "dest").alias("u"), F.greatest("src", "dest").alias("v"), "seq", "op")
    last = pair.groupBy("u", "v").agg(F.max_by("op", "seq").alias("op"))
    return edges.join(last, ["u", "v"], "left_anti").select("u", "v").unionByName(last.where("op = 'ADD'").select("u", "v"))


#: Partitioners by name: f(buffer, assign, parts, **options) -> assign.
PARTITIONERS: dict[str, Callable[..., DataFrame]] = {
    "catch_all": lambda buffer, assign, parts, **_: assign.select("vertex", "part").unionByName(catch_all(active(buffer), parts)).distinct(),
    "random": random_sticky,
    "random_degree": lambda buffer, assign, parts, **o: random_sticky(buffer, assign, parts, degree_weights, **o),
    "random_size": lambda buffer, assign, parts, **o: random_sticky(buffer, assign, parts, size_weights, **o),
    "most_common_neighbour": most_common_neighbour,
    "decayed_neighbour": lambda buffer, assign, parts, decay=0.1, **o: most_common_neighbour(buffer, assign, parts, decay=decay, **o),
}


def partitioner(name: str) -> Callable[..., DataFrame]:
    if name not in PARTITIONERS:
        raise ValueError(f"no partitioner {name}; there are {', '.join(sorted(PARTITIONERS))}")
    return PARTITIONERS[name]


def profile(events: DataFrame, size: int) -> DataFrame:
    """One row: events, buffers, unique vertices of a stream cut into buffers of ``size`` events."""
    ends = events.select(F.explode(F.array("src", "dest")).alias("vertex")).agg(F.countDistinct("vertex").alias("vertices"))
    n = events.agg(F.count("*").alias("events"), F.ceil(F.count("*") / size).cast("long").alias("buffers"))
    return n.crossJoin(ends)
