"""Static partitions: random, local-fitness communities, packing into bins."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from . import graph
from .order import with_position

#: Communities above this share of a mean bin are packed one by one.
FINE = 64


def random_parts(vertices: DataFrame, parts: int, seed: int = 1) -> DataFrame:
    """vertex, part: parts of equal size (by one) in the order of a 60-bit digest."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))
    at = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return with_position(vertices.withColumn("at", at), "at").select(F.col("id").alias("vertex"), F.pmod("pos", F.lit(parts)).cast("int").alias("part"))


def pack_bins(communities: DataFrame, bins: int, seed: int = 1) -> DataFrame:
    """community, bin from communities(community, size).

    The large ones, of which there are fewer than FINE * bins, go heaviest first into the lightest bin. Each of the
    others is less than 1 / FINE of a mean bin; a digest deals them over the room that is left.
    """
    spark = communities.sparkSession
    total = communities.agg(F.sum("size")).first()[0] or 0
    least = total / (FINE * bins)
    large = sorted(communities.where(F.col("size") > least).collect(), key=lambda r: (-r["size"], r["community"]))
    heap, of = [(0, b) for b in range(bins)], []
    for r in large:
        load, b = heapq.heappop(heap)
        of.append((r["community"], b))
        heapq.heappush(heap, (load + r["size"], b))
    loads = {b: load for load, b in heap}
    room = [max(0.0, total / bins - loads[b]) for b in range(bins)]
    ends, so_far = [], 0.0
    for x in room[:-1]:
        so_far += x
        ends.append(so_far)
    at = expr.uniform(seed, F.col("community")) * sum(room)
    bin_of = sum((F.when(at >= F.lit(e), 1).otherwise(0) for e in ends), F.lit(0)).cast("int")
    kind = communities.schema["community"].dataType.simpleString()
    packed = spark.createDataFrame(of, f"community {kind}, bin int")
    return communities.where(F.col("size") <= least).select("community", bin_of.alias("bin")).unionByName(packed)


def grow(near: dict[int, list[int]], seed: int, alpha: float) -> set[int]:
    """The natural community of a vertex for the fitness inner / (inner + outer) ** alpha."""
    inside, inner, total = {seed}, 0, len(near[seed])

    def fitness(i: int, t: int) -> float:
        return i / t**alpha if t else 0.0

    def links(v: int) -> int:
        return sum(w in inside for w in near[v])

    rim = {w: 1 for w in near[seed]}
    while rim:
        now = fitness(inner, total)
        gain, best = max(((fitness(inner + 2 * k, total + len(near[v])) - now, -v) for v, k in rim.items()))
        if gain < 0:
            break
        v = -best
        inner, total = inner + 2 * rim[v], total + len(near[v])
        inside.add(v)
        while len(inside) > 1:  # members that now hold the fitness down leave
            now = fitness(inner, total)
            worst = max((fitness(inner - 2 * links(m), total - len(near[m])) - now, m) for m in inside)
            if worst[0] <= 1e-12:
                break
            inner, total = inner - 2 * links(worst[1]), total - len(near[worst[1]])
            inside.discard(worst[1])
        if v not in inside:
            break
        rim = {}
        for m in inside:
            for w in near[m]:
                if w not in inside:
                    rim[w] = rim.get(w, 0) + 1
    return inside


def local_fitness(edges: DataFrame, alpha: float = 1.0, threshold: float = 0.0, most: int | None = None) -> DataFrame:
    """vertex, community: communities grown from seeds until a share ``threshold`` of a component is left over.

    Communities may overlap and are named by their seed; seeds are taken in ascending order. At most ``most`` grow in
    a component. Vertices left over join one of its communities by a digest, or stay alone where there is none. Growth
    is sequential, so a connected component has to fit into one task.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for u, v in zip(rows["u"].tolist(), rows["v"].tolist(), strict=True):
            near.setdefault(u, []).append(v)
            near.setdefault(v, []).append(u)
        left, out, named = set(near), [], []
        for seed in sorted(near):
            if len(left) <= threshold * len(near) or (most is not None and len(named) >= most):
                break
            if seed in left:
                own = grow(near, seed, alpha)
                left -= own
                left.discard(seed)
                named.append(seed)
                out += [(v, seed) for v in sorted(own)]
        for v in sorted(left):
            out.append((v, named[(v * 2654435761 >> 8) % len(named)] if named else v))
        return pd.DataFrame(out, columns=["vertex", "community"])

    parts = graph.components(edges).select(F.col("id").alias("u"), "component")
    return edges.join(parts, "u").groupBy("component").applyInPandas(run, "vertex long, community long")


def partition(edges: DataFrame, bins: int, **growth) -> DataFrame:
    """vertex, part: local-fitness communities packed into ``bins`` parts."""
    found = local_fitness(edges, **growth)
    packed = pack_bins(found.groupBy("community").agg(F.count("*").alias("size")), bins)
    return found.join(packed, "community").select("vertex", F.col("bin").alias("part")).distinct()
