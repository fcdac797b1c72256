"""Random graphs and event streams whose draws are digests of ids, so every task and every rerun agrees."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from .order import with_position


def _tested_pairs(spark: SparkSession, n: int) -> DataFrame:
    """u < v below n: each u lists its own partners; u and n - 1 - u share a row, so rows are equally long."""
    half = spark.range((n + 1) // 2).repartition(spark.sparkContext.defaultParallelism * 4)
    both = half.select(F.explode(F.array_distinct(F.array(F.col("id"), F.lit(n - 1) - F.col("id")))).alias("u"))
    return both.where(F.col("u") < n - 1).select("u", F.explode(F.sequence(F.col("u") + 1, F.lit(n - 1).cast("long"))).alias("v"))


def planted_partition(spark: SparkSession, groups: int, size: int, p: float, q: float, seed: int = 3) -> DataFrame:
    """u, v: edges inside a group of ``size`` vertices with chance p, between groups with chance q."""
    same = F.floor(F.col("u") / size) == F.floor(F.col("v") / size)
    return _tested_pairs(spark, groups * size).where(expr.uniform(seed, F.col("u"), F.col("v")) < F.when(same, p).otherwise(q))


def _step(value: Column, ends: Sequence[float]) -> Column:
    """The number of ends at or below the value."""
    return sum((F.when(value >= F.lit(e), 1).otherwise(0) for e in ends), F.lit(0))


def block_model(spark: SparkSession, sizes: Sequence[int], probs: Sequence[Sequence[float]], seed: int = 3) -> DataFrame:
    """u, v: vertices are numbered block by block; probs[a][b] is the chance of an edge between blocks a and b."""
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes) - 1)]
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in probs])
    chance = table[_step(F.col("u"), ends)][_step(F.col("v"), ends)]
    return _tested_pairs(spark, sum(sizes)).where(expr.uniform(seed, F.col("u"), F.col("v")) < chance)


def block_stream(spark: SparkSession, n: int, shares: Sequence[float], p: Sequence[Sequence[float]], seed: int = 5) -> DataFrame:
    """seq, src, dest, src_block, dest_block: vertex src arrives and is tested against all before it.

    A vertex's block comes from the cumulated shares; events are in the order of (src, dest).
    """
    ends = [sum(shares[: k + 1]) for k in range(len(shares) - 1)]
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in p])
    block = lambda c: _step(expr.uniform(seed, F.lit("block"), F.col(c)), ends)
    pairs = _tested_pairs(spark, n).select(F.col("v").alias("src"), F.col("u").alias("dest"))
    pairs = pairs.withColumns({"src_block": block("src"), "dest_block": block("dest")})
    kept = pairs.where(expr.uniform(seed, F.col("src"), F.col("dest")) < table[F.col("src_block")][F.col("dest_block")])
    return with_position(kept.withColumn("at", F.col("src") * n + F.col("dest")), "at", "seq").drop("at")


def preferential_attachment(spark: SparkSession, n: int, seed: int = 11) -> DataFrame:
    """src, dest: each vertex from 1 on links to an earlier one with a chance in proportion to its degree.

    Edge i has ends 2i (its source) and 2i + 1. The target copies a uniformly chosen earlier end, so it's found from
    digests alone by following odd ends down; no vertex waits for another.
    """
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(62)),
        F.col("id") * 2 + 1,
        lambda at, _: F.when(at % 2 == 1, F.floor(expr.uniform(seed, at) * (at - 1)).cast("long")).otherwise(at),
    )
    return spark.range(1, n).select(F.col("id").alias("src"), F.floor(end / 2).cast("long").alias("dest"))


def forest_fire(n: int, p: float, seed: int = 13) -> Iterator[tuple[int, int, int]]:
    """(seq, src, dest) of n arriving vertices; each links to an ambassador and to what its fire reaches.

    A fire goes from a reached vertex to a share p of its neighbours, rounded down. It depends on all before it, so
    this is a plain generator that feeds a stream, not a plan.
    """
    rng, near, seq = random.Random(seed), {0: []}, 0
    for new in range(1, n):
        burnt, front = set(), [rng.randrange(new)]
        while front:
            at = front.pop()
            if at not in burnt:
                burnt.add(at)
                front += rng.sample(near[at], int(p * len(near[at])))
        near[new] = sorted(burnt)
        for old in near[new]:
            near[old].append(new)
            yield seq, new, old
            seq += 1
