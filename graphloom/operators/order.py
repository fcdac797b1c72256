"""Positions in a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(df: DataFrame, key: str, name: str = "_range") -> DataFrame:
    """df with a range number that ascends with a numeric ``key``; the ranges are literals of the plan, between quantiles.

    A row finds its range by bisection.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(key, [k / n for k in range(1, n)], 0.01))) if n > 1 else []

    def find(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(key) < F.lit(cuts[middle]), find(low, middle)).otherwise(find(middle + 1, high))

    return df.withColumn(name, find(0, len(cuts)))


def with_position(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """df with its 0-based position in the order of a numeric, unique ``key``.

    Rows are numbered within their range and get the range's offset; only the sizes of the ranges are collected.
    """
    ranged = ranges(df, key)
    before, offsets = 0, {}
    for r in sorted(ranged.groupBy("_range").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_range"]):
        offsets[r["_range"]] = before
        before += r["n"]
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return ranged.withColumn(name, inside + _of_range(offsets, "long")).drop("_range")


def _of_range(values: dict, kind: str) -> Column:
    """The value of a row's range, null without one: a literal of the plan with an entry for each range."""
    held = F.array(*[F.lit(values.get(r)).cast(kind) for r in range(max(values, default=-1) + 1)]).cast(f"array<{kind}>")
    return F.get(held, F.col("_range"))


def with_next(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Rows that have a successor in the order of ``key``, with the successor's ``value``; one pass over the rows.

    The first row of each range, one for each, is what the last row of the range before it is followed by.
    """
    ranged = ranges(df, key)
    first = {r["_range"]: r["first"] for r in ranged.groupBy("_range").agg(F.min(F.struct(key, value)).alias("first")).collect()}
    after = sorted(first)
    edge = {r: first[s] for r, s in zip(after[:-1], after[1:], strict=True)}
    parts = [_of_range({r: x[c] for r, x in edge.items()}, df.schema[c].dataType.simpleString()).alias(c) for c in (key, value)]
    following = F.lead(F.struct(key, value)).over(Window.partitionBy("_range").orderBy(key))
    last = F.when(F.col("_range").isin(*edge) if edge else F.lit(False), F.struct(*parts))
    found = ranged.withColumn("_next", F.coalesce(following, last))
    return found.where("_next is not null").withColumn(name, F.col("_next")[value]).drop("_range", "_next")


def buffers(df: DataFrame, size: int, key: str) -> DataFrame:
    """Count-based tumbling buffers over the order; the last may be short."""
    return with_position(df, key).withColumn("buffer", F.floor(F.col("pos") / size).cast("long"))
