"""Embeddings: all-pairs top-k, merging, centroids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr


def merge_mean(emb: DataFrame, key: str = "vertex", vec: str = "vec", divisor: int | None = None) -> DataFrame:
    """Element-wise mean of the vectors of a key (or their sum over ``divisor``), as exploded partial sums."""
    parts = emb.select(key, F.posexplode(vec).alias("at", "x")).groupBy(key, "at").agg((F.avg("x") if divisor is None else F.sum("x") / divisor).alias("x"))
    return parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("p")).select(key, F.transform("p", lambda s: s.x).alias(vec))


#: Vectors of a block; blocks meet two at a time in one task.
BLOCK_ROWS = 2000


def _block_pairs(emb: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """x, y, side, id, vec: both sides of every pair of blocks, each pair once.

    The sides are emb and ``queries`` (1), or emb with itself: then block pairs x <= y, and y's rows have side 1.
    """
    blocks = max(1, -(-emb.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    own = emb.select("id", F.col("vec").cast("array<double>").alias("vec"), block.alias("b"))
    if queries is None:
        left = own.select(F.col("b").alias("x"), F.explode(F.sequence("b", F.lit(blocks - 1))).alias("y"), F.lit(0).alias("side"), "id", "vec")
        right = own.select(F.explode(F.sequence(F.lit(0), "b")).alias("x"), F.col("b").alias("y"), F.lit(1).alias("side"), "id", "vec").where("x < y")
        return left.unionByName(right)
    asking = max(1, -(-queries.count() // BLOCK_ROWS))
    mine = F.pmod(F.xxhash64("id"), F.lit(asking)).cast("int")
    left = own.select(F.col("b").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("y"), F.lit(0).alias("side"), "id", "vec")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("x"), mine.alias("y"), F.lit(1).alias("side"), "id", F.col("vec").cast("array<double>").alias("vec"))
    return left.unionByName(right)


def _near(a: np.ndarray, b: np.ndarray, k: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, squared distance) of at least the k closest pairs where ``other`` is true, with all their ties."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    d[~other] = np.inf
    flat = d.ravel()
    edge = np.partition(flat, min(k, flat.size) - 1)[min(k, flat.size) - 1]
    i, j = np.nonzero((d <= edge + 1e-9 * (1 + abs(edge))) & (d < np.inf))
    return i, j, ((a[i] - b[j]) ** 2).sum(1)


def closest_pairs(emb: DataFrame, k: int) -> DataFrame:
    """The k closest pairs i < j by squared distance, ties to smaller ids.

    Blocks of vectors meet two at a time; each pair of blocks gives its own k closest pairs and all their ties.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group.side == 0], group[group.side == 1]
        right = right if len(right) else left
        i, j = left.id.to_numpy(), right.id.to_numpy()
        if not len(i) or not len(j):
            return pd.DataFrame({"i": [], "j": [], "d": []})
        same = group.x.iloc[0] == group.y.iloc[0]
        other = i[:, None] < j[None, :] if same else i[:, None] != j[None, :]
        r, c, d = _near(np.stack(left.vec.to_numpy()), np.stack(right.vec.to_numpy()), k, other)
        return pd.DataFrame({"i": np.minimum(i[r], j[c]), "j": np.maximum(i[r], j[c]), "d": d})

    return _block_pairs(emb).groupBy("x", "y").applyInPandas(run, "i long, j long, d double").orderBy("d", "i", "j").limit(k)


def nearest_other(emb: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query (id, vec) its closest other vector, ties to the smaller id."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group.side == 0].sort_values("id"), group[group.side == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"i": [], "j": [], "d": []})
        a, b, ids = np.stack(right.vec.to_numpy()), np.stack(left.vec.to_numpy()), left.id.to_numpy()
        out = []
        for q, x in zip(right.id.to_numpy(), a, strict=True):
            d = ((b - x) ** 2).sum(1)
            d[ids == q] = np.inf
            at = int(d.argmin())
            if d[at] < np.inf:
                out.append((q, ids[at], d[at]))
        return pd.DataFrame(out, columns=["i", "j", "d"])

    found = _block_pairs(emb, queries).groupBy("x", "y").applyInPandas(run, "i long, j long, d double")
    return found.groupBy("i").agg(F.min(F.struct("d", "j")).alias("m")).select("i", F.col("m.j").alias("j"), F.round("m.d", 6).alias("d"))


#: Centroid values that go to every task; more are dealt in blocks.
BROADCAST_VALUES = 4_000_000


def centroids_or_none(emb: DataFrame, key: str = "part", vec: str = "vec") -> DataFrame:
    """key, vec: the mean of a key's vectors; null where it is all but zero."""
    return merge_mean(emb, key, vec).select(key, F.when(~expr.all_close_to_zero(F.col(vec)), F.col(vec)).alias(vec))


def nearest_centroid(emb: DataFrame, centroids: DataFrame, k: int = 1, most: int = BROADCAST_VALUES) -> DataFrame:
    """The k best parts of each vector by cosine; centroids(part, c): one row per part.

    Blocks of BLOCK_ROWS centroids each meet all vectors and leave k for each. Up to ``most`` values in all, the blocks
    are broadcast; beyond that, vectors and blocks meet by a shuffle.
    """
    size = centroids.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("c")), F.lit(0)).alias("values")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ROWS))
    held = centroids.groupBy(F.pmod(F.xxhash64("part"), F.lit(blocks)).cast("int").alias("b")).agg(F.collect_list(F.struct("part", "c")).alias("own"))
    asked = emb.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = asked.join(F.broadcast(held) if size["values"] <= most else held.hint("shuffle_hash"), "b")
    scored = F.transform("own", lambda s: F.struct((-F.round(expr.cosine(F.col("vec"), s.c), 6)).alias("less"), s.part.alias("part")))
    near = met.select("id", F.explode(F.slice(F.array_sort(scored), 1, k)).alias("m")).select("id", "m.part", (-F.col("m.less")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "part"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "part", F.round(F.col("score") + 0.0, 6).alias("score"), F.col("rank").cast("int").alias("rank"))
