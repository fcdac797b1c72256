"""Random walks as one equi-join per step, and skip-gram embeddings of them.

Neighbours are numbered within their vertex, so a hop is a join on (vertex, number): walkers on a hub spread over its
numbers, and no neighbour list is ever held whole. Each directed edge knows the number of its reverse, which gives the
return weight of a biased walk in closed form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from . import graph


def hops(edges: DataFrame) -> DataFrame:
    """src, idx, dst, back, ndeg: the idx-th neighbour of src, the number of src among its neighbours, its degree."""
    adj = graph.symmetric(edges)
    own = Window.partitionBy("src")
    h = adj.select("src", "dst", (F.row_number().over(own.orderBy("dst")) - 1).cast("long").alias("idx"), F.count("*").over(own).alias("deg"))
    back = h.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("idx").alias("back"), F.col("deg").alias("ndeg"))
    return h.join(back, ["src", "dst"]).select("src", "idx", "dst", "back", "ndeg")


def random_walks(edges: DataFrame, starts: DataFrame, n_walks: int, length: int, p: float = 1.0, q: float = 1.0, seed: int = 7, every: int = 8) -> DataFrame:
    """start, walk, path: ``length`` vertices, the start included.

    A hop back to the previous vertex weighs 1/p, any other neighbour 1/q. A vertex without neighbours is repeated.
    Each draw is a digest of (seed, start, walk, step), so a task that runs again walks alike.
    """
    table = hops(edges)
    saved = bool(edges.sparkSession.sparkContext.getCheckpointDir())
    if saved:
        table = table.checkpoint()
    deg = graph.degree(edges).select(F.col("id").alias("cur"), F.col("degree").alias("deg"))
    at = starts.select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))).alias("walk"), F.col("id").alias("cur"))
    at = at.join(deg, "cur", "left").select("start", "walk", "cur", F.coalesce("deg", F.lit(0)).alias("deg"), F.lit(None).cast("long").alias("back"), F.array("cur").alias("path"))
    other, home = 1.0 / q, 1.0 / p
    for step in range(length - 1):
        x, back = expr.uniform(seed, F.col("start"), F.col("walk"), F.lit(step)), F.col("back")
        r = x * ((F.col("deg") - 1) * other + home)
        biased = F.when(r < back * other, F.floor(r / other)).when(r < back * other + home, back).otherwise(back + 1 + F.floor((r - back * other - home) / other))
        i = F.least(F.when(back.isNull(), F.floor(x * F.col("deg"))).otherwise(biased), F.col("deg") - 1)
        drawn = at.withColumn("i", i.cast("long")).drop("back")
        met = drawn.join(table, (F.col("cur") == F.col("src")) & (F.col("i") == F.col("idx")), "left")
        to = F.coalesce("dst", "cur")
        at = met.select("start", "walk", to.alias("cur"), F.coalesce("ndeg", "deg").alias("deg"), "back", F.concat("path", F.array(to)).alias("path"))
        if saved and (step + 1) % every == 0:
            at = at.checkpoint()
    return at.select("start", "walk", "path")


def train(paths: list[np.ndarray], dim: int, window: int, negative: int, epochs: int, alpha: float, seed: int, initial: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary and vectors of skip-gram with negative sampling; ``initial`` vectors are carried on."""
    rng = np.random.default_rng(seed)
    vocabulary, count = np.unique(np.concatenate(paths), return_counts=True)
    n = len(vocabulary)
    w, c = rng.uniform(-0.5 / dim, 0.5 / dim, (n, dim)), np.zeros((n, dim))
    for k, v in enumerate(vocabulary.tolist()):
        if initial and v in initial:
            w[k] = initial[v]
    noise = np.cumsum(count**0.75)
    noise /= noise[-1]
    coded = [np.searchsorted(vocabulary, x) for x in paths]
    near = [(x[:-d], x[d:]) for x in coded for d in range(1, window + 1) if len(x) > d]
    if not near:
        return vocabulary, w
    a, b = (np.concatenate([x[k] for x in near]) for k in (0, 1))
    a, b = np.r_[a, b], np.r_[b, a]
    size, done, total = int(min(512, max(16, n))), 0, len(a) * epochs
    for _ in range(epochs):
        order = rng.permutation(len(a))
        for at in range(0, len(order), size):
            own = order[at : at + size]
            rate = alpha * max(1 - done / total, 1e-4)
            target = np.c_[b[own], np.searchsorted(noise, rng.random((len(own), negative)))]
            label = np.zeros(target.shape)
            label[:, 0] = 1
            h, out = w[a[own]], c[target]
            g = rate * (label - 1 / (1 + np.exp(-np.einsum("ij,ikj->ik", h, out))))
            np.add.at(w, a[own], np.einsum("ik,ikj->ij", g, out))
            np.add.at(c, target, g[:, :, None] * h[:, None, :])
            done += len(own)
    return vocabulary, w


def embed(walks: DataFrame, dim: int = 32, window: int = 5, negative: int = 5, epochs: int = 3, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """vertex, part, vec from walks(part, path): each part is trained by itself in one task, so a part has to fit there."""

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["start", "walk"])
        v, w = train([np.asarray(x) for x in own["path"]], dim, window, negative, epochs, alpha, seed)
        return pd.DataFrame({"vertex": v, "part": own["part"].iloc[0], "vec": list(w)})

    return walks.select("part", "start", "walk", "path").groupBy("part").applyInPandas(fit, "vertex long, part int, vec array<double>")


def node2vec(edges: DataFrame, assign: DataFrame, n_walks: int = 10, length: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 7, **training) -> DataFrame:
    """Per-part embeddings: walks stay on edges inside a part. assign(vertex, part) has one part for each vertex."""
    one, two = (assign.select(F.col("vertex").alias(e), F.col("part").alias(f"p{e}")) for e in ("u", "v"))
    own = edges.join(one, "u").join(two, "v").where("pu = pv").select("u", "v")
    walks = random_walks(own, assign.select(F.col("vertex").alias("id")), n_walks, length, p, q, seed)
    return embed(walks.join(assign, walks.start == assign.vertex), seed=seed, **training)
