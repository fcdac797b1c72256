"""Embeddings that follow a stream, walks that stop by entropy, and the partitioner by embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, placement, vectors, walks
from . import partitioners

EMB = "vertex long, part int, vec array<double>"


def continued(paths: DataFrame, emb: DataFrame, dim: int = 32, window: int = 5, negative: int = 5, epochs: int = 3, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """vertex, part, vec: each part's vectors, trained on from where they are by paths(part, start, walk, path).

    Vertices without a vector begin with a small random one; vertices on no path keep theirs. A part has to fit into a task.
    """
    told = paths.select("part", "start", "walk", "path", F.lit(None).cast("long").alias("vertex"), F.lit(None).cast("array<double>").alias("vec"))
    held = emb.select("part", F.lit(None).cast("long").alias("start"), F.lit(None).cast("int").alias("walk"), F.lit(None).cast("array<bigint>").alias("path"), "vertex", "vec")

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        old = {int(v): np.asarray(x) for v, x in own.loc[own["vec"].notna(), ["vertex", "vec"]].itertuples(index=False)}
        new = own[own["path"].notna()].sort_values(["start", "walk"])
        if len(new):
            names, w = walks.train([np.asarray(x) for x in new["path"]], dim, window, negative, epochs, alpha, seed, old)
            old |= dict(zip(names.tolist(), w, strict=True))
        return pd.DataFrame({"vertex": list(old), "part": own["part"].iloc[0], "vec": list(old.values())})

    return told.unionByName(held).groupBy("part").applyInPandas(fit, EMB)


def update(edges: DataFrame, emb: DataFrame, buffer: DataFrame, retrain: int = 30, n_walks: int = 5, length: int = 10, p: float = 0.5, q: float = 0.5, seed: int = 7, **training) -> tuple[DataFrame, DataFrame]:
    """(edges, embeddings) after a buffer of events.

    Below ``retrain`` vertices all are embedded anew; else walks start from the buffer's vertices only and training goes on
    from the vectors there are.
    """
    edges = partitioners.with_deletions(edges, buffer)
    small = graph.vertices(edges).limit(retrain).count() < retrain
    starts = graph.vertices(edges) if small else partitioners.active(buffer).select(F.col("vertex").alias("id")).join(graph.vertices(edges), "id", "left_semi")
    paths = walks.random_walks(edges, starts, n_walks, length, p, q, seed).withColumn("part", F.lit(0))
    return edges, continued(paths, emb.where("false") if small else emb, seed=seed, **training)


def follow(stream: DataFrame, folder: str, dim: int = 32, **options):
    """A running query that keeps one version of edges and embeddings for each batch in ``folder``, which executors share.

    A batch that is run again reads the version before it and overwrites its own.
    """

    def version(name: str, k: int) -> str:
        return f"{folder.rstrip('/')}/{name}/batch-{k}"

    def batch(buffer: DataFrame, k: int) -> None:
        spark = buffer.sparkSession
        old = [spark.read.schema(kinds).parquet(version(name, k - 1)) if k else spark.createDataFrame([], kinds) for name, kinds in (("edges", "u long, v long"), ("emb", EMB))]
        edges, emb = update(*old, buffer, dim=dim, **options)
        edges.write.mode("overwrite").parquet(version("edges", k))
        emb.write.mode("overwrite").parquet(version("emb", k))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder.rstrip('/')}/progress").trigger(availableNow=True).start()


def entropies(path: np.ndarray) -> np.ndarray:
    """The entropy in bits of the vertices of each prefix of a walk."""
    _, code = np.unique(path, return_inverse=True)
    count = np.zeros(code.max() + 1)
    total, out = 0.0, np.zeros(len(path))  # total: sum of c * log2(c)
    for k, v in enumerate(code.tolist(), 1):
        c = count[v]
        total += (c + 1) * np.log2(c + 1) - (c * np.log2(c) if c else 0.0)
        count[v] += 1
        out[k - 1] = np.log2(k) - total / k
    return out


def entropy_stop(path: np.ndarray, least: float = 0.995, shortest: int = 5) -> int:
    """Vertices of a walk until its entropy no longer grows in line with its length.

    The squared correlation of entropy and length over the prefix falls below ``least``.
    """
    n = np.arange(1, len(path) + 1, dtype=float)
    h = entropies(path)
    mean_n, mean_h = np.cumsum(n) / n, np.cumsum(h) / n
    cov = np.cumsum(n * h) / n - mean_n * mean_h
    var_n, var_h = np.cumsum(n * n) / n - mean_n**2, np.cumsum(h * h) / n - mean_h**2
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = np.where((var_n > 1e-12) & (var_h > 1e-12), cov**2 / (var_n * var_h), 0.0)
    stop = np.flatnonzero((r2 < least) & (n >= shortest))
    return int(stop[0]) + 1 if len(stop) else len(path)


def entropy_walks(edges: DataFrame, starts: DataFrame, n_walks: int, longest: int = 40, least: float = 0.995, shortest: int = 5, seed: int = 7) -> DataFrame:
    """start, walk, path: walks of unequal length; each stops when it brings little new."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            yield own.assign(path=[x[: entropy_stop(np.asarray(x), least, shortest)] for x in own["path"]])

    found = walks.random_walks(edges, starts, n_walks, longest, seed=seed)
    return found.mapInPandas(cut, found.schema)


def entropy_embed(edges: DataFrame, n_walks: int = 10, longest: int = 40, seed: int = 7, **training) -> DataFrame:
    paths = entropy_walks(edges, graph.vertices(edges), n_walks, longest, seed=seed)
    return walks.embed(paths.withColumn("part", F.lit(0)), seed=seed, **training)


#: Embedding models by name: f(edges, **options) -> vertex, part, vec.
MODELS = {
    "node2vec": lambda edges, **o: walks.node2vec(edges, graph.vertices(edges).select(F.col("id").alias("vertex"), F.lit(0).alias("part")), **o),
    "entropy": entropy_embed,
}


def semantic_push(edges: DataFrame, emb: DataFrame, assign: DataFrame, buffer: DataFrame, parts: int, k: int = 1, mu: float = 0.1, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, embeddings, assignment) after a buffer: its vertices go to the parts of the nearest centroids.

    Centroids are means of the embeddings of the parts' vertices; a part without vertices has none and fills up.
    """
    edges, emb = update(edges, emb, buffer, **options)
    sizes = partitioners.part_sizes(assign, parts)
    centroids = vectors.merge_mean(assign.join(emb.select("vertex", "vec"), "vertex").select("part", "vec"), "part").select("part", F.col("vec").alias("c"))
    moving = partitioners.active(buffer)
    asked = moving.join(emb, "vertex").select(F.lit(0).alias("buffer"), F.col("vertex").alias("id"), "vec")
    placed = placement.fill_nearest(asked, sizes.join(centroids, "part", "left"), k, mu).select("vertex", "part")
    return edges, emb, assign.join(moving, "vertex", "left_anti").select("vertex", "part").unionByName(placed)
