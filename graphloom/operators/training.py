"""Pairs, negatives and baselines for embedding and link models; scores of partitioners and sweeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from . import graph, quality
from .order import with_position


def skipgrams(paths: DataFrame, window: int, path: str = "path") -> DataFrame:
    """target, context, n: how often each ordered pair stands within ``window`` places of a walk."""
    placed = F.transform(path, lambda x, k: F.struct(x.alias("target"), F.slice(path, F.greatest(k - window, F.lit(0)) + 1, F.least(k, F.lit(window))).alias("left"), F.slice(path, k + 2, window).alias("right")))
    near = paths.select(F.explode(placed).alias("p")).select("p.target", F.explode(F.concat("p.left", "p.right")).alias("context"))
    return near.groupBy("target", "context").agg(F.count("*").alias("n"))


def log_uniform(u: Column, n: int) -> Column:
    """0 .. n - 1, less often the larger: the inverse of the log-uniform distribution."""
    return F.least(F.floor(F.exp(u * F.log(F.lit(n + 1.0)))) - 1, F.lit(n - 1)).cast("long")


def with_negatives(pairs: DataFrame, n_codes: int, negatives: int, tries: int = 4, seed: int = 7) -> DataFrame:
    """pairs(target, context) of codes with up to ``negatives`` distinct log-uniform codes, none of them the context.

    ``tries`` draws are made for each negative wanted, so almost always there are as many as wanted.
    """
    drawn = F.transform(F.sequence(F.lit(0), F.lit(negatives * tries - 1)), lambda k: log_uniform(expr.uniform(seed, F.col("target"), F.col("context"), k), n_codes))
    return pairs.withColumn("negatives", F.slice(F.array_distinct(F.filter(drawn, lambda x: x != F.col("context"))), 1, negatives))


def negative_edges(vertices: DataFrame, edges: DataFrame, n: int, seed: int = 7, spare: float = 2.0) -> DataFrame:
    """Exactly n vertex pairs that aren't edges, by digests; raises if rounds of ever more draws don't give as many."""
    at = with_position(vertices.select("id"), "id").select("pos", "id")
    size = at.count()
    for rounds in range(6):
        many = int(n * spare * 4**rounds) + 16
        drawn = edges.sparkSession.range(many).select("id", *(F.floor(expr.uniform(seed + k, F.col("id")) * size).cast("long").alias(f"p{k}") for k in (0, 1)))
        ends = drawn.join(at.select(F.col("pos").alias("p0"), F.col("id").alias("a")), "p0").join(at.select(F.col("pos").alias("p1"), F.col("id").alias("b")), "p1")
        pairs = ends.where("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min(ends.id).alias("first"))
        found = pairs.join(edges, ["u", "v"], "left_anti").orderBy("first").limit(n).select("u", "v")
        if found.count() == n:
            return found
    raise ValueError(f"no {n} pairs without an edge")


def weighted_hops(adj: DataFrame, seed: int = 7) -> DataFrame:
    """vertex, next: a neighbour of each vertex, drawn by the weights of adj(src, dst, weight) with the vertex's digest.

    The neighbour of the least exponential key wins, so no neighbour list is held whole.
    """
    key = -F.log(1.0 - expr.uniform(seed, F.col("src"), F.col("dst"))) / F.col("weight")
    return adj.where("weight > 0").groupBy(F.col("src").alias("vertex")).agg(F.min(F.struct(key.alias("k"), "dst")).alias("m")).select("vertex", F.col("m.dst").alias("next"))


def zipped(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows side by side by their places in the orders of two unique keys."""
    a, b = with_position(left, left_key, "_a"), with_position(right, right_key, "_b")
    return a.join(b, F.col("_a") == F.col("_b")).drop("_a", "_b")


def aligned(one: DataFrame, two: DataFrame, key: str = "vertex") -> DataFrame:
    """key, one, two: the vectors of two runs, of vertices that both have."""
    return one.select(key, F.col("vec").alias("one")).join(two.select(key, F.col("vec").alias("two")), key)


def packed_labels(edges: DataFrame, parts: int, rounds: int = 5) -> DataFrame:
    """vertex, part: label-propagation communities packed into parts, the largest first into the emptiest."""
    from .communities import pack_bins

    found = graph.label_rounds(edges, rounds)
    bins = pack_bins(found.groupBy(F.col("label").alias("community")).agg(F.count("*").alias("size")), parts)
    return found.join(bins, found.label == bins.community).select(F.col("id").alias("vertex"), F.col("bin").alias("part"))


def lost_per_buffer(buffered: DataFrame, assign: DataFrame) -> DataFrame:
    """buffer, events, lost, fraction: events whose ends share no part; assign(vertex, part) may list several parts."""
    a, b = assign.select(F.col("vertex").alias("src"), "part"), assign.select(F.col("vertex").alias("dest"), F.col("part").alias("other"))
    kept = buffered.join(a, "src").join(b, "dest").where("part = other").groupBy("buffer").agg(F.countDistinct("seq").alias("kept"))
    n = buffered.groupBy("buffer").agg(F.count("*").alias("events")).join(kept, "buffer", "left")
    lost = F.col("events") - F.coalesce("kept", F.lit(0))
    return n.select("buffer", "events", lost.alias("lost"), F.round(lost / F.col("events"), 6).alias("fraction"))


def corruption_slope(edges: DataFrame, partitioner: Callable[[DataFrame, int], DataFrame], most: int) -> DataFrame:
    """One row: the slope of the corruption of partitioner(edges, k) against k - 1, for k = 1 .. most."""
    rows = None
    for k in range(1, most + 1):
        one = quality.corruption(edges, partitioner(edges, k)).select(F.lit(float(k - 1)).alias("x"), F.col("corruption").cast("double").alias("y"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"))


def partitioning_score(edges: DataFrame, partitioner: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """score(edges, assign) of what a partitioner makes of the edges."""
    return score(edges, partitioner(edges))


def reduced(rows: DataFrame, metric: str, how: str = "sum") -> DataFrame:
    """One value of a sweep's rows: sum, avg, min or max."""
    return rows.agg(getattr(F, {"sum": "sum", "avg": "avg", "min": "min", "max": "max"}[how])(metric).alias(metric))


def constant_predictions(pairs: DataFrame, probability: float = 0.5) -> DataFrame:
    """u, v, probability, linked of a model that knows nothing."""
    return pairs.select("u", "v", F.lit(probability).alias("probability"), F.lit(probability > 0.5).alias("linked"))


def classifier(kind: str, seed: int = 7, **options):
    """An untrained classifier of (features, label) by name."""
    from pyspark.ml import classification

    kinds = {"logistic": classification.LogisticRegression, "forest": classification.RandomForestClassifier, "boosted": classification.GBTClassifier, "tree": classification.DecisionTreeClassifier, "bayes": classification.NaiveBayes, "svm": classification.LinearSVC}
    if kind not in kinds:
        raise ValueError(f"no classifier {kind}; there are {', '.join(sorted(kinds))}")
    return kinds[kind](**({"seed": seed} if kind in ("forest", "boosted", "tree") else {}), **options)


def seen_first(events: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A driver's short list of events so that each touches a vertex seen before, where one can; else the next in order."""
    left, seen, out = list(events), set(), []
    while left:
        at = next((k for k, (a, b) in enumerate(left) if a in seen or b in seen), 0)
        a, b = left.pop(at)
        seen |= {a, b}
        out.append((a, b))
    return out


def top_corrupt(edges: DataFrame, assign: DataFrame, n: int = 10) -> DataFrame:
    """The n vertices that lose the most of their edges: vertex, degree, lost."""
    kept = quality.inside(edges, assign).select("u", "v").distinct().withColumn("kept", F.lit(1))
    both = graph.symmetric(edges).join(graph.symmetric(kept).withColumn("kept", F.lit(1)), ["src", "dst"], "left")
    rows = both.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("degree"), F.count_if(F.col("kept").isNull()).alias("lost"))
    best = F.row_number().over(Window.orderBy(F.desc("lost"), "vertex"))
    return rows.orderBy(F.desc("lost"), "vertex").limit(n).withColumn("rank", best)
