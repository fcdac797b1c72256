"""Link prediction: negative pairs, pair features, a trained predictor, ranking among corrupted tails."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from . import graph
from .order import with_position


def hold_out(edges: DataFrame, share: float, seed: int = 23) -> tuple[DataFrame, DataFrame]:
    """The edges that stay and those held out, about a ``share``, by a digest of both ends."""
    out = expr.uniform(seed, F.col("u"), F.col("v")) < share
    return edges.where(~out), edges.where(out)


def negative_pairs(edges: DataFrame, per_vertex: int, seed: int = 17) -> DataFrame:
    """u, v: pairs that aren't edges, from ``per_vertex`` draws for each vertex; loops and edges among them go."""
    at = with_position(graph.vertices(edges), "id")
    n = at.count()
    drawn = at.select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(per_vertex - 1))).alias("s"))
    drawn = drawn.select("a", F.floor(expr.uniform(seed, F.col("a"), F.col("s")) * n).cast("long").alias("pos"))
    pairs = drawn.join(at.select("pos", F.col("id").alias("b")), "pos").where("a <> b")
    return graph.canonical(pairs, "a", "b").join(edges, ["u", "v"], "left_anti")


def with_vectors(pairs: DataFrame, emb: DataFrame, dim: int) -> DataFrame:
    """pairs(u, v, ...) with the vectors a and b of both ends; zeros where there is none."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    one, two = (emb.select(F.col("id").alias(e), F.col("vec").alias(x)) for e, x in (("u", "a"), ("v", "b")))
    out = pairs.join(one, "u", "left").join(two, "v", "left")
    return out.withColumns({"a": F.coalesce("a", zeros), "b": F.coalesce("b", zeros)})


def pair_features(pairs: DataFrame, kind: str = "product") -> DataFrame:
    """pairs with ``features`` from a and b: product, mean, absolute, squared, concat or outer."""
    a, b = F.col("a"), F.col("b")
    kinds = {
        "product": F.zip_with(a, b, lambda x, y: x * y),
        "mean": F.zip_with(a, b, lambda x, y: (x + y) / 2),
        "absolute": F.zip_with(a, b, lambda x, y: F.abs(x - y)),
        "squared": F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
        "concat": F.concat(a, b),
        "outer": F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y))),
    }
    if kind not in kinds:
        raise ValueError(f"unknown kind {kind}")
    return pairs.withColumn("features", kinds[kind])


def train(labelled: DataFrame, emb: DataFrame, dim: int, kind: str = "product", rounds: int = 50):
    """A logistic model of labelled(u, v, label); its summary's objectiveHistory has the loss of each round."""
    rows = pair_features(with_vectors(labelled, emb, dim), kind).select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(maxIter=rounds, regParam=1e-4, standardization=False).fit(rows)


def predict(pairs: DataFrame, emb: DataFrame, model, dim: int, kind: str = "product") -> DataFrame:
    """u, v, probability, linked (probability over 0.5)."""
    rows = pair_features(with_vectors(pairs.select("u", "v"), emb, dim), kind).withColumn("features", array_to_vector("features"))
    p = vector_to_array("probability")[1]
    return model.transform(rows).select("u", "v", p.alias("probability"), (p > 0.5).alias("linked"))


def log_loss(labelled: DataFrame, predicted: DataFrame) -> float | None:
    """Mean logistic loss of predicted(u, v, probability) against labelled(u, v, label); None without rows."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("probability")))
    loss = F.when(F.col("label") == 1, -F.log(p)).otherwise(-F.log(1 - p))
    return labelled.join(predicted, ["u", "v"]).agg(F.avg(loss)).first()[0]


def best_of(labelled: DataFrame, emb: DataFrame, dim: int, tries: int = 3, share: float = 0.2, kind: str = "product", seed: int = 29):
    """The model with the least validation loss among ``tries`` digest splits, and that loss."""
    best = None
    for k in range(tries):
        fit, check = hold_out(labelled, share, seed + k)
        model = train(fit, emb, dim, kind)
        loss = log_loss(check, predict(check, emb, model, dim, kind))
        if loss is not None and (best is None or loss < best[1]):
            best = (model, loss)
    if best is None:
        raise ValueError("no split has validation pairs")
    return best


def ensemble(pairs: DataFrame, predictions: list[DataFrame]) -> DataFrame:
    """u, v, probability, linked: the mean over the predictions that know a pair; 0 and false where none does."""
    rows = pairs.select("u", "v", F.lit(None).cast("double").alias("probability"))
    for one in predictions:
        rows = rows.unionByName(one.join(pairs.select("u", "v"), ["u", "v"], "left_semi").select("u", "v", "probability"))
    p = F.coalesce(F.avg("probability"), F.lit(0.0))
    return rows.groupBy("u", "v").agg(p.alias("probability")).withColumn("linked", F.col("probability") > 0.5)


def rank_among_corrupted(emb: DataFrame, edges: DataFrame, positives: DataFrame, draws: int, dim: int, seed: int = 19) -> DataFrame:
    """u, v, rank: 1 + the corrupted tails that score higher by dot product, of ``draws`` drawn tails that u has no edge to."""
    at = with_position(graph.vertices(edges.unionByName(positives.select("u", "v"))), "id")
    n = at.count()
    drawn = positives.select("u", "v", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("s"))
    drawn = drawn.withColumn("pos", F.floor(expr.uniform(seed, F.col("u"), F.col("v"), F.col("s")) * n).cast("long"))
    tails = drawn.join(at.select("pos", F.col("id").alias("t")), "pos")
    tails = tails.join(graph.symmetric(edges).select(F.col("src").alias("u"), F.col("dst").alias("t")), ["u", "t"], "left_anti")
    pairs = tails.select("u", F.col("v").alias("of"), F.col("t").alias("v")).unionByName(positives.select("u", F.col("v").alias("of"), F.lit(None).cast("long").alias("v")))
    pairs = pairs.withColumn("target", F.col("v").isNull()).withColumn("v", F.coalesce("v", "of"))
    scored = with_vectors(pairs, emb, dim).select("u", "of", "target", F.round(expr.dot(F.col("a"), F.col("b")), 6).alias("score"))
    goal = scored.where("target").select("u", "of", F.col("score").alias("goal"))
    ranked = goal.join(scored.where("not target"), ["u", "of"], "left").groupBy("u", "of")
    return ranked.agg((1 + F.count_if(F.col("score") > F.col("goal"))).alias("rank")).select("u", F.col("of").alias("v"), "rank")
