"""Partition, reconstruction, ranking and clustering metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def inside(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """u, v, part for every part that holds both ends; assign(vertex, part) may list a vertex in several parts."""
    a = assign.select(F.col("vertex").alias("u"), "part")
    b = assign.select(F.col("vertex").alias("v"), F.col("part").alias("part_v"))
    return edges.join(a, "u").join(b, "v").where("part = part_v").select("u", "v", "part")


def edge_cut(edges: DataFrame, assign: DataFrame) -> DataFrame:
    cut = edges.join(inside(edges, assign).select("u", "v").distinct(), ["u", "v"], "left_anti")
    return edges.agg(F.count("*").alias("edges")).crossJoin(cut.agg(F.count("*").alias("cut"))).select("edges", "cut", F.round(F.col("cut") / F.col("edges"), 6).alias("fraction"))


def corruption(edges: DataFrame, assign: DataFrame, parity: bool = False) -> DataFrame:
    """1 - kept / edges; kept edges lie in a part (with ``parity``: in an odd number of parts)."""
    n = inside(edges, assign).groupBy("u", "v").agg(F.count("*").alias("n"))
    kept = n.where("n % 2 = 1" if parity else "n >= 1").agg(F.count("*").alias("kept"))
    return edges.agg(F.count("*").alias("edges")).crossJoin(kept).select(F.round(1 - F.col("kept") / F.col("edges"), 6).alias("corruption"))


def balance(assign: DataFrame, parts: int) -> DataFrame:
    """Mean of |size - mean| / mean over all part ids; missing ids have size 0."""
    ids = assign.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    sizes = ids.join(assign.groupBy("part").agg(F.count("*").alias("size")), "part", "left").select("part", F.coalesce("size", F.lit(0)).alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    return sizes.crossJoin(F.broadcast(mean)).agg(F.round(F.avg(F.abs(F.col("size") - F.col("mean")) / F.col("mean")), 6).alias("balance"))


def repartitionings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Half of the memberships that changed, of vertices known before."""
    known = old.select("vertex").distinct()
    o, n = old.withColumn("o", F.lit(1)), new.withColumn("n", F.lit(1))
    moved = o.join(n, ["vertex", "part"], "full_outer").where("o is null or n is null").join(known, "vertex", "left_semi")
    return moved.agg(F.floor(F.count("*") / 2).alias("repartitionings"))


def block_quality(edges: DataFrame, truth: DataFrame, assign: DataFrame) -> DataFrame:
    """lost_intra: intra-community edges whose ends are parted; separated_inter: inter-community edges that are parted."""
    t1, t2 = truth.select(F.col("vertex").alias("u"), F.col("community").alias("cu")), truth.select(F.col("vertex").alias("v"), F.col("community").alias("cv"))
    p1, p2 = assign.select(F.col("vertex").alias("u"), F.col("part").alias("pu")), assign.select(F.col("vertex").alias("v"), F.col("part").alias("pv"))
    e = edges.join(t1, "u").join(t2, "v").join(p1, "u").join(p2, "v")
    intra, parted = F.col("cu") == F.col("cv"), F.col("pu") != F.col("pv")
    ratio = lambda x, y: F.round(F.coalesce(F.sum(F.when(x & y, 1).otherwise(0)) / F.nullif(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)), F.lit(0.0)), 6)
    return e.agg(ratio(intra, parted).alias("lost_intra"), ratio(~intra, parted).alias("separated_inter"))


def reconstruction_f1(truth: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Recall averaged over all vertices of the truth, precision over vertices with a rebuilt neighbour."""
    t, r = graph.symmetric(truth), graph.symmetric(rebuilt)
    hit = t.join(r, ["src", "dst"]).groupBy("src").agg(F.count("*").alias("hit"))
    nt, nr = t.groupBy("src").agg(F.count("*").alias("nt")), r.groupBy("src").agg(F.count("*").alias("nr"))
    per = nt.join(nr, "src", "full_outer").join(hit, "src", "left").select("nt", "nr", F.coalesce("hit", F.lit(0)).alias("hit"))
    m = per.agg(F.coalesce(F.avg(F.when(F.col("nt").isNotNull(), F.col("hit") / F.col("nt"))), F.lit(0.0)).alias("r"), F.coalesce(F.avg(F.when(F.col("nr").isNotNull(), F.col("hit") / F.col("nr"))), F.lit(0.0)).alias("p"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return m.select(F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    pairs = lambda c: c.cast("double") * (c - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    nij = cells.agg(F.sum(pairs(F.col("n"))).alias("x"), F.sum("n").alias("n"))
    ai = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("ai"))
    bj = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("bj"))
    e = F.col("ai") * F.col("bj") / pairs(F.col("n"))
    return nij.crossJoin(ai).crossJoin(bj).select(F.round((F.col("x") - e) / ((F.col("ai") + F.col("bj")) / 2 - e), 6).alias("ari"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    c = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    safe = lambda x, y: F.round(F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0)), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def rank_metrics(ranks: DataFrame, ks=(1, 10)) -> DataFrame:
    return ranks.agg(F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), *[F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hits_{k}") for k in ks])


def performance_profile(df: DataFrame, problem: str, solver: str, metric: str, points: int = 100) -> DataFrame:
    """For log-spaced tau: the share of problems that a solver handles within tau of the best."""
    ratio = df.withColumn("ratio", F.col(metric) / (F.min(metric).over(Window.partitionBy(problem)) + 1e-9))
    tau = df.sparkSession.range(points).select(F.col("id").alias("step"), F.pow(F.lit(10.0), 3.0 * F.col("id") / (points - 1)).alias("tau"))
    return ratio.crossJoin(F.broadcast(tau)).groupBy(solver, "step").agg(F.round(F.avg(F.when(F.col("ratio") <= F.col("tau"), 1.0).otherwise(0.0)), 6).alias("share"))
