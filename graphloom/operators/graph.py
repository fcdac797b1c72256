"""Graphs as edge tables: edges(u, v) with u < v; adj(src, dst) is the symmetric view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical(pairs: DataFrame, a: str = "src", b: str = "dest") -> DataFrame:
    """Distinct undirected edges without loops."""
    kept = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return kept.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst")))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def fold_events(events: DataFrame) -> DataFrame:
    """events(seq, src, dest, op) -> edges whose last event is ADD; a partial aggregate, so hot pairs don't skew."""
    pair = events.where("src <> dest").select(F.least("src", "dest").alias("u"), F.greatest("src", "dest").alias("v"), "seq", "op")
    return pair.groupBy("u", "v").agg(F.max_by("op", "seq").alias("op")).where("op = 'ADD'").select("u", "v")


def degree(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members(id)."""
    return edges.join(members.select(F.col("id").alias("u")), "u", "left_semi").join(members.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v")


def common_neighbours(edges: DataFrame) -> DataFrame:
    """u, v, common for every edge. Edges are pointed from the lower degree, so a hub's list is never squared."""
    d = degree(edges)
    ranked = edges.join(d.select(F.col("id").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("id").alias("v"), F.col("degree").alias("dv")), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    out = ranked.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b"))
    closed = edges.select(F.col("u").alias("cu"), F.col("v").alias("cv"))
    wedge = out.alias("x").join(out.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b"))).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    triangle = wedge.join(closed, (F.col("b") == F.col("cu")) & (F.col("c") == F.col("cv"))).select("a", "b", "c")
    sides = triangle.select(F.explode(F.array(*[F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])).alias("e")).select("e.*")
    return edges.join(sides.groupBy("u", "v").agg(F.count("*").alias("common")), ["u", "v"], "left").select("u", "v", F.coalesce("common", F.lit(0)).alias("common"))


def clustering(edges: DataFrame) -> DataFrame:
    """id, clustering: twice the triangles over degree * (degree - 1); 0 below degree 2."""
    twice = symmetric(edges).join(common_neighbours(edges), (F.least("src", "dst") == F.col("u")) & (F.greatest("src", "dst") == F.col("v")))
    t = twice.groupBy(F.col("src").alias("id")).agg(F.sum("common").alias("t2"), F.count("*").alias("d"))
    return t.select("id", F.when(F.col("d") > 1, F.col("t2") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("u", "v").unionByName(b.select("u", "v")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["u", "v"], "left_anti").select("u", "v").distinct()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return difference(a, b).unionByName(difference(b, a))


def label_rounds(edges: DataFrame, rounds: int, every: int = 4) -> DataFrame:
    """Synchronous label propagation: the most common label among neighbours, ties to the smaller label."""
    adj = symmetric(edges)
    labels = vertices(edges).withColumn("label", F.col("id"))
    for k in range(rounds):
        votes = adj.join(labels, adj.dst == labels.id).groupBy("src", "label").agg(F.count("*").alias("n"))
        labels = votes.groupBy(F.col("src").alias("id")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
        if (k + 1) % every == 0 and labels.sparkSession.sparkContext.getCheckpointDir():
            labels = labels.checkpoint()
    return labels


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """id, component: the least vertex reachable, by least labels and pointer jumping."""
    adj, checkpoints = symmetric(edges), edges.sparkSession.sparkContext.getCheckpointDir()
    labels = adj.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("component"))
    for _ in range(max_rounds):
        near = adj.join(labels, adj.dst == labels.id).groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.id == near.src).select("id", F.least("component", "near").alias("next"), F.col("component").alias("old"))
        up = labels.select(F.col("id").alias("up"), F.col("component").alias("up_component"))
        step = step.join(up, step.next == up.up).select("id", F.least("next", "up_component").alias("component"), "old")
        step = step.checkpoint() if checkpoints else step.persist()
        changed = step.where("component <> old").limit(1).count()
        labels = step.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError("components still change")


def dictionary(pairs: DataFrame) -> DataFrame:
    """node -> dense code in first-seen order, src before dest; pairs(seq, src, dest)."""
    from .order import with_position

    both = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("node"), (F.col("seq") * 2).alias("at")), F.struct(F.col("dest").alias("node"), (F.col("seq") * 2 + 1).alias("at")))).alias("x")).select("x.*")
    return with_position(both.groupBy("node").agg(F.min("at").alias("at")), "at", name="code").select("node", "code")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
