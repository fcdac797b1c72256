import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, training
from graphloom.sources import registry


def test_skipgrams(spark):
    walk = spark.createDataFrame([([5, 6, 7, 8],)], "path array<long>")
    got = {(r["target"], r["context"]): r["n"] for r in training.skipgrams(walk, 2).collect()}
    assert sum(got.values()) == 10 and (5, 8) not in got and got[5, 7] == got[7, 5] == 1


def test_negative_edges_are_as_many_as_asked_for(spark):
    edges = registry.cycle_graph(spark, 12)
    ids = graph.vertices(edges)
    got = [tuple(r) for r in training.negative_edges(ids, edges, 30).collect()]
    held = {tuple(r) for r in edges.collect()}
    assert len(set(got)) == 30 and all(u < v and (u, v) not in held for u, v in got)
    with pytest.raises(ValueError):
        training.negative_edges(ids, registry.complete_graph(spark, 12), 1)


def test_parts_scores_and_baselines(spark):
    edges = registry.complete_graph(spark, 4).unionByName(registry.complete_graph(spark, 4).select((F.col("u") + 10).alias("u"), (F.col("v") + 10).alias("v")))
    assign = training.packed_labels(edges, 2)
    assert sorted(r["count"] for r in assign.groupBy("part").count().collect()) == [4, 4]
    assert training.top_corrupt(edges, assign, 3).where("lost > 0").count() == 0
    from graphloom.operators import quality

    assert training.partitioning_score(edges, lambda e: training.packed_labels(e, 2), quality.corruption).first()["corruption"] == 0
    assert training.constant_predictions(edges).where("linked").count() == 0
    assert training.reduced(spark.range(4).withColumn("f", F.col("id") * F.col("id")), "f").first()["f"] == 14
    assert training.seen_first([(1, 2), (5, 6), (2, 3), (6, 1)]) == [(1, 2), (2, 3), (6, 1), (5, 6)]
    assert training.aligned(spark.createDataFrame([(1, [0.5])], "vertex long, vec array<double>"), spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vertex long, vec array<double>")).count() == 1
    for kind in ("forest", "boosted", "tree", "logistic"):
        training.classifier(kind)
    with pytest.raises(ValueError):
        training.classifier("nothing")
