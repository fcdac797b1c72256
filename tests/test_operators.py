from pyspark.sql import functions as F

from graphloom.functions import expr
from graphloom.operators import graph, quality, vectors
from graphloom.operators.order import buffers, with_position


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "u long, v long")


def test_fold(spark):
    rows = [(0, 1, 2, "ADD"), (1, 2, 1, "ADD"), (2, 2, 3, "ADD"), (3, 3, 2, "REMOVE"), (4, 5, 5, "ADD")]
    assert graph.fold_events(spark.createDataFrame(rows, "seq long, src long, dest long, op string")).collect() == [(1, 2)]


def test_buffers_and_codes(spark):
    seq = spark.createDataFrame([(k * 10,) for k in range(5)], "seq long")
    assert [r["n"] for r in buffers(seq, 2, "seq").groupBy("buffer").agg(F.count("*").alias("n")).orderBy("buffer").collect()] == [2, 2, 1]
    assert [r["pos"] for r in with_position(seq, "seq").orderBy("seq").collect()] == [0, 1, 2, 3, 4]
    pairs = spark.createDataFrame([(0, 9, 7), (1, 7, 4)], "seq long, src long, dest long")
    assert {r["node"]: r["code"] for r in graph.dictionary(pairs).collect()} == {9: 0, 7: 1, 4: 2}


def test_corruption(spark):
    path = edges(spark, [(1, 2), (2, 3), (3, 4)])
    halves = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "vertex long, part int")
    assert quality.corruption(path, halves).first()[0] == 0.333333
    triangle = edges(spark, [(1, 2), (1, 3), (2, 3)])
    twice = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (1, 1), (2, 1)], "vertex long, part int")
    assert quality.corruption(triangle, twice).first()[0] == 0
    assert quality.corruption(triangle, twice, parity=True).first()[0] == 0.333333


def test_balance_and_moves(spark):
    sizes = spark.createDataFrame([(k, 0 if k < 3 else 1) for k in range(4)], "vertex long, part int")
    assert quality.balance(sizes, 2).first()[0] == 0.5
    moved = sizes.withColumn("part", F.when(F.col("vertex") == 0, 1).otherwise(F.col("part")))
    assert quality.repartitionings(sizes, moved).first()[0] == 1


def test_reconstruction(spark):
    line = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0])], "id long, vec array<double>")
    assert [(r["i"], r["j"]) for r in vectors.closest_pairs(line, 2).collect()] == [(1, 2), (2, 3)]
    f1 = quality.reconstruction_f1(edges(spark, [(1, 2), (2, 3)]), edges(spark, [(1, 2)])).first()
    assert (f1["precision"], f1["recall"], f1["f1"]) == (1.0, 0.5, 0.666667)


def test_ranks(spark):
    r = quality.rank_metrics(spark.createDataFrame([(1,), (2,), (4,)], "rank int"), (1,)).first()
    assert (r["mrr"], r["hits_1"]) == (0.583333, 0.333333)


def test_lcg(spark):
    assert [r[0] for r in spark.range(5).select(expr.lcg(F.col("id"), 1, 2, 3, 5)).collect()] == [1, 0, 3, 4, 1]


def test_centroid_and_components(spark):
    emb = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0])], "vertex long, vec array<double>")
    assert vectors.merge_mean(emb).first()["vec"] == [0.5, 0.5]
    two = edges(spark, [(1, 2), (2, 3), (4, 5)])
    assert {r["id"]: r["component"] for r in graph.components(two).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert {r["id"]: r["component"] for r in graph.components(edges(spark, [])).collect()} == {}
