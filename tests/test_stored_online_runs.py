import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import expr
from graphloom.operators import graph, stored
from graphloom.plans.runs import Runs, write_steps
from graphloom.sources import files, registry
from graphloom.streaming import embeddings, partitioners

EVENTS = "seq long, src long, dest long, op string, buffer long"


def test_stored_graph(spark, tmp_path):
    v, e = stored.empty(spark)
    e = stored.add_edges(e, spark.createDataFrame([(2, 1), (1, 2), (3, 4), (5, 5)], "u long, v long"))
    assert {tuple(r) for r in e.collect()} == {(1, 2), (3, 4)}
    assert {tuple(r) for r in stored.remove_edges(e, spark.createDataFrame([(4, 3), (8, 9)], "u long, v long")).collect()} == {(1, 2)}
    v = stored.add_vertices(v, spark.range(1, 8))
    assert {r["id"]: r["degree"] for r in stored.degrees_of(v, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0}
    ring = stored.ring(spark, ["a", "b", "c"])
    tables = stored.sharded("g", v, e, ring)
    stored.write_sharded(tables, str(tmp_path))
    read_v, read_e = stored.read_sharded(spark, str(tmp_path), "g")
    assert read_v.count() == 7 and read_e.count() == 4
    one = read_v.first()["shard"]
    part, _ = stored.read_sharded(spark, str(tmp_path), "g", one)
    assert {r["shard"] for r in part.collect()} == {one}
    assert stored.moved(v.select(F.col("id").alias("key")), ring, ring).count() == 0


def test_partitioners(spark):
    buffer = spark.createDataFrame([(0, 1, 2, "ADD", 0), (1, 2, 3, "ADD", 0), (2, 3, 4, "REMOVE", 0)], EVENTS)
    known = spark.createDataFrame([(1, 1)], "vertex long, part int")
    assert {r["vertex"]: r["part"] for r in partitioners.random_sticky(buffer, known, 3).collect()}[1] == 1
    only = spark.createDataFrame([(0, 0.0), (1, 5.0)], "part int, weight double")
    assert {r["part"] for r in partitioners.by_distribution(spark.range(50).withColumnRenamed("id", "vertex"), only).collect()} == {1}
    for name in partitioners.PARTITIONERS:
        more = {"known": buffer} if name == "decayed_neighbour" else {}
        got = partitioners.partitioner(name)(buffer, known, 2, **more).collect()
        assert {r["vertex"] for r in got} == {1, 2, 3}, name
    with pytest.raises(ValueError):
        partitioners.partitioner("nothing")
    assert partitioners.smoothed_capacity([10.0, 20.0], 0.0, 0.5) == [10.0, 15.0]
    after = partitioners.with_deletions(spark.createDataFrame([(3, 4), (7, 8)], "u long, v long"), buffer)
    assert {tuple(r) for r in after.collect()} == {(1, 2), (2, 3), (7, 8)}


def test_entropy_of_prefixes_and_stop():
    rng = np.random.default_rng(3)
    for _ in range(30):
        path = rng.integers(0, 5, 20)
        for k, h in enumerate(embeddings.entropies(path), 1):
            share = np.unique(path[:k], return_counts=True)[1] / k
            assert abs(h + (share * np.log2(share)).sum()) < 1e-9
        n = embeddings.entropy_stop(path)
        h = embeddings.entropies(path)
        r2 = [np.corrcoef(np.arange(k), h[:k])[0, 1] ** 2 for k in range(5, 21)]
        want = next((k for k, r in zip(range(5, 21), r2, strict=True) if not r >= 0.995), 20)
        assert n == want
    assert embeddings.entropy_stop(np.zeros(10, int)) == 5


def test_embeddings_follow_a_stream(spark):
    """Vectors of untouched vertices stay, cliques stay apart, and a stream gives a version for each batch."""
    pairs = [(a + 10 * c, b + 10 * c) for c in (0, 1) for a in range(5) for b in range(a)]
    first = spark.createDataFrame([(k, a, b, "ADD", 0) for k, (a, b) in enumerate(pairs)], EVENTS)
    second = spark.createDataFrame([(100, 0, 4, "ADD", 1), (101, 1, 50, "ADD", 1)], EVENTS)
    none = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], embeddings.EMB)
    edges, emb = embeddings.update(*none, first, retrain=5, dim=8, epochs=8)
    old = {r["vertex"]: r["vec"] for r in emb.collect()}
    edges2, emb2 = embeddings.update(edges, emb, second, retrain=5, n_walks=1, length=3, dim=8, epochs=1)
    new = {r["vertex"]: r["vec"] for r in emb2.collect()}
    assert set(new) == set(old) | {50} and all(new[v] == old[v] for v in range(10, 15))
    unit = {v: np.array(x) / np.linalg.norm(x) for v, x in old.items()}
    mean = lambda f: np.mean([unit[a] @ unit[b] for a in old for b in old if a < b and f(a, b)])
    assert mean(lambda a, b: a // 10 == b // 10) > mean(lambda a, b: a // 10 != b // 10)
    assign = spark.createDataFrame([(v, int(v >= 10)) for v in old if v % 5], "vertex long, part int")
    placed = {r["vertex"] for r in embeddings.semantic_push(edges, emb, assign, second, 2, retrain=5, dim=8, n_walks=1, length=3, epochs=1)[2].collect()}
    assert placed == {v for v in old if v % 5} | {0, 1, 4, 50}


def test_runs(spark, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}/runs")
    assert runs.names() == []
    for k in range(3):
        assert runs.save("a", spark.range(k + 1)) == k + 1
    assert runs.load("a").count() == 3 and runs.load("a", 1).count() == 1
    assert runs.restore("a", 1) == 4 and runs.load("a").count() == 1
    assert runs.clean("a", 2) == [1, 2] and runs.versions("a") == [3, 4]
    assert runs.memoised("b", lambda: spark.range(5)).count() == 5 and runs.memoised("b", lambda: 1 / 0).count() == 5
    assert runs.names() == ["a", "b"] and [*runs.where(lambda x: x == "b")] == ["b"]
    runs.delete("a")
    assert runs.names() == ["b"]
    with pytest.raises(KeyError):
        runs.load("a")
    with pytest.raises(ValueError):
        runs.load("../x")
    write_steps(spark.range(4).withColumn("step", F.col("id") % 2), f"{tmp_path}/steps", "step")
    assert spark.read.json(f"{tmp_path}/steps").count() == 4


def test_registry_and_csv(spark, tmp_path):
    known = registry.Registry()
    known.register("ring", registry.GRAPHS["cycle"], n=5)
    assert known.load(spark, "ring").count() == 5 and known.load(spark, "ring", n=9).count() == 9
    with pytest.raises(KeyError):
        known.load(spark, "nothing")
    assert [registry.GRAPHS[x](spark, 6).count() for x in ("path", "star", "complete")] == [5, 5, 15]
    (tmp_path / "list").write_text("# all\n/a/b\n\n /c  # that\n")
    assert registry.listed(spark, str(tmp_path / "list")) == ["/a/b", "/c"]
    assert registry.from_iterable(spark, ((k, k + 1, 7) for k in range(25)), 10).count() == 25
    (tmp_path / "csv").mkdir()
    for k in range(2):
        (tmp_path / "csv" / f"{k}.csv").write_text(f"src,dest,timestamp,type\n{k},2,3,add\n4,5,6,REMOVE,a=b,c=d\n")
    got = files.event_csv(spark, str(tmp_path / "csv")).collect()
    assert sorted((r["src"], r["op"], bool(r["attrs"])) for r in got) == [(0, "ADD", False), (1, "ADD", False), (4, "REMOVE", True), (4, "REMOVE", True)]
    (tmp_path / "csv" / "bad.csv").write_text("src,dest,timestamp,type\n1,2\n")
    with pytest.raises(Exception, match="fewer than four"):
        files.event_csv(spark, str(tmp_path / "csv")).collect()


def test_expressions(spark):
    row = spark.range(1).select(
        expr.expand_nodes(F.lit("n[03,10-12]x")).alias("a"), expr.expand_nodes(F.lit("host")).alias("b"), expr.sorted_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))).alias("c"),
        expr.mod_power(F.lit(7), F.lit(130), 1009).alias("d"), expr.all_close_to_zero(F.array(F.lit(0.0), F.lit(-1e-9))).alias("e"), expr.all_close_to_zero(F.array(F.lit(0.1))).alias("f"),
    ).first()
    assert row["a"] == ["n03x", "n10x", "n11x", "n12x"] and row["b"] == ["host"] and row["c"] == '{"a":2,"b":1}' and row["d"] == pow(7, 130, 1009) and row["e"] and not row["f"]
    assert graph.degree(registry.complete_graph(spark, 4)).where("degree <> 3").count() == 0
