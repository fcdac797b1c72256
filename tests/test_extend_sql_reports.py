"""Extension points, SQL functions, summaries and stored copies on small cases."""

import parity
import pytest
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.functions import sql
from graphloom.operators import reports, stored, vectors
from graphloom.plans import extend
from graphloom.sources import files, registry


def test_implementations_and_listeners():
    more, heard = extend.Extensions(), []

    @more.pluggable
    def size(n):
        return n

    assert size(3) == 3
    more.instead("size", lambda n: n * 10 if n > 5 else None)
    assert size(3) == 3 and size(6) == 60
    more.instead("size", lambda n: 0 if n > 8 else None)
    assert size(7) == 70
    with pytest.raises(extend.Conflict):
        size(9)
    more.on("made", lambda **facts: heard.append(facts))
    assert more.notify("made", graph="g") == 1 and more.notify("else") == 0 and heard == [{"graph": "g"}]


def test_settings_and_algorithms(spark):
    assert extend.Settings.load(spark) == extend.Settings()
    extend.Settings().with_(dim=4, parts=2).save(spark)
    try:
        assert extend.Settings.load(spark) == extend.Settings(parts=2, dim=4)
    finally:
        for name in ("parts", "dim", "walks", "length", "seed"):
            spark.conf.unset(f"graphloom.{name}")
    known = extend.algorithms()
    assert known.names() == ["entropy", "node2vec", "unlearned"]
    rows = known.run("unlearned", registry.cycle_graph(spark, 5), dim=3).collect()
    assert sorted(r["vertex"] for r in rows) == [*range(5)] and all(len(r["vec"]) == 3 for r in rows)
    assert known.run("node2vec", registry.complete_graph(spark, 4), dim=4, n_walks=2, length=4).count() == 4
    with pytest.raises(KeyError):
        known.run("none", None)
    with pytest.raises(ValueError):
        known.register("node2vec", None)


def test_sql_functions(spark):
    assert sql.register(spark) == sql.register(spark)
    row = spark.sql("SELECT loom_cosine(array(1D, 0D), array(0D, 0D)) AS a, loom_norm(array(3D, 4D)) AS b, size(loom_skipgrams(array(1L, 2L, 3L), 1)) AS c, loom_skipgrams(array(1L, 2L), 2) AS d, loom_dot(null, array(1D)) AS e").first()
    assert row["a"] == 0 and row["b"] == 5 and row["c"] == 4 and [(x["target"], x["context"]) for x in row["d"]] == [(1, 2), (2, 1)] and row["e"] is None


def test_graph_statistics(spark):
    g = registry.complete_graph(spark, 4).unionByName(spark.createDataFrame([(10, 11)], "u long, v long"))
    vertices = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 10, 11, 20, 21)], "id long")
    got = {r["statistic"]: r["value"] for r in reports.graph_statistics(vertices, g).collect()}
    assert got == {"component_1": 4, "component_2": 2, "component_3": 1, "components": 4, "isolates": 2, "average_clustering": 0.5} | {f"degree_{k}": n for k, n in enumerate([2, 2, 0, 4, 0])}


def test_overrides_and_times(spark):
    base = spark.createDataFrame([(1, 2, "x"), (2, 3, "y")], "k long, a long, b string")
    other = spark.createDataFrame([(1, 9, None)], "k long, a long, b string")
    assert sorted(map(tuple, reports.with_overrides(base, other, "k").collect())) == [(1, 9, "x"), (2, 3, "y")]
    runs = spark.createDataFrame([("a", "one", 4.0), ("a", "many", 2.0), ("a", "many", 0.0), ("b", "one", 1.0)], "name string, mode string, s double")
    assert sorted(map(tuple, reports.time_table(runs, ["name"], "mode", "s", "one", "many").collect())) == [("a", 4.0, 1.0, 4.0), ("b", 1.0, None, None)]


def test_centroids_beyond_the_broadcast_and_in_blocks(spark, monkeypatch):
    emb = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.sin(F.col("id") * k)).alias("vec"))
    parts = spark.range(30).select(F.col("id").alias("part"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.cos(F.col("id") * k)).alias("c"))
    want = sorted(map(tuple, vectors.nearest_centroid(emb, parts, 3).collect()))
    assert len(want) == 180
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    found = vectors.nearest_centroid(emb, parts, 3, most=0)
    assert sorted(map(tuple, found.collect())) == want
    assert vectors.nearest_centroid(emb, parts.limit(0), 3).count() == 0


def test_gml_with_nested_blocks(spark, tmp_path):
    body = 'graph [\n  # a note ]\n  directed 0\n  node [ id 0 label "7" graphics [ x 1 y [ z "a ] b" ] ] ]\n  node [ id 1\n graphics [ id 99 ] label "8" ]\n  node [ id 2 ]\n  edge [ source 1 target 0 data [ source 5 ] ]\n  edge [ source 2 target 1 ]\n  edge [ source 1 target 2 ]\n]\n'
    (tmp_path / "a.gml").write_text(body)
    vertices, edges = files.gml(spark, str(tmp_path / "a.gml"))
    assert sorted(r["id"] for r in vertices.collect()) == [2, 7, 8] and sorted(map(tuple, edges.collect())) == [(2, 8), (7, 8)]
    vertices, edges = files.gml(spark, str(tmp_path / "a.gml"), by_id=True)
    assert sorted(r["id"] for r in vertices.collect()) == [0, 1, 2] and sorted(map(tuple, edges.collect())) == [(0, 1), (1, 2)]
    (tmp_path / "b.gml").write_text('graph [ node [ id 0 label "name" ] ]')
    with pytest.raises(Exception, match="(?i)cast"):
        files.gml(spark, str(tmp_path / "b.gml"))[0].collect()
    assert files.gml(spark, str(tmp_path / "b.gml"), by_id=True)[0].count() == 1
    (tmp_path / "c.gml").write_text("graph [ node [ id 0 ]")
    with pytest.raises(Exception, match="closed"):
        files.gml(spark, str(tmp_path / "c.gml"))[0].collect()
    (tmp_path / "d.gml").write_text("graph [ ]")
    assert files.gml(spark, str(tmp_path / "d.gml"))[1].count() == 0


def test_copies_and_chunks(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    for k in range(3):
        stored.appended(spark.range(10 * k, 10 * k + 10), a, k == 0)
    assert stored.copied(spark, a, b).count() == 30
    with pytest.raises(Exception, match="(?i)exists"):
        stored.copied(spark, a, b)
    stored.appended(spark.range(2), a, True)
    assert stored.copied(spark, a, b, replace=True).count() == 2
    spark.range(6).withColumn("part", F.col("id") % 2).write.partitionBy("part").parquet(f"{tmp_path}/p")
    assert stored.copied(spark, f"{tmp_path}/p", f"{tmp_path}/q").count() == 6 and (tmp_path / "q" / "part=1").exists()


@pytest.mark.parametrize("name", ["graph_statistics", "vertex_difference", "centroids_or_none", "parameter_overrides", "time_table", "runs_summary", "sql_kernels", "data_profile", "nearest_centroid"])
def test_parity_on_the_larger_tables(spark, name):
    sf = "/root/testdata/sf0.01"
    assert parity.differs(catalog.QUERIES[name](spark, sf), parity.connect(sf), catalog.ORACLES[name]) is None
