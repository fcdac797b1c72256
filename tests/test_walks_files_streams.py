import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom.operators import graph, walks
from graphloom.sources import files
from graphloom.streaming import online


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "u long, v long")


def test_walks_stay_on_edges_and_rest_on_isolated_vertices(spark):
    pairs = [(1, 2), (2, 3), (1, 3), (3, 4)]
    starts = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 9)], "id long")
    got = walks.random_walks(edges(spark, pairs), starts, 5, 4, p=4.0, q=0.5).collect()
    assert len(got) == 25
    for r in got:
        assert r["path"][0] == r["start"] and len(r["path"]) == 4
        for a, b in zip(r["path"][:-1], r["path"][1:], strict=True):
            assert (min(a, b), max(a, b)) in pairs or a == b == 9


def test_return_weight(spark):
    e = edges(spark, [(0, k) for k in range(1, 5)])
    starts = spark.createDataFrame([(1,)], "id long")
    got = [r["path"] for r in walks.random_walks(e, starts, 2000, 3, p=0.5, q=1.0).collect()]
    assert abs(np.mean([x[2] == 1 for x in got]) - 2 / 5) < 0.04


def test_embedding_parts_two_cliques(spark):
    pairs = [(a, b) for base in (0, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)] + [(0, 10)]
    e = edges(spark, pairs)
    one = graph.vertices(e).select(F.col("id").alias("vertex"), F.lit(0).alias("part"))
    vec = {r["vertex"]: np.array(r["vec"]) / np.linalg.norm(r["vec"]) for r in walks.node2vec(e, one, n_walks=20, dim=16, window=3, epochs=10).collect()}
    assert len(vec) == 12
    inside = np.mean([vec[a] @ vec[b] for a, b in pairs[:-1]])
    between = np.mean([vec[a] @ vec[b] for a in range(6) for b in range(10, 16)])
    assert inside > between + 0.2


def test_event_files(spark, tmp_path):
    t = tmp_path / "e.txt"
    t.write_text("1 2 5\n2 3 6\n")
    assert [tuple(r)[1:5] for r in files.event_text(spark, str(t)).orderBy("seq").collect()] == [(1, 2, 5, "ADD"), (2, 3, 6, "ADD")]
    c = tmp_path / "e.csv"
    c.write_text("src,dest,timestamp,type\n1,2,5,ADD,a=b,c=d\n1,2,6,REMOVE\n")
    assert [tuple(r)[1:] for r in files.event_csv(spark, str(c)).orderBy("seq").collect()] == [(1, 2, 5, "ADD", {"a": "b", "c": "d"}), (1, 2, 6, "REMOVE", None)]
    b = tmp_path / "e.bin"
    b.write_bytes(struct.pack("<6i", 1, 2, 5, 3, 4, 6))
    assert [tuple(r)[1:4] for r in files.event_binary(spark, str(b)).orderBy("seq").collect()] == [(1, 2, 5), (3, 4, 6)]
    b.write_bytes(b"\0" * 13)
    with pytest.raises(PySparkException):
        files.event_binary(spark, str(b)).collect()
    files.write_event_text(files.event_text(spark, str(t)), str(tmp_path / "out"))
    assert files.event_text(spark, str(tmp_path / "out")).select("src", "dest", "ts").orderBy("src").collect() == [(1, 2, 5), (2, 3, 6)]


def test_graph_files(spark, tmp_path):
    z = tmp_path / "g.npz"
    np.savez(z, adj_data=np.ones(4), adj_indices=np.array([1, 0, 2, 1]), adj_indptr=np.array([0, 1, 3, 4]), adj_shape=np.array([3, 3]))
    assert [(r["seq"], r["src"], r["dest"]) for r in files.npz_events(spark, str(z)).orderBy("seq").collect()] == [(0, 0, 1), (1, 1, 2)]
    t = tmp_path / "g.tsv"
    t.write_text("u\tv\n1\t2\n# note\n2\t3\n9\t9\n")
    assert files.edge_list(spark, str(t), skip=1, limit=4).orderBy("src").collect() == [(1, 2), (2, 3)]
    j = tmp_path / "g.json"
    j.write_text('{"a": {"b": [[1, 2], ["2", "3"]]}}')
    assert files.edge_json(spark, str(j), "a.b").orderBy("src").collect() == [(1, 2), (2, 3)]
    e = edges(spark, [(1, 2), (2, 3)])
    files.write_gml(graph.vertices(e), e, str(tmp_path / "gml"))
    whole = tmp_path / "g.gml"
    whole.write_text("".join(p.read_text() for p in sorted((tmp_path / "gml").glob("part-*"))))
    v, back = files.gml(spark, str(whole))
    assert sorted(r[0] for r in v.collect()) == [1, 2, 3] and sorted(map(tuple, back.collect())) == [(1, 2), (2, 3)]


def test_stream_of_buffers(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text("0,0,4,ADD\n0,4,8,ADD\n0,1,5,ADD\n")
    (source / "b.csv").write_text("1,2,0,ADD\n1,2,4,ADD\n1,3,5,REMOVE\n")
    stream = spark.readStream.schema("seq long, src long, dest long, op string").option("maxFilesPerTrigger", 1).csv(str(source))
    online.start(stream, "file://" + str(tmp_path / "state"), 4, mu=0.0).awaitTermination(120)
    last = sorted((tmp_path / "state/assign").iterdir())[-1]
    assert last.name == "batch-1"
    got = {r["vertex"]: r["part"] for r in spark.read.parquet(str(last)).collect()}
    assert got[2] == 0 and got[8] == 0 and got[5] == 1 and 3 not in got
