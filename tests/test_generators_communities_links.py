"""Generators, communities, placement, links, binary events and sweeps against known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.operators import communities, generators, graph, links, placement
from graphloom.plans import sweeps, views
from graphloom.sources import files

CLIQUES = [(u + 10 * c, v + 10 * c) for c in (0, 1) for u in range(6) for v in range(u + 1, 6)]


@pytest.fixture()
def cliques(spark):
    return spark.createDataFrame(CLIQUES, "u long, v long")


def test_block_model_extremes(spark):
    e = {tuple(r) for r in generators.block_model(spark, [2, 3], [[1, 0], [0, 1]]).collect()}
    assert e == {(0, 1), (2, 3), (2, 4), (3, 4)}


def test_attachment_links_to_earlier_vertices_and_prefers_hubs(spark):
    rows = generators.preferential_attachment(spark, 3000).collect()
    assert len(rows) == 2999 and all(0 <= r.dest < r.src for r in rows)
    into = {}
    for r in rows:
        into[r.dest] = into.get(r.dest, 0) + 1
    assert max(into.values()) > 25  # uniform choice stays near log(n)


def test_forest_fire(spark):
    events = list(generators.forest_fire(40, 0.4))
    assert events == list(generators.forest_fire(40, 0.4))
    assert {e[1] for e in events} == set(range(1, 40)) and all(e[2] < e[1] for e in events)
    assert [e[0] for e in events] == list(range(len(events)))


def test_local_fitness_finds_cliques(spark, cliques):
    got = {}
    for r in communities.local_fitness(cliques).collect():
        got.setdefault(r.community, set()).add(r.vertex)
    assert sorted(map(sorted, got.values())) == [list(range(6)), list(range(10, 16))]


def test_local_fitness_grows_one_community_at_most(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(30)], "u long, v long")
    rows = communities.local_fitness(path, alpha=2.0, most=1).collect()
    assert {r.vertex for r in rows} == set(range(31)) and len({r.community for r in rows}) == 1


def test_threshold_one_grows_nothing(spark, cliques):
    assert all(r.vertex == r.community for r in communities.local_fitness(cliques, threshold=1.0).collect())


def test_fitness_partition_covers_planted_and_events_graphs(spark):
    planted = generators.planted_partition(spark, 4, 60, 0.2, 0.02, 4)
    rows = communities.partition(planted, 4, threshold=0.1).collect()
    assert {r.vertex for r in rows} == {r.id for r in graph.vertices(planted).collect()} and {r.part for r in rows} <= set(range(4))
    d = "/root/testdata/sf0.001"
    found = catalog.QUERIES["fitness_partition"](spark, d).collect()
    assert {r.vertex for r in found} == {r.id for r in graph.vertices(views.g_purchase(spark, d)).collect()}


def test_pack_bins(spark):
    sizes = spark.createDataFrame([(k, n) for k, n in enumerate([9, 7, 6, 5, 4, 3, 2])], "community long, size long")
    rows = communities.pack_bins(sizes, 3).join(sizes, "community").groupBy("bin").agg(F.sum("size").alias("n")).collect()
    assert sorted(r.n for r in rows) == [11, 12, 13]  # 9+3, 7+4+2, 6+5: heaviest first by hand
    many = spark.range(5000).select(F.col("id").alias("community"), F.lit(1).cast("long").alias("size"))
    loads = [r["count"] for r in communities.pack_bins(many, 4).groupBy("bin").count().collect()]
    assert len(loads) == 4 and sum(loads) == 5000 and max(loads) < 1400


def test_sequential_placement_fills_parts(spark):
    b = spark.createDataFrame([(11, [3.0, 1.0]), (12, [2.5, 1.5]), (13, [-1.0, 2.0]), (14, [-2.0, 2.5])], "id long, vec array<double>").withColumn("buffer", F.lit(0))
    empty = spark.createDataFrame([(k, 0, None) for k in range(4)], "part int, size long, c array<double>")
    assert sorted(r.part for r in placement.fill_nearest(b, empty, 1, 1.0).collect()) == [0, 1, 2, 3]
    anchors = spark.createDataFrame([(0, 1, [0.0, -2.0]), (1, 1, [0.5, 3.0])], "part int, size long, c array<double>")
    uv = spark.createDataFrame([(7, [0.2, -1.4]), (8, [0.1, 2.2])], "id long, vec array<double>").withColumn("buffer", F.lit(0))
    assert {tuple(r) for r in placement.fill_nearest(uv, anchors).select("vertex", "part").collect()} == {(7, 0), (8, 1)}


def test_density_clusters_and_their_parts(spark):
    e = spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.1, 2.0]), (3, [-3.0, 0.5]), (4, [-3.0, 0.4]), (5, [9.0, -7.0]), (6, [2.0, 2.15])], "id long, vec array<double>")
    found = placement.density_clusters(e, 0.2, 2)
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (6, 1), (3, 3), (4, 3), (5, None)}
    sizes = spark.createDataFrame([(0, 10), (1, 2)], "part int, size long")
    assert {tuple(r) for r in placement.clusters_to_parts(found, sizes).collect()} == {(1, 1), (2, 1), (6, 1), (3, 0), (4, 0)}


def plain_clusters(rows, eps, least):
    far = lambda a, b: None in (a, b) or len(a) != len(b) or not sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5 <= eps
    near = {i: [j for j, b in rows if i != j and not far(a, b)] for i, a in rows}
    named = {i: i for i in near if len(near[i]) + 1 >= least}
    for _ in named:
        named = {i: min([at, *(named[j] for j in near[i] if j in named)]) for i, at in named.items()}
    return {i: named.get(i, min((named[j] for j in near[i] if j in named), default=None)) for i in near}


def test_density_clusters_of_many_blocks_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(placement, "BLOCK_ROWS", 12)
    monkeypatch.setattr(placement, "PIVOTS", 3)
    rng, inf = random.Random(5), float("inf")
    spread = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(120)]
    ties = [[0.3 * x, 0.4 * y] for x in range(8) for y in range(8) if rng.random() < 0.6]
    odd = [None, [], [0.0], [0.05], [inf, 0.0], [inf, 0.0], [float("nan"), 0.0]] + [[2.0, 2.0]] * 40 + [[rng.uniform(0, 3), 1.0] for _ in range(30)]
    for vecs, eps, least in ((spread, 0.45, 4), (ties, 0.5, 3), (odd, 0.1, 3), (odd[-20:] + [None], 0.05, 1)):
        rows = [(2**60 + 7 * k, v) for k, v in enumerate(rng.sample(vecs, len(vecs)))]
        got = placement.density_clusters(spark.createDataFrame(rows, "id long, vec array<double>"), eps, least).collect()
        assert {tuple(r) for r in got} == set(plain_clusters(rows, eps, least).items()) and len(got) == len(rows)


def test_density_clusters_move_no_frame_of_pairs(spark):
    rng, context = random.Random(6), spark.sparkContext._jsc.sc()

    def moved():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    rows, before = [(k, [rng.uniform(0, 1) for _ in range(4)]) for k in range(1200)], moved()
    found = placement.density_clusters(spark.createDataFrame(rows, "id long, vec array<double>"), 2.0, 3).collect()
    assert {tuple(r) for r in found} == {(k, 0) for k, _ in rows}
    bytes_moved = moved() - before
    assert 0 < bytes_moved < 600 * len(rows), bytes_moved  # all 719 400 pairs are within 2


def test_close_pairs_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(3)]) for k in range(80)]
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if sum((x - y) ** 2 for x, y in zip(a, b)) <= 0.16}
    got = {tuple(r) for r in placement.close_pairs(spark.createDataFrame(rows, "id long, vec array<double>"), 0.4).collect()}
    assert got == want and want


def test_link_predictor_tells_cliques_apart(spark, cliques):
    emb = spark.createDataFrame([(k + 10 * c, [1.0, 0.0] if c else [0.0, 1.0]) for c in (0, 1) for k in range(6)], "id long, vec array<double>")
    wrong = spark.createDataFrame([(u, v) for u in range(6) for v in range(10, 16)], "u long, v long")
    pairs = cliques.withColumn("label", F.lit(1)).unionByName(wrong.withColumn("label", F.lit(0)))
    for kind in ("product", "outer", "absolute"):
        model = links.train(pairs, emb, 2, kind)
        got = links.predict(pairs, emb, model, 2, kind).join(pairs, ["u", "v"])
        assert got.where("linked <> (label = 1)").count() == 0, kind
    model, loss = links.best_of(pairs, emb, 2, 2)
    assert loss < 0.2 and links.predict(pairs, emb, model, 2).where("linked").count() == 30
    with pytest.raises(ValueError):
        links.pair_features(links.with_vectors(pairs, emb, 2), "other")


def test_binary_events_round_trip(spark, tmp_path):
    rows = [(k, k % 7, k % 5 + 10, k * 3) for k in range(50)]
    events = spark.createDataFrame(rows, "seq long, src long, dest long, ts long")
    files.write_event_binary(events, f"file://{tmp_path}/ev")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "ev").iterdir()) if p.suffix == ".bin")
    import numpy as np

    assert np.frombuffer(data, "=i4").reshape(-1, 3).tolist() == [[s, d, t] for _, s, d, t in rows]


def test_sweep_sums_and_resumes(spark, tmp_path):
    ran = []

    def square(spark, x, y):
        ran.append(x)
        return spark.range(1).select(F.lit(x * x + y).alias("f"))

    for _ in range(2):
        out = sweeps.sweep(spark, f"file://{tmp_path}", square, sweeps.grid(x=[1, 2], y=10))
        assert out.agg(F.sum("f")).first()[0] == 25
    assert ran == [1, 2]


def test_ensemble_means(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "u long, v long")
    one = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.2), (8, 9, 1.0)], "u long, v long, probability double")
    two = spark.createDataFrame([(1, 2, 0.5)], "u long, v long, probability double")
    got = {(r.u, r.v): (round(r.probability, 6), r.linked) for r in links.ensemble(pairs, [one, two]).collect()}
    assert got == {(1, 2): (0.7, True), (1, 3): (0.2, False), (2, 3): (0.0, False)}
