"""Queries on stored graphs, online partitioners and reports; registered in ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import RING, G, S, query
from .functions import expr, sql
from .operators import graph, reports, stored, training, vectors
from .operators.order import buffers
from .plans import views
from .streaming import partitioners

U = "('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
BUF = f"{S}, b AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 1000 AS buffer FROM st)"


def _u(key: str, seed: int = 7) -> str:
    return U.format(seed=seed, key=key)


@query(f"WITH {G} SELECT id, row_number() OVER (ORDER BY id) - 1 AS code FROM vs")
def relabel_sorted(spark: SparkSession, d: str) -> DataFrame:
    return stored.relabel_sorted(graph.vertices(views.g_purchase(spark, d)))


@query(f"WITH {G} SELECT src AS id, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS near FROM adj GROUP BY src")
def neighbours_of(spark: SparkSession, d: str) -> DataFrame:
    return stored.neighbours(views.g_purchase(spark, d)).select("id", F.array_join(F.transform("near", lambda x: x.cast("string")), " ").alias("near"))


@query(f"WITH {G}, asked AS (SELECT i AS u, i + 1 AS v FROM range(50) t(i)) SELECT asked.u, asked.v, EXISTS (SELECT 1 FROM adj WHERE src = asked.u AND dst = asked.v) AS present FROM asked")
def has_edges(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.range(50).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    return stored.has_edges(views.g_purchase(spark, d), asked)


@query(f"WITH {G} SELECT u, v FROM (SELECT u, v FROM g UNION SELECT i, i + 1 FROM range(20) t(i)) WHERE NOT (v = u + 2 AND u % 2 = 0) AND u % 11 <> 0 AND v % 11 <> 0")
def edited_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges added and removed, either way round, then vertices removed."""
    g, n = views.g_purchase(spark, d), spark.range(20)
    g = stored.add_edges(g, n.select((F.col("id") + 1).alias("u"), F.col("id").alias("v")))
    g = stored.remove_edges(g, g.where("v = u + 2 and u % 2 = 0").select(F.col("v").alias("u"), F.col("u").alias("v")))
    return stored.remove_vertices(g, graph.vertices(g).where("id % 11 = 0"))


@query(f"WITH {G}, v AS (SELECT DISTINCT user_id AS id FROM events) SELECT v.id, count(adj.src) AS degree FROM v LEFT JOIN adj ON adj.src = v.id GROUP BY v.id")
def degree_with_isolates(spark: SparkSession, d: str) -> DataFrame:
    users = views.table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    return stored.degrees_of(users, views.g_purchase(spark, d))


RINGS = "r1 AS (SELECT 'shard' || s AS shard, sha256('shard' || s || ':' || r) AS k FROM range(8) a(s), range(3) b(r)), r2 AS (SELECT 'shard' || s AS shard, sha256('shard' || s || ':' || r) AS k FROM range(9) a(s), range(3) b(r) WHERE s <> 3)"


@query(f"WITH {RINGS}, h AS (SELECT c_custkey AS key, sha256(c_custkey::VARCHAR) AS h FROM customer), m AS (SELECT key, coalesce((SELECT arg_min(shard, k) FROM r1 WHERE k > h), (SELECT arg_min(shard, k) FROM r1)) AS old, coalesce((SELECT arg_min(shard, k) FROM r2 WHERE k > h), (SELECT arg_min(shard, k) FROM r2)) AS new FROM h) SELECT key, old, new FROM m WHERE old <> new")
def ring_moves(spark: SparkSession, d: str) -> DataFrame:
    """Keys that move when one shard goes and another comes."""
    keys = views.table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    names = [f"shard{k}" for k in range(8)]
    return stored.moved(keys, stored.ring(spark, names), stored.ring(spark, [x for x in [*names, "shard8"] if x != "shard3"]))


@query(f"WITH {G}, {RING}, p AS (SELECT id, sha256('buys:' || id) AS h FROM vs), s AS (SELECT id, coalesce((SELECT arg_min(shard, k) FROM ring WHERE k > h), (SELECT arg_min(shard, k) FROM ring)) AS shard FROM p) SELECT shard, count(DISTINCT id) AS vertices, count(*) AS out_edges FROM s JOIN adj ON adj.src = s.id GROUP BY shard")
def shard_contents(spark: SparkSession, d: str) -> DataFrame:
    g = views.g_purchase(spark, d)
    v, e = stored.sharded("buys", graph.vertices(g), g, stored.ring(spark, [f"shard{k}" for k in range(8)]))
    return v.groupBy("shard").agg(F.count("*").alias("vertices")).join(e.groupBy("shard").agg(F.count("*").alias("out_edges")), "shard")


@query(f"WITH {S}, a AS (SELECT id AS vertex, (id % 4)::INT AS part FROM (SELECT DISTINCT src AS id FROM st UNION SELECT dest FROM st) UNION SELECT id, (id % 3)::INT FROM (SELECT DISTINCT src AS id FROM st UNION SELECT dest FROM st)) SELECT seq, a.part FROM st JOIN a ON a.vertex = st.src JOIN a b ON b.vertex = st.dest AND b.part = a.part")
def events_inside_parts(spark: SparkSession, d: str) -> DataFrame:
    s = views.stream_all(spark, d)
    ids = s.select(F.explode(F.array("src", "dest")).alias("vertex")).distinct()
    assign = ids.select("vertex", (F.col("vertex") % 4).cast("int").alias("part")).unionByName(ids.select("vertex", (F.col("vertex") % 3).cast("int").alias("part"))).distinct()
    return partitioners.inside_events(s, assign).select("seq", "part")


@query(f"WITH {S}, e AS (SELECT DISTINCT least(src, dest) AS u, greatest(src, dest) AS v FROM st WHERE op = 'ADD'), dg AS (SELECT x, count(*) AS n FROM (SELECT u AS x FROM e UNION ALL SELECT v FROM e) GROUP BY x), t AS (SELECT max(n) AS top FROM dg) SELECT seq FROM st LEFT JOIN dg a ON a.x = src LEFT JOIN dg b ON b.x = dest CROSS JOIN t WHERE {_u('seq')} <= (coalesce(a.n, 0) + coalesce(b.n, 0)) / (2.0::DOUBLE * top)")
def events_by_degree(spark: SparkSession, d: str) -> DataFrame:
    s = partitioners.degree_chance(views.stream_all(spark, d))
    return partitioners.sampled_events(s, F.col("chance")).select("seq")


@query(f"WITH {G}, k AS (SELECT u, v, {_u('u || chr(58) || v', 5)} AS x FROM g) SELECT u, v FROM k ORDER BY x, u, v LIMIT 40")
def holdout_edges(spark: SparkSession, d: str) -> DataFrame:
    """Exactly 40 edges held out, without replacement."""
    return views.g_purchase(spark, d).orderBy(expr.uniform(5, F.col("u"), F.col("v")), "u", "v").limit(40)


@query(f"WITH {S}, a AS (SELECT DISTINCT src AS vertex FROM st WHERE op = 'ADD' UNION SELECT dest FROM st WHERE op = 'ADD') SELECT vertex, p::INT AS part FROM a, range(3) t(p)")
def assign_catch_all(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "vertex long, part int")
    return partitioners.partitioner("catch_all")(views.stream_all(spark, d), none, 3)


_ACT = "a AS (SELECT DISTINCT src AS vertex FROM st WHERE op = 'ADD' UNION SELECT dest FROM st WHERE op = 'ADD'), known AS (SELECT vertex, 0 AS part FROM a WHERE vertex % 5 = 0 UNION ALL SELECT vertex, 2 FROM a WHERE vertex % 5 = 1)"
_DRAW = "c AS (SELECT part, sum(w) OVER (ORDER BY part) / sum(w) OVER () AS e FROM w WHERE w > 0), f AS (SELECT vertex, {u} AS u FROM a WHERE vertex % 5 > 1) SELECT vertex, part FROM known UNION ALL SELECT vertex, coalesce((SELECT arg_min(part, e) FROM c WHERE e > u), (SELECT arg_max(part, e) FROM c)) FROM f"


def _known(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = views.stream_all(spark, d)
    a = partitioners.active(s)
    return s, a.where("vertex % 5 < 2").select("vertex", F.when(F.col("vertex") % 5 == 0, 0).otherwise(2).alias("part"))


@query(f"WITH {S}, {_ACT}, w AS (SELECT p AS part, 1.0::DOUBLE AS w FROM range(4) t(p)), {_DRAW.format(u=_u('vertex'))}")
def assign_random(spark: SparkSession, d: str) -> DataFrame:
    """Vertices seen before keep their part, others draw one."""
    return partitioners.partitioner("random")(*_known(spark, d), 4)


@query(f"WITH {S}, {_ACT}, z AS (SELECT p AS part, count(vertex) AS n FROM range(4) t(p) LEFT JOIN known ON known.part = p GROUP BY p), w AS (SELECT part, (max(n) OVER () + 1 - n)::DOUBLE AS w FROM z), {_DRAW.format(u=_u('vertex'))}")
def assign_random_size(spark: SparkSession, d: str) -> DataFrame:
    return partitioners.partitioner("random_size")(*_known(spark, d), 4)


@query(f"WITH {S}, {_ACT}, en AS (SELECT src AS vertex FROM st WHERE op = 'ADD' UNION ALL SELECT dest FROM st WHERE op = 'ADD'), w AS (SELECT part, count(*)::DOUBLE AS w FROM en JOIN known USING (vertex) GROUP BY part), {_DRAW.format(u=_u('vertex'))}")
def assign_random_degree(spark: SparkSession, d: str) -> DataFrame:
    return partitioners.partitioner("random_degree")(*_known(spark, d), 4)


@query(f"WITH {BUF}, ad AS (SELECT DISTINCT buffer, src AS vertex FROM b WHERE op = 'ADD' UNION SELECT buffer, dest FROM b WHERE op = 'ADD'), n AS (SELECT DISTINCT buffer FROM b) SELECT n.buffer, p::INT AS part, count(vertex) AS size FROM n CROSS JOIN range(4) t(p) LEFT JOIN ad ON ad.buffer = n.buffer AND vertex * vertex % 4 = p GROUP BY 1, 2")
def sizes_per_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the parts among each buffer's vertices, 0 where a part has none."""
    b = buffers(views.stream_all(spark, d), 1000, "seq")
    grid = b.select("buffer").distinct().select("buffer", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part"))
    held = b.where("op = 'ADD'").select("buffer", F.explode(F.array("src", "dest")).alias("vertex")).distinct()
    n = held.groupBy("buffer", (F.col("vertex") * F.col("vertex") % 4).cast("int").alias("part")).agg(F.count("*").alias("size"))
    return grid.join(n, ["buffer", "part"], "left").select("buffer", "part", F.coalesce("size", F.lit(0)).alias("size"))


@query(f"WITH {S} SELECT (SELECT count(*) FROM st) AS events, (SELECT ceil(count(*) / 1000.0)::BIGINT FROM st) AS buffers, (SELECT count(*) FROM (SELECT src FROM st UNION SELECT dest FROM st)) AS vertices")
def stream_profile(spark: SparkSession, d: str) -> DataFrame:
    return partitioners.profile(views.stream_all(spark, d), 1000)


@query(f"WITH {BUF}, before AS (SELECT least(src, dest) AS u, greatest(src, dest) AS v, max_by(op, seq) AS op FROM b WHERE buffer = 0 GROUP BY 1, 2), after AS (SELECT least(src, dest) AS u, greatest(src, dest) AS v, max_by(op, seq) AS op FROM b WHERE buffer = 1 GROUP BY 1, 2) SELECT coalesce(after.u, before.u) AS u, coalesce(after.v, before.v) AS v FROM before FULL JOIN after ON after.u = before.u AND after.v = before.v WHERE coalesce(after.op, before.op) = 'ADD'")
def edges_after_deletions(spark: SparkSession, d: str) -> DataFrame:
    b = buffers(views.stream_all(spark, d), 1000, "seq")
    return partitioners.with_deletions(graph.fold_events(b.where("buffer = 0")), b.where("buffer = 1"))


@query(f"WITH {BUF}, o AS (SELECT buffer, seq, row_number() OVER (PARTITION BY buffer ORDER BY {_u('seq')}, seq) AS r FROM b), t AS (SELECT buffer, seq AS takes, row_number() OVER (PARTITION BY buffer ORDER BY seq) AS r FROM b) SELECT seq, takes FROM o JOIN t USING (buffer, r)")
def bounded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return reports.bounded_shuffle(views.stream_all(spark, d), 1000, "seq")


@query(f"WITH {G}, c AS (SELECT k, round(1 - count(*) FILTER (u % k = v % k) / count(*), 6) AS corruption FROM g, range(2, 6) t(k) GROUP BY k) SELECT 'mod' || k AS name, corruption FROM c WHERE corruption < 1 ORDER BY corruption, name LIMIT 1")
def least_corrupt(spark: SparkSession, d: str) -> DataFrame:
    g = views.g_purchase(spark, d)
    return reports.least_corrupt(g, {f"mod{k}": views.hashed(g, k) for k in range(2, 6)})


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def mean_and_std(spark: SparkSession, d: str) -> DataFrame:
    return reports.mean_std(views.table(spark, d, "events"), ["event_type"], "value")


@query("WITH c AS (SELECT user_id, event_type AS solver, count(*) AS calls FROM events GROUP BY 1, 2) SELECT solver, a AS alpha, round(avg(CASE WHEN calls <= a THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM c, range(11) t(a) GROUP BY 1, 2")
def data_profile(spark: SparkSession, d: str) -> DataFrame:
    calls = views.table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("solver")).agg(F.count("*").alias("calls"))
    return reports.data_profile(calls, "solver", "calls", 10)


@query("WITH RECURSIVE p AS (SELECT k, floor(value * 100)::DOUBLE AS y FROM (SELECT event_id % 40 AS k, min(value) AS value FROM events GROUP BY 1)), o AS (SELECT row_number() OVER (ORDER BY k) AS r, y, lead(y) OVER (ORDER BY k) AS n FROM p), s(r, y) AS (SELECT r, y FROM o WHERE r = 1 UNION ALL SELECT o.r, CASE WHEN o.n IS NULL THEN o.y ELSE (s.y + o.y + o.n) / 3 END FROM s JOIN o ON o.r = s.r + 1) SELECT r AS at, round(y, 6) AS y FROM s")
def smoothing(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "events").groupBy((F.col("event_id") % 40).alias("k")).agg(F.floor(F.min("value") * 100).cast("double").alias("v"))
    return reports.smoothed(p, "k", "v").select(F.posexplode("y").alias("at", "y")).select((F.col("at") + 1).alias("at"), F.round("y", 6).alias("y"))


@query(f"WITH s AS (SELECT c_nationkey AS part, p, q, round(avg({_u('c_custkey || chr(58) || p || chr(58) || q')}), 6) AS f1 FROM customer, range(5) a(p), range(5) b(q) GROUP BY 1, 2, 3) SELECT part, p, q, f1 FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY f1 DESC, p, q) AS r FROM s) WHERE r = 1")
def best_grid_model(spark: SparkSession, d: str) -> DataFrame:
    """The best of a 5 x 5 grid of p and q for each part."""
    grid = spark.range(5).select(F.col("id").alias("p")).crossJoin(spark.range(5).select(F.col("id").alias("q")))
    scored = views.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("part")).crossJoin(F.broadcast(grid))
    f1 = scored.groupBy("part", "p", "q").agg(F.round(F.avg(expr.uniform(7, F.col("c_custkey"), F.col("p"), F.col("q"))), 6).alias("f1"))
    return reports.best_of(f1, ["part"], "f1", ["p", "q"])


@query("WITH s AS (SELECT n_regionkey AS region, n_name AS model, round(avg(c_acctbal), 4) AS score FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) SELECT * FROM (SELECT region, model, score, row_number() OVER (PARTITION BY region ORDER BY score DESC, model)::INT AS rank FROM s) WHERE rank <= 3")
def top_three_models(spark: SparkSession, d: str) -> DataFrame:
    c, n = views.table(spark, d, "customer"), views.table(spark, d, "nation")
    s = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").alias("region"), F.col("n_name").alias("model")).agg(F.round(F.avg("c_acctbal"), 4).alias("score"))
    return reports.top_models(s, ["region"], "score", "model")


@query("WITH p AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label = b.label AS linked, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON b.vec_id - a.vec_id BETWEEN 1 AND 20) SELECT linked, count(*) AS n, round(avg(d), 5) AS mean, round(stddev_pop(d), 5) AS std FROM p GROUP BY linked")
def dot_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = views.vectors(spark, d)
    near = e.select(F.col("id").alias("i"), F.col("label").alias("l"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 20)).alias("j"))
    pairs = near.join(e.select(F.col("id").alias("j"), F.col("label").alias("m")), "j").select("i", "j", (F.col("l") == F.col("m")).alias("linked"))
    return reports.dot_statistics(e, pairs)


@query(f"SELECT c_custkey AS id, round(({_u('c_custkey || chr(58) || 0')} - 0.5) / 4, 9) AS x, round(({_u('c_custkey || chr(58) || 3')} - 0.5) / 4, 9) AS y FROM customer")
def fresh_embedding_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.fresh_rows(views.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), 4)
    return rows.select("id", F.round(F.col("vec")[0], 9).alias("x"), F.round(F.col("vec")[3], 9).alias("y"))


@query("WITH RECURSIVE l(i, x) AS (SELECT 0::BIGINT, 99::BIGINT UNION ALL SELECT i + 1, (x * 48271 + 11) % 2147483647 FROM l WHERE i < 3600), p AS (SELECT a AS u, b AS v FROM range(60) s(a), range(60) t(b) WHERE a < b) SELECT u, v FROM p JOIN l ON l.i = u * 60 + v WHERE x / 2147483647.0::DOUBLE < CASE WHEN u // 20 = v // 20 THEN 0.3 ELSE 0.05 END")
def virtual_block_model(spark: SparkSession, d: str) -> DataFrame:
    """An edge exists if the generator's value at its index is below its blocks' probability; no edge needs another one."""
    u, v = spark.range(60).withColumnRenamed("id", "u"), spark.range(60).withColumnRenamed("id", "v")
    drawn = expr.lcg(expr.edge_index(F.col("u"), F.col("v"), 60), 99, 48271, 11, 2147483647) / F.lit(2147483647.0)
    same = F.floor(F.col("u") / 20) == F.floor(F.col("v") / 20)
    return u.join(F.broadcast(v), F.col("u") < F.col("v")).where(drawn < F.when(same, 0.3).otherwise(0.05)).select("u", "v")


@query("SELECT i AS x, round(CASE WHEN i > 0 THEN log2(i) ELSE '-inf'::DOUBLE END, 9) AS l, least(i, 3) * 20 + greatest(i, 3) AS edge, (i + 1) * (SELECT min(k) FROM range(1, 101) t(k) WHERE k * (o.i + 1) % 101 = 1) % 101 AS one FROM range(20) o(i)")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """Safe logarithm, edge index, and a number times its modular inverse."""
    x = F.col("id")
    one = (x + 1) * expr.mod_inverse(x + 1, 101) % 101
    return spark.range(20).select(x.alias("x"), F.round(expr.safe_log2(x.cast("double")), 9).alias("l"), expr.edge_index(x, F.lit(3).cast("long"), 20).alias("edge"), one.alias("one"))


@query()
def kmeans_ari(spark: SparkSession, d: str) -> DataFrame:
    """Ten clusters of the embeddings against their labels; the library's KMeans with a fixed seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from .operators import quality

    e = views.vectors(spark, d).withColumn("features", array_to_vector("vec"))
    found = KMeans(k=10, seed=7, maxIter=10).fit(e).transform(e)
    return quality.adjusted_rand(found.select("label", "prediction"), "label", "prediction")


@query()
def dynnode2vec_stream(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings after two buffers of the stream: the second one trains on from the first."""
    from .streaming import embeddings

    b = buffers(views.stream_all(spark, d), 1000, "seq").where("buffer < 2")
    edges, emb = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], embeddings.EMB)
    for k in range(2):
        edges, emb = embeddings.update(edges, emb, b.where(F.col("buffer") == k), n_walks=2, length=8, dim=16, epochs=1)
    return emb


@query()
def entropy_walks(spark: SparkSession, d: str) -> DataFrame:
    from .streaming import embeddings

    g = views.g_purchase(spark, d)
    found = embeddings.entropy_walks(g, graph.vertices(g), 1, 16)
    return found.select("start", "walk", F.size("path").alias("length"))


@query()
def semantic_assign(spark: SparkSession, d: str) -> DataFrame:
    """The assignment after one buffer placed by embeddings, with half of its vertices in two parts before."""
    from .streaming import embeddings

    first = buffers(views.stream_all(spark, d), 500, "seq").where("buffer = 0")
    known = partitioners.active(first).where("vertex % 2 = 0").select("vertex", (F.col("vertex") % 4).cast("int").alias("part"))
    none = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], embeddings.EMB)
    return embeddings.semantic_push(*none, known, first, 4, n_walks=2, length=6, dim=8, epochs=1)[2]


@query(f"WITH {S}, q AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY seq) AS at, dest FROM st WHERE seq < 3000) SELECT a.dest AS target, b.dest AS context, count(*) AS n FROM q a JOIN q b ON a.src = b.src AND abs(a.at - b.at) <= 3 AND a.at <> b.at GROUP BY 1, 2")
def skipgram_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within three places of each user's first events."""
    s = views.stream_all(spark, d).where("seq < 3000")
    paths = s.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "dest"))), lambda x: x.dest).alias("path"))
    return training.skipgrams(paths, 3)


_NEG = " || chr(58) || "


@query(f"WITH t AS (SELECT c_custkey AS target, c_nationkey::BIGINT AS context FROM customer), x AS (SELECT target, context, k, least(floor(exp({_u(_NEG.join(['target', 'context', 'k']))} * ln(51.0::DOUBLE)))::BIGINT - 1, 49) AS c FROM t, range(12) r(k)), f AS (SELECT target, c, min(k) AS k FROM x WHERE c <> context GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY k) AS r FROM f) SELECT target, string_agg(c::VARCHAR, ' ' ORDER BY k) AS negatives FROM o WHERE r <= 3 GROUP BY target")
def negatives_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = views.table(spark, d, "customer").select(F.col("c_custkey").alias("target"), F.col("c_nationkey").cast("long").alias("context"))
    found = training.with_negatives(pairs, 50, 3)
    return found.select("target", F.array_join(F.transform("negatives", lambda x: x.cast("string")), " ").alias("negatives"))


@query(f"WITH c AS (SELECT c_custkey AS src, n_nationkey AS dst, n_nationkey + 1 AS w FROM customer, nation WHERE n_nationkey % 5 = c_custkey % 5), k AS (SELECT src, dst, -ln(1.0::DOUBLE - {_u('src || chr(58) || dst')}) / w AS x FROM c) SELECT src AS vertex, arg_min(dst, x) AS next FROM k GROUP BY src")
def weighted_hop(spark: SparkSession, d: str) -> DataFrame:
    c, n = views.table(spark, d, "customer"), views.table(spark, d, "nation")
    adj = c.join(F.broadcast(n), c.c_custkey % 5 == n.n_nationkey % 5).select(F.col("c_custkey").alias("src"), F.col("n_nationkey").alias("dst"), (F.col("n_nationkey") + 1).alias("weight"))
    return training.weighted_hops(adj)


@query("WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part) SELECT s_suppkey, p_partkey FROM a JOIN b USING (r)")
def zip_by_position(spark: SparkSession, d: str) -> DataFrame:
    a, b = views.table(spark, d, "supplier").select("s_suppkey"), views.table(spark, d, "part").select("p_partkey")
    return training.zipped(a, b, "s_suppkey", "p_partkey")


@query(f"WITH {BUF}, a AS (SELECT id AS vertex, id % 4 AS part FROM (SELECT DISTINCT src AS id FROM st UNION SELECT dest FROM st) UNION SELECT id, id % 3 FROM (SELECT DISTINCT src AS id FROM st UNION SELECT dest FROM st)), k AS (SELECT DISTINCT seq FROM b JOIN a ON a.vertex = b.src JOIN a c ON c.vertex = b.dest AND c.part = a.part) SELECT buffer, count(*) AS events, count(*) - count(k.seq) AS lost, round((count(*) - count(k.seq)) / count(*), 6) AS fraction FROM b LEFT JOIN k USING (seq) GROUP BY buffer")
def lost_with_replicas(spark: SparkSession, d: str) -> DataFrame:
    """Events that no part holds whole, where vertices may be in several parts."""
    s = views.stream_all(spark, d)
    ids = s.select(F.explode(F.array("src", "dest")).alias("vertex")).distinct()
    assign = ids.select("vertex", (F.col("vertex") % 4).alias("part")).unionByName(ids.select("vertex", (F.col("vertex") % 3).alias("part"))).distinct()
    return training.lost_per_buffer(buffers(s, 1000, "seq"), assign)


@query(f"WITH {G}, c AS (SELECT k, round(1 - count(*) FILTER (u % k = v % k) / count(*), 6) AS y FROM g, range(1, 6) t(k) GROUP BY k) SELECT round(regr_slope(y, k - 1), 6) AS slope FROM c")
def slope_of_corruption(spark: SparkSession, d: str) -> DataFrame:
    return training.corruption_slope(views.g_purchase(spark, d), views.hashed, 5)


@query(f"WITH {G} SELECT vertex, degree, lost, row_number() OVER (ORDER BY lost DESC, vertex)::INT AS rank FROM (SELECT src AS vertex, count(*) AS degree, count(*) FILTER (src % 4 <> dst % 4) AS lost FROM adj GROUP BY src ORDER BY lost DESC, vertex LIMIT 10)")
def top_corrupt(spark: SparkSession, d: str) -> DataFrame:
    g = views.g_purchase(spark, d)
    return training.top_corrupt(g, views.hashed(g, 4))


@query(f"""WITH RECURSIVE {G}, walk(id, r) AS (SELECT id, id FROM vs UNION SELECT w.id, a.dst FROM walk w JOIN adj a ON a.src = w.r), users AS (SELECT DISTINCT user_id AS id FROM events),
dg AS (SELECT users.id, count(adj.src) AS k FROM users LEFT JOIN adj ON adj.src = users.id GROUP BY users.id), c AS (SELECT id, min(r) AS component FROM walk GROUP BY id),
sizes AS (SELECT count(*) AS n FROM c GROUP BY component UNION ALL SELECT 1 FROM dg WHERE k = 0), top AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM sizes),
tri AS (SELECT x.src AS id, count(*) AS t2 FROM adj x JOIN adj y ON x.dst = y.src JOIN adj z ON y.dst = z.src AND z.dst = x.src GROUP BY x.src)
SELECT 'component_' || r AS statistic, n::DOUBLE AS value FROM top WHERE r <= 3 UNION ALL SELECT 'components', count(*) FROM sizes UNION ALL SELECT 'isolates', count(*) FROM dg WHERE k = 0
UNION ALL SELECT 'degree_' || b, (SELECT count(*) FROM dg WHERE k = b) FROM range(5) t(b)
UNION ALL SELECT 'average_clustering', round(avg(CASE WHEN k > 1 THEN coalesce(t2, 0) / (k * (k - 1)) ELSE 0 END), 6) FROM dg LEFT JOIN tri USING (id)""")
def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Of the purchase graph, with users who never bought next to another as isolates."""
    users = views.table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    return reports.graph_statistics(users, views.g_purchase(spark, d))


@query(f"WITH {G}, other AS (SELECT DISTINCT u FROM g WHERE v % 3 = 0 UNION SELECT v FROM g WHERE v % 3 = 0) SELECT id FROM vs WHERE id NOT IN (SELECT u FROM other)")
def vertex_difference(spark: SparkSession, d: str) -> DataFrame:
    g = views.g_purchase(spark, d)
    return stored.vertices_only_in(g, g.where("v % 3 = 0"))


@query("WITH x AS (SELECT label AS part, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) AS pos FROM embeddings UNION ALL SELECT -1, unnest(embedding)::DOUBLE * s, generate_subscripts(embedding, 1) FROM embeddings, (VALUES (1), (-1)) t(s) WHERE vec_id < 10), m AS (SELECT part, pos, avg(c) AS c FROM x GROUP BY 1, 2) SELECT part, CASE WHEN max(abs(c)) > 1e-8 THEN round(sum(abs(c)), 6) END AS total FROM m GROUP BY part")
def centroids_or_none(spark: SparkSession, d: str) -> DataFrame:
    """Part -1 holds vectors and their opposites, so it has no centroid."""
    e = views.vectors(spark, d)
    some = e.where("id < 10")
    opposite = some.withColumn("vec", F.transform("vec", lambda x: -x))
    e = e.select(F.col("label").alias("part"), "vec").unionByName(some.unionByName(opposite).select(F.lit(-1).alias("part"), "vec"))
    return vectors.centroids_or_none(e).select("part", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("total"))


@query("SELECT c_custkey AS key, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END, c_nationkey) AS nation, coalesce(s_acctbal, c_acctbal) AS balance, c_mktsegment AS segment FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def parameter_overrides(spark: SparkSession, d: str) -> DataFrame:
    base = views.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    other = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("nation"), F.col("s_acctbal").alias("balance"), F.lit(0).alias("unknown"))
    return reports.with_overrides(base, other, "key")


@query("WITH t AS (SELECT l_returnflag, l_linenumber, avg(l_quantity) FILTER (l_linestatus = 'O') AS s, avg(l_quantity) FILTER (l_linestatus = 'F') AS p FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linenumber, round(s, 6) AS serial, round(p, 6) AS parallel, round(s / nullif(p, 0), 6) AS speedup FROM t")
def time_table(spark: SparkSession, d: str) -> DataFrame:
    return reports.time_table(views.table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"], "l_linestatus", "l_quantity", "O", "F")


@query("SELECT l_returnflag, l_linestatus, count(*) AS runs, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_pop(l_quantity), 6) AS l_quantity_std, round(avg(l_discount), 6) AS l_discount_mean, round(stddev_pop(l_discount), 6) AS l_discount_std FROM lineitem GROUP BY 1, 2")
def runs_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.runs_summary(views.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])


@query(f"WITH x AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) AS pos FROM embeddings), p AS (SELECT a.id, sum(a.c * b.c) AS dot, sum((a.c - b.c) * (a.c - b.c)) AS l2, sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c)) AS n FROM x a JOIN x b ON b.id = a.id + 1 AND a.pos = b.pos GROUP BY a.id) SELECT id, round(dot, 5) AS dot, round(l2, 5) AS l2, round(CASE WHEN n > 0 THEN dot / n ELSE 0 END, 5) AS cosine, round(1 / (1 + exp(-dot)), 5) AS link, round(2 * exp(-0.1::DOUBLE * id), 5) AS decayed, round({_u('id')}, 6) AS drawn, id * 1000 + id + 1 AS edge FROM p")
def sql_kernels(spark: SparkSession, d: str) -> DataFrame:
    """The library's expressions as functions of SQL."""
    sql.register(spark)
    e = views.vectors(spark, d).select("id", "vec")
    pairs = e.join(e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other")), "id")
    call = ["round(loom_dot(vec, other), 5) AS dot", "round(loom_l2_squared(vec, other), 5) AS l2", "round(loom_cosine(vec, other), 5) AS cosine", "round(loom_sigmoid(loom_dot(vec, other)), 5) AS link"]
    return pairs.selectExpr("id", *call, "round(loom_decay(2, id, 0.1), 5) AS decayed", "round(loom_uniform('7', cast(id AS STRING)), 6) AS drawn", "loom_edge_index(id + 1, id, 1000) AS edge")
