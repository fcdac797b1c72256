"""Queries over the driver tables and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr
from .operators import communities, generators, graph, links, placement, quality, vectors, walks
from .operators.order import buffers
from .plans import views
from .streaming import online

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

G = """ev AS (SELECT event_id AS seq, user_id AS src, lead(user_id) OVER (ORDER BY event_id) AS dest FROM events WHERE event_type = 'purchase'),
g AS (SELECT DISTINCT least(src, dest) AS u, greatest(src, dest) AS v FROM ev WHERE dest IS NOT NULL AND src <> dest),
adj AS (SELECT u AS src, v AS dst FROM g UNION ALL SELECT v, u FROM g),
vs AS (SELECT DISTINCT src AS id FROM adj)"""
S = """ev AS (SELECT event_id AS seq, user_id AS src, lead(user_id) OVER (ORDER BY event_id) AS dest, CASE WHEN event_type = 'error' THEN 'REMOVE' ELSE 'ADD' END AS op FROM events),
st AS (SELECT * FROM ev WHERE dest IS NOT NULL AND src <> dest)"""
E = "x AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) AS pos FROM embeddings)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {S}, p AS (SELECT least(src, dest) AS u, greatest(src, dest) AS v, op, row_number() OVER (PARTITION BY least(src, dest), greatest(src, dest) ORDER BY seq DESC) AS r FROM st) SELECT u, v FROM p WHERE r = 1 AND op = 'ADD'")
def event_fold_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.fold_events(views.stream_all(spark, d))


@query(f"WITH {S}, b AS (SELECT src AS node, 2 * seq AS k FROM st UNION ALL SELECT dest, 2 * seq + 1 FROM st), m AS (SELECT node, min(k) AS k FROM b GROUP BY node) SELECT node, row_number() OVER (ORDER BY k) - 1 AS code FROM m")
def vertex_encode(spark: SparkSession, d: str) -> DataFrame:
    return graph.dictionary(views.stream_all(spark, d))


@query(f"WITH {S}, p AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 1000 AS buffer FROM st) SELECT buffer, count(*) AS events, count(DISTINCT src) AS sources FROM p GROUP BY buffer")
def count_buffers(spark: SparkSession, d: str) -> DataFrame:
    return buffers(views.stream_all(spark, d), 1000, "seq").groupBy("buffer").agg(F.count("*").alias("events"), F.countDistinct("src").alias("sources"))


@query(f"WITH {S} SELECT seq, src, dest, op FROM st ORDER BY seq LIMIT 500")
def limit_first_n(spark: SparkSession, d: str) -> DataFrame:
    return views.stream_all(spark, d).orderBy("seq").limit(500).select("seq", "src", "dest", "op")


@query(f"WITH {G} SELECT u, v FROM g")
def purchase_edges(spark: SparkSession, d: str) -> DataFrame:
    return views.g_purchase(spark, d)


@query(f"WITH {G} SELECT src AS id, count(*) AS degree FROM adj GROUP BY src")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree(views.g_purchase(spark, d))


@query(f"WITH {G}, dg AS (SELECT src, count(*) AS degree FROM adj GROUP BY src) SELECT degree, count(*) AS vertices FROM dg GROUP BY degree")
def degree_hist(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree(views.g_purchase(spark, d)).groupBy("degree").agg(F.count("*").alias("vertices"))


@query(f"WITH {G} SELECT (SELECT count(*) FROM vs) AS vertices, (SELECT count(*) FROM g) AS edges, round(2.0 * (SELECT count(*) FROM g) / (SELECT count(*) FROM vs), 6) AS avg_degree")
def avg_degree(spark: SparkSession, d: str) -> DataFrame:
    n = graph.degree(views.g_purchase(spark, d)).agg(F.count("*").alias("vertices"), (F.sum("degree") / 2).cast("long").alias("edges"))
    return n.select("vertices", "edges", F.round(2.0 * F.col("edges") / F.col("vertices"), 6).alias("avg_degree"))


@query(f"WITH {G} SELECT u, v FROM g WHERE u % 3 = 0 AND v % 3 = 0")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    g = views.g_purchase(spark, d)
    return graph.induced(g, graph.vertices(g).where("id % 3 = 0"))


def _halves(spark: SparkSession, d: str):
    p = views.purchases(spark, d)
    return graph.canonical(p.where("seq % 2 = 0")), graph.canonical(p.where("seq % 3 = 0"))


H = f"""{G}, a AS (SELECT DISTINCT least(src, dest) AS u, greatest(src, dest) AS v FROM ev WHERE dest IS NOT NULL AND src <> dest AND seq % 2 = 0),
b AS (SELECT DISTINCT least(src, dest) AS u, greatest(src, dest) AS v FROM ev WHERE dest IS NOT NULL AND src <> dest AND seq % 3 = 0)"""


@query(f"WITH {H} SELECT u, v FROM a UNION SELECT u, v FROM b")
def graph_union(spark: SparkSession, d: str) -> DataFrame:
    return graph.union(*_halves(spark, d))


@query(f"WITH {H} SELECT u, v FROM a EXCEPT SELECT u, v FROM b")
def graph_difference(spark: SparkSession, d: str) -> DataFrame:
    return graph.difference(*_halves(spark, d))


@query(f"WITH {H} (SELECT u, v FROM a EXCEPT SELECT u, v FROM b) UNION (SELECT u, v FROM b EXCEPT SELECT u, v FROM a)")
def graph_symdiff(spark: SparkSession, d: str) -> DataFrame:
    return graph.symmetric_difference(*_halves(spark, d))


@query(f"WITH {G}, c AS (SELECT g.u, g.v, count(*) AS common FROM g JOIN adj a ON a.src = g.u JOIN adj b ON b.src = g.v AND a.dst = b.dst GROUP BY g.u, g.v) SELECT g.u, g.v, coalesce(common, 0) AS common FROM g LEFT JOIN c ON c.u = g.u AND c.v = g.v")
def common_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.common_neighbours(views.g_purchase(spark, d))


@query(f"WITH {G}, c AS (SELECT x.src AS id, count(*) AS t2 FROM adj x JOIN adj y ON x.dst = y.src JOIN adj z ON y.dst = z.src AND z.dst = x.src GROUP BY x.src), dg AS (SELECT src AS id, count(*) AS k FROM adj GROUP BY src) SELECT dg.id, round(CASE WHEN k > 1 THEN coalesce(t2, 0) / (k * (k - 1)) ELSE 0 END, 6) AS clustering FROM dg LEFT JOIN c ON c.id = dg.id")
def clustering_coeff(spark: SparkSession, d: str) -> DataFrame:
    return graph.clustering(views.g_purchase(spark, d)).select("id", F.round("clustering", 6).alias("clustering"))


@query(f"WITH {G}, dg AS (SELECT src AS id, count(*) AS k FROM adj GROUP BY src), c AS (SELECT a.src AS u, b.src AS v, count(*) AS cm FROM adj a JOIN adj b ON a.dst = b.dst JOIN g ON g.u = a.src AND g.v = b.src GROUP BY 1, 2) SELECT g.u, g.v, round(CASE WHEN p.k = coalesce(cm, 0) THEN 0 ELSE tanh(1.0 / (p.k - coalesce(cm, 0)) * greatest(p.k, q.k) / least(p.k, q.k)) END, 6) AS acceptance FROM g JOIN dg p ON p.id = g.u JOIN dg q ON q.id = g.v LEFT JOIN c ON c.u = g.u AND c.v = g.v")
def hop_acceptance(spark: SparkSession, d: str) -> DataFrame:
    g = views.g_purchase(spark, d)
    dg = graph.degree(g)
    e = graph.common_neighbours(g).join(dg.select(F.col("id").alias("u"), F.col("degree").alias("k")), "u").join(dg.select(F.col("id").alias("v"), F.col("degree").alias("q")), "v")
    p = F.tanh(1.0 / (F.col("k") - F.col("common")) * F.greatest("k", "q") / F.least("k", "q"))
    return e.select("u", "v", F.round(F.when(F.col("k") == F.col("common"), 0.0).otherwise(p), 6).alias("acceptance"))


@query(f"WITH {G} SELECT count(*) AS edges, count(*) FILTER (u % 4 <> v % 4) AS cut, round(count(*) FILTER (u % 4 <> v % 4) / count(*), 6) AS fraction FROM g")
def edge_cut(spark: SparkSession, d: str) -> DataFrame:
    g = views.g_purchase(spark, d)
    return quality.edge_cut(g, views.hashed(g, 4))


@query(f"WITH {S}, p AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 1000 AS buffer FROM st) SELECT buffer, count(*) FILTER (src % 4 <> dest % 4) AS lost, round(count(*) FILTER (src % 4 <> dest % 4) / count(*), 6) AS fraction FROM p GROUP BY buffer")
def lost_edges(spark: SparkSession, d: str) -> DataFrame:
    b = buffers(views.stream_all(spark, d), 1000, "seq")
    lost = F.count_if(F.col("src") % 4 != F.col("dest") % 4)
    return b.groupBy("buffer").agg(lost.alias("lost"), F.round(lost / F.count("*"), 6).alias("fraction"))


@query(f"WITH {G}, s AS (SELECT p.part, count(id) AS size FROM range(7) p(part) LEFT JOIN vs ON id * id % 7 = part GROUP BY 1), m AS (SELECT avg(size) AS mean FROM s) SELECT round(avg(abs(size - mean) / mean), 6) AS balance FROM s, m")
def balance(spark: SparkSession, d: str) -> DataFrame:
    v = graph.vertices(views.g_purchase(spark, d))
    return quality.balance(v.select(F.col("id").alias("vertex"), (F.col("id") * F.col("id") % 7).cast("int").alias("part")), 7)


R = f"{G}, asg AS (SELECT id AS vertex, id % 4 AS part FROM vs UNION SELECT id, (id // 4) % 4 FROM vs WHERE id % 2 = 0), n AS (SELECT g.u, g.v, count(*) AS n FROM g JOIN asg a ON a.vertex = u JOIN asg b ON b.vertex = v AND a.part = b.part GROUP BY 1, 2)"


def _replicated(g: DataFrame) -> DataFrame:
    v = graph.vertices(g)
    more = v.where("id % 2 = 0").select(F.col("id").alias("vertex"), (F.floor(F.col("id") / 4) % 4).cast("int").alias("part"))
    return views.hashed(g, 4).unionByName(more).distinct()


@query(f"WITH {R} SELECT round(1 - (SELECT count(*) FROM n) / (SELECT count(*) FROM g), 6) AS corruption")
def corruption(spark: SparkSession, d: str) -> DataFrame:
    g = views.g_purchase(spark, d)
    return quality.corruption(g, _replicated(g))


@query(f"WITH {R} SELECT round(1 - (SELECT count(*) FROM n WHERE n % 2 = 1) / (SELECT count(*) FROM g), 6) AS corruption")
def corruption_parity(spark: SparkSession, d: str) -> DataFrame:
    g = views.g_purchase(spark, d)
    return quality.corruption(g, _replicated(g), parity=True)


@query(f"WITH {G}, c AS (SELECT k, count(*) FILTER (u % k <> v % k) / count(*) AS corruption FROM g, range(1, 9) r(k) GROUP BY k) SELECT round(regr_slope(corruption, k - 1), 6) AS slope FROM c")
def corruptability_slope(spark: SparkSession, d: str) -> DataFrame:
    g = views.g_purchase(spark, d).crossJoin(F.broadcast(spark.range(1, 9).withColumnRenamed("id", "k")))
    c = g.groupBy("k").agg((F.count_if(F.col("u") % F.col("k") != F.col("v") % F.col("k")) / F.count("*")).alias("corruption"))
    return c.agg(F.round(F.regr_slope("corruption", F.col("k") - 1), 6).alias("slope"))


@query(f"WITH {G} SELECT round(coalesce(count(*) FILTER (u % 5 = v % 5 AND u % 4 <> v % 4) / nullif(count(*) FILTER (u % 5 = v % 5), 0), 0), 6) AS lost_intra, round(coalesce(count(*) FILTER (u % 5 <> v % 5 AND u % 4 <> v % 4) / nullif(count(*) FILTER (u % 5 <> v % 5), 0), 0), 6) AS separated_inter FROM g")
def sbm_partition_quality(spark: SparkSession, d: str) -> DataFrame:
    g = views.g_purchase(spark, d)
    truth = graph.vertices(g).select(F.col("id").alias("vertex"), (F.col("id") % 5).alias("community"))
    return quality.block_quality(g, truth, views.hashed(g, 4))


@query(f"WITH {G}, o AS (SELECT id AS vertex, id % 4 AS part FROM vs WHERE id % 5 <> 0), n AS (SELECT id AS vertex, CASE WHEN id % 7 = 0 THEN (id + 1) % 4 ELSE id % 4 END AS part FROM vs), sd AS ((SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL (SELECT * FROM n EXCEPT SELECT * FROM o)) SELECT count(*) // 2 AS repartitionings FROM sd WHERE vertex IN (SELECT vertex FROM o)")
def repartitionings(spark: SparkSession, d: str) -> DataFrame:
    new = views.hashed(views.g_purchase(spark, d), 4)
    moved = new.withColumn("part", F.when(F.col("vertex") % 7 == 0, (F.col("vertex") + 1) % 4).otherwise(F.col("part")).cast("int"))
    return quality.repartitionings(new.where("vertex % 5 <> 0"), moved)


@query(f"WITH RECURSIVE {G}, walk(id, r) AS (SELECT id, id FROM vs UNION SELECT w.id, a.dst FROM walk w JOIN adj a ON a.src = w.r) SELECT id, min(r) AS component FROM walk GROUP BY id")
def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(views.g_purchase(spark, d))


def _lpa_sql(rounds: int) -> str:
    steps = ["l0 AS (SELECT id, id AS label FROM vs)"]
    for k in range(rounds):
        steps.append(f"v{k} AS (SELECT src, label, count(*) AS n FROM adj JOIN l{k} ON id = dst GROUP BY src, label), l{k + 1} AS (SELECT src AS id, label FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS r FROM v{k}) WHERE r = 1)")
    return f"WITH {G}, {', '.join(steps)} SELECT id, label FROM l{rounds}"


@query(_lpa_sql(5))
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_rounds(views.g_purchase(spark, d), 5)


P = f"{E}, p AS (SELECT a.id AS i, b.id AS j, sum((a.c - b.c) * (a.c - b.c)) AS d FROM x a JOIN x b ON a.pos = b.pos AND a.id < b.id GROUP BY 1, 2)"


@query(f"WITH {P} SELECT i, j, round(d, 6) AS d FROM p ORDER BY p.d, i, j LIMIT 50")
def reconstruct_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.closest_pairs(views.vectors(spark, d), 50).select("i", "j", F.round("d", 6).alias("d"))


@query(f"WITH {E}, p AS (SELECT a.id AS i, b.id AS j, sum((a.c - b.c) * (a.c - b.c)) AS d FROM x a JOIN x b ON a.pos = b.pos AND a.id <> b.id GROUP BY 1, 2) SELECT i, arg_min(j, d) AS j, round(min(d), 6) AS d FROM p GROUP BY i")
def nearest_neighbor(spark: SparkSession, d: str) -> DataFrame:
    e = views.vectors(spark, d)
    return vectors.nearest_other(e, e)


@query(f"WITH {P}, k AS (SELECT i, j FROM p ORDER BY d, i, j LIMIT 500), t AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id - a.vec_id BETWEEN 1 AND 10), ts AS (SELECT i AS s, j AS e FROM t UNION ALL SELECT j, i FROM t), rs AS (SELECT i AS s, j AS e FROM k UNION ALL SELECT j, i FROM k), h AS (SELECT s, count(*) AS h FROM ts JOIN rs USING (s, e) GROUP BY s), r AS (SELECT avg(coalesce(h, 0) / n) AS r FROM (SELECT s, count(*) AS n FROM ts GROUP BY s) LEFT JOIN h USING (s)), q AS (SELECT avg(coalesce(h, 0) / n) AS p FROM (SELECT s, count(*) AS n FROM rs GROUP BY s) LEFT JOIN h USING (s)) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r, q")
def reconstruction_f1(spark: SparkSession, d: str) -> DataFrame:
    e = views.vectors(spark, d)
    rebuilt = vectors.closest_pairs(e, 500).select(F.col("i").alias("u"), F.col("j").alias("v"))
    a, b = e.select(F.col("id").alias("u"), "label"), e.select(F.col("id").alias("v"), "label")
    truth = a.join(b, "label").where("v - u between 1 and 10").select("u", "v")
    return quality.reconstruction_f1(truth, rebuilt)


@query(f"WITH {E}, m AS (SELECT label, pos, avg(c) AS c FROM x GROUP BY 1, 2) SELECT label AS part, round(sqrt(sum(c * c)), 6) AS norm, round(sum(c), 6) AS total FROM m GROUP BY label")
def partition_centroid(spark: SparkSession, d: str) -> DataFrame:
    c = vectors.merge_mean(views.vectors(spark, d), "label")
    return c.select(F.col("label").alias("part"), F.round(expr.norm(F.col("vec")), 6).alias("norm"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {E}, m AS (SELECT label AS part, pos, avg(c) AS c FROM x GROUP BY 1, 2), n AS (SELECT part, sqrt(sum(c * c)) AS n FROM m GROUP BY part), q AS (SELECT id, sqrt(sum(c * c)) AS n FROM x GROUP BY id), s AS (SELECT x.id, m.part, round(sum(x.c * m.c) / (any_value(q.n) * any_value(n.n)), 6) AS score FROM x JOIN m USING (pos) JOIN n USING (part) JOIN q ON q.id = x.id GROUP BY 1, 2) SELECT id, part, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, part) AS rank FROM s) WHERE rank <= 2")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = views.vectors(spark, d)
    c = vectors.merge_mean(e, "label").select(F.col("label").alias("part"), F.col("vec").alias("c"))
    return vectors.nearest_centroid(e.select("id", "vec"), c, 2)


@query("SELECT round((x - e) / ((ai + bj) / 2 - e), 6) AS ari FROM (SELECT *, ai * bj / (n * (n - 1) / 2) AS e FROM (SELECT (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) AS k FROM embeddings GROUP BY label, vec_id % 10)) AS x, (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) AS k FROM embeddings GROUP BY label)) AS ai, (SELECT sum(k * (k - 1) / 2) FROM (SELECT count(*) AS k FROM embeddings GROUP BY vec_id % 10)) AS bj, (SELECT count(*) FROM embeddings) AS n))")
def ari(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").select("label", (F.col("vec_id") % 10).alias("part"))
    return quality.adjusted_rand(e, "label", "part")


@query("WITH s AS (SELECT *, embedding[1]::DOUBLE + embedding[2]::DOUBLE AS score, (vec_id % 2)::INT AS y FROM embeddings) SELECT count(*) FILTER (y = 1 AND score > 0) AS tp, count(*) FILTER (y = 0 AND score > 0) AS fp, count(*) FILTER (y = 1 AND score <= 0) AS fn, count(*) FILTER (y = 0 AND score <= 0) AS tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / count(*), 6) AS accuracy FROM s")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = views.vectors(spark, d)
    score = F.element_at("vec", 1) + F.element_at("vec", 2)
    return quality.confusion(e.select((F.col("id") % 2).alias("y"), F.when(score > 0, 1).otherwise(0).alias("p")), "y", "p")


@query("WITH s AS (SELECT vec_id // 20 AS grp, vec_id % 20 AS at, embedding[1]::DOUBLE AS score FROM embeddings), r AS (SELECT 1 + count(n.score) FILTER (n.score > p.score) AS rank FROM s p LEFT JOIN s n ON n.grp = p.grp AND n.at > 0 WHERE p.at = 0 GROUP BY p.grp) SELECT round(avg(rank), 6) AS mean_rank, round(avg(1 / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS hits_1, round(avg((rank <= 10)::INT), 6) AS hits_10 FROM r")
def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = views.vectors(spark, d).select(F.floor(F.col("id") / 20).alias("grp"), (F.col("id") % 20).alias("at"), F.element_at("vec", 1).alias("score"))
    p = s.where("at = 0").select("grp", F.col("score").alias("target"))
    ranks = p.join(s.where("at > 0"), "grp", "left").groupBy("grp").agg((1 + F.count_if(F.coalesce(F.col("score") > F.col("target"), F.lit(False)))).alias("rank"))
    return quality.rank_metrics(ranks)


@query("WITH m AS (SELECT s_nationkey AS problem, l_returnflag AS solver, avg(l_quantity) AS metric FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2), r AS (SELECT *, metric / (min(metric) OVER (PARTITION BY problem) + 1e-9) AS ratio FROM m) SELECT solver, step, round(avg((ratio <= pow(10.0, 3.0 * step / 99))::INT), 6) AS share FROM r, range(100) t(step) GROUP BY 1, 2")
def performance_profile(spark: SparkSession, d: str) -> DataFrame:
    m = views.table(spark, d, "lineitem").join(views.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("problem"), F.col("l_returnflag").alias("solver")).agg(F.avg("l_quantity").alias("metric"))
    return quality.performance_profile(m, "problem", "solver", "metric")


@query("WITH RECURSIVE l(i, x) AS (SELECT 0::BIGINT, 12345::BIGINT UNION ALL SELECT i + 1, (x * 48271 + 11) % 2147483647 FROM l WHERE i < 999) SELECT i, x FROM l")
def lcg_values(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("i"), expr.lcg(F.col("id"), 12345, 48271, 11, 2147483647).alias("x"))


RING = "ring AS (SELECT 'shard' || s AS shard, sha256('shard' || s || ':' || r) AS k FROM range(8) a(s), range(3) b(r))"


@query(f"WITH {RING}, h AS (SELECT c_custkey AS key, sha256('customer:' || c_custkey) AS h FROM customer) SELECT key, coalesce((SELECT arg_min(shard, k) FROM ring WHERE k > h), (SELECT arg_min(shard, k) FROM ring)) AS shard FROM h")
def consistent_hash(spark: SparkSession, d: str) -> DataFrame:
    ring = spark.range(8).crossJoin(spark.range(3).withColumnRenamed("id", "r")).select(F.concat(F.lit("shard"), F.col("id")).alias("shard"), F.sha2(F.concat(F.lit("shard"), F.col("id"), F.lit(":"), F.col("r")).cast("binary"), 256).alias("k"))
    ring = ring.agg(F.sort_array(F.collect_list(F.struct("k", "shard"))).alias("ring"))
    keys = views.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.sha2(F.concat(F.lit("customer:"), F.col("c_custkey")).cast("binary"), 256).alias("h"))
    after = F.filter("ring", lambda x: x.k > F.col("h"))
    return keys.crossJoin(F.broadcast(ring)).select("key", F.when(F.size(after) > 0, F.element_at(after, 1)).otherwise(F.element_at("ring", 1))["shard"].alias("shard"))


@query("SELECT c_nationkey AS nation, sha256(string_agg(c_custkey::VARCHAR, '|' ORDER BY c_custkey)) AS set_hash FROM customer GROUP BY 1")
def set_hash(spark: SparkSession, d: str) -> DataFrame:
    ids = F.concat_ws("|", F.transform(F.array_sort(F.collect_set("c_custkey")), lambda x: x.cast("string")))
    return views.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.sha2(ids.cast("binary"), 256).alias("set_hash"))


@query(f"WITH {S}, b AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 1000 AS buffer FROM st), ad AS (SELECT buffer, src AS x, dest AS y FROM b UNION SELECT buffer, dest, src FROM b) SELECT buffer, x AS vertex, y % 4 AS part, count(*) AS score FROM ad GROUP BY 1, 2, 3")
def neighbor_partition_score(spark: SparkSession, d: str) -> DataFrame:
    b = buffers(views.stream_all(spark, d), 1000, "seq")
    both = b.select("buffer", "src", "dest").unionByName(b.select("buffer", F.col("dest").alias("src"), F.col("src").alias("dest"))).distinct()
    return both.groupBy("buffer", F.col("src").alias("vertex"), (F.col("dest") % 4).alias("part")).agg(F.count("*").alias("score"))


@query(f"WITH {S}, q AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY seq) AS at, dest FROM st) SELECT a.src, a.dest AS target, b.dest AS context, count(*) AS n FROM q a JOIN q b ON a.src = b.src AND abs(a.at - b.at) <= 2 AND a.at <> b.at GROUP BY 1, 2, 3")
def skipgram_pairs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    q = views.stream_all(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("src").orderBy("seq")))
    near = q.select("src", F.col("dest").alias("target"), F.explode(F.array(*[F.col("at") + k for k in (-2, -1, 1, 2)])).alias("at"))
    return near.join(q.select("src", "at", F.col("dest").alias("context")), ["src", "at"]).groupBy("src", "target", "context").agg(F.count("*").alias("n"))


@query("WITH u AS (SELECT c_custkey AS id, s, ('0x' || substr(md5('7:' || c_custkey || ':' || s), 1, 8))::BIGINT / 4294967296.0 AS u FROM customer, range(5) t(s)) SELECT id, s, floor(exp(u * ln(1001)))::BIGINT - 1 AS negative FROM u")
def negative_samples(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(5)])).alias("s"))
    return c.select("id", "s", (F.floor(F.exp(expr.uniform(7, F.col("id"), F.col("s")) * F.log(F.lit(1001.0)))) - 1).cast("long").alias("negative"))


@query("WITH e AS (SELECT i, j, ('0x' || substr(md5('3:' || i || ':' || j), 1, 8))::BIGINT / 4294967296.0 AS u FROM range(200) a(i), range(200) b(j) WHERE i < j) SELECT i AS u, j AS v FROM e WHERE e.u < CASE WHEN i // 50 = j // 50 THEN 0.1 ELSE 0.01 END")
def sbm_edges(spark: SparkSession, d: str) -> DataFrame:
    i, j = spark.range(200).withColumnRenamed("id", "u"), spark.range(200).withColumnRenamed("id", "v")
    same = F.floor(F.col("u") / 50) == F.floor(F.col("v") / 50)
    return i.join(F.broadcast(j), F.col("u") < F.col("v")).where(expr.uniform(3, F.col("u"), F.col("v")) < F.when(same, 0.1).otherwise(0.01)).select("u", "v")


HOPS = f"""{G}, h AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS idx, count(*) OVER (PARTITION BY src) AS deg FROM adj),
hops AS (SELECT a.src, a.idx, a.dst, b.idx AS back, b.deg AS ndeg FROM h a JOIN h b ON a.src = b.dst AND a.dst = b.src)"""


@query(f"""WITH RECURSIVE {HOPS}, w(start, walk, step, cur, deg, back, path) AS (SELECT DISTINCT src, k, 0::BIGINT, src, deg, NULL::BIGINT, src::VARCHAR FROM h, range(2) r(k)
UNION ALL SELECT d.start, d.walk, d.step + 1, hops.dst, hops.ndeg, hops.back, d.path || ' ' || hops.dst FROM (SELECT *, CASE WHEN back IS NULL THEN floor(x * deg) WHEN r < back * 2.0 THEN floor(r / 2.0) WHEN r < back * 2.0 + 0.25 THEN back ELSE back + 1 + floor((r - back * 2.0 - 0.25) / 2.0) END AS i
FROM (SELECT *, x * ((deg - 1) * 2.0::DOUBLE + 0.25::DOUBLE) AS r FROM (SELECT *, ('0x' || substr(md5('7:' || start || ':' || walk || ':' || step), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x FROM w WHERE step < 5))) d JOIN hops ON hops.src = d.cur AND hops.idx = least(d.i, d.deg - 1)) SELECT start, walk, path FROM w WHERE step = 5""")
def random_walk(spark: SparkSession, d: str) -> DataFrame:
    g = views.g_purchase(spark, d)
    return walks.random_walks(g, graph.vertices(g), 2, 6, p=4.0, q=0.5).select("start", "walk", F.array_join("path", " ").alias("path"))


@query(f"""WITH {S}, ad AS (SELECT src AS x, dest AS y FROM st WHERE op = 'ADD' UNION SELECT dest, src FROM st WHERE op = 'ADD'), act AS (SELECT DISTINCT x AS vertex FROM ad),
sz AS (SELECT p.part, count(vertex) AS size FROM range(4) p(part) LEFT JOIN act ON vertex * vertex % 4 = part GROUP BY 1), cap AS (SELECT 1.05::DOUBLE * avg(size) AS cap FROM sz), n AS (SELECT x AS vertex, y * y % 4 AS part, count(*) AS n FROM ad GROUP BY 1, 2),
sc AS (SELECT act.vertex, sz.part, coalesce(n, 0) - 0.05::DOUBLE * greatest(0, size - cap) AS score FROM act CROSS JOIN sz CROSS JOIN cap LEFT JOIN n ON n.vertex = act.vertex AND n.part = sz.part)
SELECT vertex, part, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vertex ORDER BY round(score, 6) DESC, part) AS r FROM sc) WHERE r <= 2""")
def online_assign_rf(spark: SparkSession, d: str) -> DataFrame:
    s = views.stream_all(spark, d)
    ends = s.where("op = 'ADD'").select(F.explode(F.array("src", "dest")).alias("vertex")).distinct()
    before = ends.select("vertex", (F.col("vertex") * F.col("vertex") % 4).cast("int").alias("part"))
    return online.choose(online.score(s, before, 4, 0.05), 2).select("vertex", "part", F.round("score", 6).alias("score"))


@query()
def node2vec_embed(spark: SparkSession, d: str) -> DataFrame:
    """Eight parts, each walked and trained by itself."""
    g = views.g_purchase(spark, d)
    return walks.node2vec(g, views.hashed(g, 8))


@query(f"WITH RECURSIVE {G}, walk(id, r) AS (SELECT id, id FROM vs UNION SELECT w.id, a.dst FROM walk w JOIN adj a ON a.src = w.r), c AS (SELECT id, min(r) AS component FROM walk GROUP BY id) SELECT component, count(*) AS vertices FROM c GROUP BY component ORDER BY vertices DESC, component LIMIT 5")
def topk_components(spark: SparkSession, d: str) -> DataFrame:
    sizes = graph.components(views.g_purchase(spark, d)).groupBy("component").agg(F.count("*").alias("vertices"))
    return sizes.orderBy(F.desc("vertices"), "component").limit(5)


@query(f"WITH {E}, p AS (SELECT a.id, sum(a.c * b.c) AS dot, sum((a.c - b.c) * (a.c - b.c)) AS d, sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c)) AS n FROM x a JOIN x b ON b.id = a.id + 1 AND a.pos = b.pos GROUP BY a.id) SELECT id, round(sqrt(d), 6) AS l2, round(CASE WHEN n > 0 THEN dot / n ELSE 0 END, 6) AS cosine, round(greatest(0, 1 - CASE WHEN n > 0 THEN dot / n ELSE 0 END), 6) AS distance, round(1 / (1 + exp(-dot)), 6) AS link_score, 1 / (1 + exp(-dot)) > 0.5 AS linked FROM p")
def pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = views.vectors(spark, d).select("id", "vec")
    after = e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other"))
    a, b = F.col("vec"), F.col("other")
    p = e.join(after, "id").select("id", F.sqrt(expr.squared_l2(a, b)).alias("l2"), expr.cosine(a, b).alias("cosine"), (1 / (1 + F.exp(-expr.dot(a, b)))).alias("s"))
    return p.select("id", F.round("l2", 6).alias("l2"), F.round("cosine", 6).alias("cosine"), F.round(F.greatest(F.lit(0.0), 1 - F.col("cosine")), 6).alias("distance"), F.round("s", 6).alias("link_score"), (F.col("s") > 0.5).alias("linked"))


def _u(*keys: str) -> str:
    """SQL of a digest uniform over the keys, which are SQL expressions."""
    return f"('0x' || substr(md5({" || ':' || ".join(keys)}), 1, 8))::BIGINT / 4294967296.0"


@query(f"SELECT i AS u, j AS v FROM range(240) a(i), range(240) b(j) WHERE i < j AND {_u("'4'", 'i', 'j')} < CASE WHEN i // 60 = j // 60 THEN 0.2 ELSE 0.02 END")
def planted_partition(spark: SparkSession, d: str) -> DataFrame:
    return generators.planted_partition(spark, 4, 60, 0.2, 0.02, 4)


@query(f"WITH b AS (SELECT i, CASE WHEN i < 40 THEN 0 WHEN i < 140 THEN 1 ELSE 2 END AS b FROM range(200) r(i)) SELECT x.i AS u, y.i AS v FROM b x, b y WHERE x.i < y.i AND {_u("'6'", 'x.i', 'y.i')} < [[0.5, 0.02, 0.01], [0.02, 0.2, 0.05], [0.01, 0.05, 0.3]][x.b + 1][y.b + 1]")
def block_model(spark: SparkSession, d: str) -> DataFrame:
    return generators.block_model(spark, [40, 100, 60], [[0.5, 0.02, 0.01], [0.02, 0.2, 0.05], [0.01, 0.05, 0.3]], 6)


@query(f"WITH r AS (SELECT i, {_u("'5'", "'block'", 'i')} AS x FROM range(300) t(i)), b AS (SELECT i, CASE WHEN x < 0.25 THEN 0 WHEN x < 0.75 THEN 1 ELSE 2 END AS b FROM r) SELECT row_number() OVER (ORDER BY x.i, y.i) - 1 AS seq, x.i AS src, y.i AS dest, x.b AS src_block, y.b AS dest_block FROM b x, b y WHERE y.i < x.i AND {_u("'5'", 'x.i', 'y.i')} < CASE WHEN x.b = y.b THEN 0.1 ELSE 0.01 END")
def block_stream(spark: SparkSession, d: str) -> DataFrame:
    return generators.block_stream(spark, 300, [0.25, 0.5, 0.25], [[0.1 if a == b else 0.01 for b in range(3)] for a in range(3)])


@query(f"WITH RECURSIVE w(src, en) AS (SELECT i, 2 * i + 1 FROM range(1, 5000) t(i) UNION ALL SELECT src, floor({_u("'11'", 'en')} * (en - 1))::BIGINT FROM w WHERE en % 2 = 1) SELECT src, en // 2 AS dest FROM w WHERE en % 2 = 0")
def preferential_attachment(spark: SparkSession, d: str) -> DataFrame:
    return generators.preferential_attachment(spark, 5000)


@query(f"WITH {G} SELECT id AS vertex, ((row_number() OVER (ORDER BY ('0x' || substr(md5('1:' || id), 1, 15))::BIGINT) - 1) % 4)::INT AS part FROM vs")
def random_parts(spark: SparkSession, d: str) -> DataFrame:
    return communities.random_parts(graph.vertices(views.g_purchase(spark, d)), 4)


@query()
def local_fitness(spark: SparkSession, d: str) -> DataFrame:
    return communities.local_fitness(views.g_purchase(spark, d), alpha=1.0, threshold=0.1)


@query()
def fitness_partition(spark: SparkSession, d: str) -> DataFrame:
    return communities.partition(views.g_purchase(spark, d), 4, threshold=0.1)


@query("WITH RECURSIVE e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), pr AS (SELECT a.id AS i, b.id AS j FROM e a JOIN e b ON a.id <> b.id WHERE list_distance(a.v, b.v) <= 1.15), core AS (SELECT i AS id FROM pr GROUP BY i HAVING count(*) + 1 >= 3), r(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, pr.j FROM r JOIN pr ON pr.i = r.b JOIN core ON core.id = pr.j), n AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY a), o AS (SELECT pr.i AS id, min(cluster) AS reach FROM pr JOIN n ON n.id = pr.j GROUP BY pr.i) SELECT e.id, coalesce(cluster, reach) AS cluster FROM e LEFT JOIN n ON n.id = e.id LEFT JOIN o ON o.id = e.id")
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return placement.density_clusters(views.vectors(spark, d).select("id", "vec"), 1.15, 3)


@query()
def fill_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = views.vectors(spark, d)
    c = vectors.merge_mean(e, "label").select(F.col("label").cast("int").alias("part"), F.col("vec").alias("c"))
    sizes = e.groupBy(F.col("label").cast("int").alias("part")).agg(F.count("*").alias("size"))
    return placement.fill_nearest(buffers(e, 1000, "id"), sizes.join(c, "part"), 1, 0.01)


@query(f"WITH {S}, p AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 1000 AS buffer FROM st), w AS (SELECT least(src, dest) AS u, greatest(src, dest) AS v, exp(-0.3 * ((SELECT max(buffer) FROM p) - max(buffer))) AS w FROM p WHERE op = 'ADD' GROUP BY 1, 2), a AS (SELECT u AS vertex, v AS near, w FROM w UNION ALL SELECT v, u, w FROM w) SELECT vertex, (near % 4)::INT AS part, round(sum(w), 6) AS weight FROM a GROUP BY 1, 2")
def decayed_neighbours(spark: SparkSession, d: str) -> DataFrame:
    b = buffers(views.stream_all(spark, d), 1000, "seq")
    every = b.select(F.explode(F.array("src", "dest")).alias("vertex")).distinct().withColumn("part", (F.col("vertex") % 4).cast("int"))
    return online.decayed_neighbours(b, every, 0.3).select("vertex", "part", F.round("weight", 6).alias("weight"))


@query(f"WITH {G}, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM vs), x AS (SELECT id AS a, floor({_u("'17'", 'id', 's')} * (SELECT count(*) FROM vs))::BIGINT AS pos FROM vs, range(3) r(s)), y AS (SELECT DISTINCT least(a, p.id) AS u, greatest(a, p.id) AS v FROM x JOIN p USING (pos) WHERE a <> p.id) SELECT u, v FROM y EXCEPT SELECT u, v FROM g")
def negative_pairs(spark: SparkSession, d: str) -> DataFrame:
    return links.negative_pairs(views.g_purchase(spark, d), 3)


@query(f"""WITH {G}, pos AS (SELECT u, v FROM g WHERE {_u("'23'", 'u', 'v')} < 0.1), k AS (SELECT u, v FROM g EXCEPT SELECT u, v FROM pos), n AS (SELECT u AS src, v AS dst FROM k UNION ALL SELECT v, u FROM k),
places AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM vs), e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings),
dr AS (SELECT u, v, s, floor({_u("'19'", 'u', 'v', 's')} * (SELECT count(*) FROM vs))::BIGINT AS pos FROM pos, range(20) r(s)),
t AS (SELECT u, v, id AS t FROM dr JOIN places USING (pos) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.src = dr.u AND n.dst = places.id)),
goal AS (SELECT u, v, round(coalesce(list_dot_product(a.x, b.x), 0), 6) AS goal FROM pos LEFT JOIN e a ON a.id = u LEFT JOIN e b ON b.id = v),
sc AS (SELECT u, v, round(coalesce(list_dot_product(a.x, b.x), 0), 6) AS score FROM t LEFT JOIN e a ON a.id = u LEFT JOIN e b ON b.id = t)
SELECT goal.u, goal.v, 1 + count(*) FILTER (score > goal) AS rank FROM goal LEFT JOIN sc ON sc.u = goal.u AND sc.v = goal.v GROUP BY 1, 2""")
def corrupted_ranks(spark: SparkSession, d: str) -> DataFrame:
    g = views.g_purchase(spark, d)
    kept, held = links.hold_out(g, 0.1)
    return links.rank_among_corrupted(views.vectors(spark, d).select("id", "vec"), kept, held, 20, 64)


@query()
def link_predictions(spark: SparkSession, d: str) -> DataFrame:
    g, e = views.g_purchase(spark, d), views.vectors(spark, d).select("id", "vec")
    pairs = g.withColumn("label", F.lit(1)).unionByName(links.negative_pairs(g, 3).withColumn("label", F.lit(0)))
    return links.predict(pairs, e, links.train(pairs, e, 64), 64)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded event graph with degrees, label-propagation parts and the share of each part's edges that leave it."""
    g = graph.fold_events(views.stream_all(spark, sf_dir))
    labels = graph.label_rounds(g, 5)
    e = g.join(labels.select(F.col("id").alias("u"), F.col("label").alias("pu")), "u").join(labels.select(F.col("id").alias("v"), F.col("label").alias("pv")), "v")
    leaving = e.groupBy(F.col("pu").alias("part")).agg(F.count("*").alias("edges"), F.count_if(F.col("pu") != F.col("pv")).alias("cut"))
    sizes = labels.groupBy(F.col("label").alias("part")).agg(F.count("*").alias("vertices"))
    return sizes.join(leaving, "part", "left").select("part", "vertices", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("cut", F.lit(0)).alias("cut"))


from . import catalog_more  # noqa: E402, F401  # registers its queries here
