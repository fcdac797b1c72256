"""Stored graphs: vertex and edge tables that are edited, asked and kept in shards of a hash ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph
from .order import with_position


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a graph without any."""
    return spark.createDataFrame([], "id long"), spark.createDataFrame([], "u long, v long")


def add_vertices(vertices: DataFrame, more: DataFrame) -> DataFrame:
    return vertices.select("id").unionByName(more.select("id")).distinct()


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """more(u, v) in any order; edges that are there stay single, loops are left out."""
    return graph.union(edges, graph.canonical(more, "u", "v"))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """gone(u, v) in any order; edges that aren't there change nothing."""
    return graph.difference(edges, graph.canonical(gone, "u", "v"))


def remove_vertices(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with neither end among gone(id)."""
    return edges.join(gone.select(F.col("id").alias("u")), "u", "left_anti").join(gone.select(F.col("id").alias("v")), "v", "left_anti").select("u", "v")


def has_edges(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(u, v) with ``present``, whichever way round."""
    held = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(True).alias("held"))
    return asked.join(held, (F.least("u", "v") == F.col("a")) & (F.greatest("u", "v") == F.col("b")), "left").select("u", "v", F.coalesce("held", F.lit(False)).alias("present"))


def neighbours(edges: DataFrame) -> DataFrame:
    """id, near: the sorted neighbours of each vertex."""
    return graph.symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("near"))


def vertices_only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """id of vertices that a's edges name and b's don't."""
    return graph.vertices(a).join(graph.vertices(b), "id", "left_anti")


def copied(spark: SparkSession, place: str, target: str, replace: bool = False) -> DataFrame:
    """A stored table (Parquet) in another folder, its part folders too; raises if that exists, unless it is to be replaced."""
    rows = spark.read.parquet(place)
    folders = [f for f in ("part", "shard") if f in rows.columns and _has_folders(spark, place, f)]
    rows.write.partitionBy(*folders).mode("overwrite" if replace else "errorifexists").parquet(target)
    return spark.read.parquet(target)


def _has_folders(spark: SparkSession, place: str, column: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return any(x.getPath().getName().startswith(f"{column}=") for x in found)


def appended(rows: DataFrame, target: str, first: bool) -> None:
    """One chunk of a table that arrives in chunks: the first replaces what is there, the others add to it."""
    rows.write.mode("overwrite" if first else "append").parquet(target)


def degrees_of(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree of all vertices, 0 for those without an edge."""
    return vertices.select("id").join(graph.degree(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def relabel_sorted(vertices: DataFrame) -> DataFrame:
    """id and its place among the sorted ids."""
    return with_position(vertices.select("id"), "id", "code").select("id", "code")


def ring(spark: SparkSession, shards: list[str], replicas: int = 3) -> DataFrame:
    """One row: the ring as an array of (k, shard) in order of the digests of ``shard:replica``."""
    points = spark.createDataFrame([(s, r) for s in shards for r in range(replicas)], "shard string, r int")
    k = F.sha2(F.concat_ws(":", "shard", "r").cast("binary"), 256)
    return points.select(k.alias("k"), "shard").agg(F.sort_array(F.collect_list(F.struct("k", "shard"))).alias("ring"))


def shard_of(key: Column, points: Column) -> Column:
    """The shard of the first point after the key's digest, else of the first one."""
    after = F.filter(points, lambda x: x.k > F.sha2(key.cast("string").cast("binary"), 256))
    return F.when(F.size(after) > 0, F.element_at(after, 1)).otherwise(F.element_at(points, 1))["shard"]


def placed(keys: DataFrame, ring: DataFrame, key: str = "key") -> DataFrame:
    """keys with their ``shard``; the ring is one row."""
    return keys.crossJoin(F.broadcast(ring)).withColumn("shard", shard_of(F.col(key), F.col("ring"))).drop("ring")


def moved(keys: DataFrame, before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """key, old, new of the keys that change their shard between two rings."""
    both = keys.select(key).crossJoin(F.broadcast(before.select(F.col("ring").alias("a")))).crossJoin(F.broadcast(after.select(F.col("ring").alias("b"))))
    found = both.select(key, shard_of(F.col(key), F.col("a")).alias("old"), shard_of(F.col(key), F.col("b")).alias("new"))
    return found.where("old <> new")


def sharded(name: str, vertices: DataFrame, edges: DataFrame, ring: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, out-edges) of a named graph with their shard; a vertex and its out-edges share the shard of ``name:id``."""
    at = lambda df, column: placed(df.withColumn("key", F.concat(F.lit(f"{name}:"), F.col(column))), ring).withColumn("graph", F.lit(name))
    return at(vertices.select("id"), "id"), at(graph.symmetric(edges), "src")


def write_sharded(tables: tuple[DataFrame, DataFrame], folder: str) -> None:
    """A folder for each graph and shard; one graph's files are replaced, others stay."""
    for df, name in zip(tables, ("vertices", "edges"), strict=True):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph", "shard").parquet(f"{folder}/{name}")


def read_sharded(spark: SparkSession, folder: str, name: str, shard: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a graph, or of one of its shards: only its folders are read."""
    only = (F.col("graph") == name) & (F.lit(True) if shard is None else F.col("shard") == shard)
    return tuple(spark.read.parquet(f"{folder}/{x}").where(only) for x in ("vertices", "edges"))
