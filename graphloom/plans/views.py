"""Graph views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.order import with_next


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def consecutive(events: DataFrame) -> DataFrame:
    """seq, src, dest, op from rows of consecutive event_id; an error removes the edge."""
    pairs = with_next(events.select("event_id", "user_id", "event_type"), "event_id", "user_id", "dest")
    return pairs.select(F.col("event_id").alias("seq"), F.col("user_id").alias("src"), "dest", F.when(F.col("event_type") == "error", "REMOVE").otherwise("ADD").alias("op"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consecutive(table(spark, sf_dir, "events").where("event_type = 'purchase'"))


def g_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.canonical(purchases(spark, sf_dir))


def stream_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consecutive(table(spark, sf_dir, "events")).where("src <> dest")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def hashed(edges: DataFrame, parts: int) -> DataFrame:
    return graph.vertices(edges).select(F.col("id").alias("vertex"), (F.col("id") % parts).cast("int").alias("part"))
