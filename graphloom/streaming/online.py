"""Online partitioning of an event stream, one buffer (micro-batch) at a time.

A buffer is judged as a whole: all its vertices are scored against the assignment before it, so results don't depend
on the order of events within a buffer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ASSIGN = "vertex long, part int"


def score(buffer: DataFrame, assign: DataFrame, parts: int, mu: float = 0.5, slack: float = 0.05) -> DataFrame:
    """vertex, part, score for every vertex of the buffer's ADD events and every part.

    The score is the number of distinct neighbours in the part, less mu times what the part's size exceeds
    (1 + slack) times the mean. Vertices not assigned before count in the part ``vertex mod parts``.
    """
    spark = buffer.sparkSession
    adds = buffer.where("op = 'ADD' and src <> dest")
    near = adds.select(F.explode(F.array(F.struct(F.col("src").alias("vertex"), F.col("dest").alias("near")), F.struct(F.col("dest").alias("vertex"), F.col("src").alias("near")))).alias("x")).select("x.*").distinct()
    active = near.select("vertex").distinct()
    fresh = active.join(assign, "vertex", "left_anti").select("vertex", F.pmod("vertex", F.lit(parts)).cast("int").alias("part"))
    known = assign.select("vertex", "part").unionByName(fresh)
    slots = spark.range(parts).select(F.col("id").cast("int").alias("part"))
    sizes = slots.join(known.groupBy("part").agg(F.count("*").alias("size")), "part", "left").select("part", F.coalesce("size", F.lit(0)).alias("size"))
    cap = sizes.agg(((1 + slack) * F.avg("size")).alias("cap"))
    sizes = sizes.crossJoin(cap).select("part", (F.lit(mu) * F.greatest(F.lit(0.0), F.col("size") - F.col("cap"))).alias("fine"))
    n = near.join(known.withColumnRenamed("vertex", "near"), "near").groupBy("vertex", "part").agg(F.count("*").alias("n"))
    # the broadcast side has one row for each part
    grid = active.crossJoin(F.broadcast(sizes))
    return grid.join(n, ["vertex", "part"], "left").select("vertex", "part", (F.coalesce("n", F.lit(0)) - F.col("fine")).alias("score"))


def decayed_neighbours(events: DataFrame, assign: DataFrame, decay: float) -> DataFrame:
    """vertex, part, weight: neighbours in a part, each by exp(-decay * age) of the last buffer that added the edge.

    events(buffer, src, dest, op) are all remembered so far; age counts buffers from the latest one.
    """
    adds = events.where("op = 'ADD' and src <> dest").groupBy(F.least("src", "dest").alias("u"), F.greatest("src", "dest").alias("v")).agg(F.max("buffer").alias("seen"))
    now = events.agg(F.max("buffer").alias("now"))  # one row
    weighed = adds.crossJoin(F.broadcast(now)).withColumn("w", F.exp(F.lit(-decay) * (F.col("now") - F.col("seen"))))
    near = weighed.select("u", "v", "w").unionByName(weighed.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    held = assign.select(F.col("vertex").alias("v"), "part")
    return near.join(held, "v").groupBy(F.col("u").alias("vertex"), "part").agg(F.sum("w").alias("weight"))


def choose(scores: DataFrame, replicas: int = 1) -> DataFrame:
    """The best parts of each vertex, ties to the smaller part."""
    best = Window.partitionBy("vertex").orderBy(F.round("score", 6).desc(), "part")
    return scores.withColumn("r", F.row_number().over(best)).where(F.col("r") <= replicas).drop("r")


def push(buffer: DataFrame, assign: DataFrame, parts: int, mu: float = 0.5, slack: float = 0.05, replicas: int = 1) -> DataFrame:
    """The assignment after a buffer: its vertices move to their best parts, all others stay."""
    moved = choose(score(buffer, assign, parts, mu, slack), replicas).select("vertex", "part")
    return assign.join(moved.select("vertex").distinct(), "vertex", "left_anti").select("vertex", "part").unionByName(moved)


def start(stream: DataFrame, folder: str, parts: int, mu: float = 0.5, slack: float = 0.05, replicas: int = 1, **trigger):
    """A running query that keeps one version of the assignment for each batch in ``folder``, which executors share.

    A batch that is run again reads the version before it and overwrites its own, so replays change nothing.
    """

    def version(k: int) -> str:
        return f"{folder.rstrip('/')}/assign/batch-{k}"

    def batch(buffer: DataFrame, k: int) -> None:
        spark = buffer.sparkSession
        before = spark.read.schema(ASSIGN).parquet(version(k - 1)) if k else spark.createDataFrame([], ASSIGN)
        push(buffer, before, parts, mu, slack, replicas).write.mode("overwrite").parquet(version(k))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder.rstrip('/')}/progress").trigger(**(trigger or {"availableNow": True})).start()
