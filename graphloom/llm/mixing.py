"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) / weight, with u taken from a digest of its id: ordering by this
key is weighted sampling without replacement. A source first takes as many complete epochs as its target holds;
the rest of the target is met by documents in key order. The order is cut into key buckets, bucket totals are
prefix-summed first and rows are then ordered within a bucket only, so no source is sorted in one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .words import Words

BUCKETS = 2048
MAX_EPOCHS = 3
WEIGHTS = (5.0, 2.0, 1.0)


def word_counts(docs: DataFrame) -> DataFrame:
    """docs with ``size``, the number of words [^\\x20\\x09-\\x0D]+, in place of the text; a column of that name goes."""
    common.small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("text", "size")]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    cast = docs.select(text, *rest)
    schema = docs.select(*rest).withColumn("size", F.lit(0).cast("long")).schema

    def count(batches):
        for table in common.chunks(batches, 0):
            sizes = Words(common.array(table, 0)).sizes
            yield pa.RecordBatch.from_arrays([*(common.array(table, k) for k in range(1, table.num_columns)), pa.array(sizes.astype("int64"))], names=[*rest, "size"])

    return cast.mapInArrow(count, schema)


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = 1.0, cap: float = MAX_EPOCHS) -> list[tuple[str | None, int, float]]:
    """(source, size, target): weights repeat over sources in code point order, null last.

    A target stops at ``cap`` times its source's size; what exceeds is shared again by weight among the others.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    weight = {k: weights[k % len(weights)] for k in range(len(order))}
    total = share * sum(n for _, n in order)
    out, free = {}, set(weight)
    while free:
        left = total - sum(out.values())
        by = sum(weight[k] for k in free)
        over = [k for k in free if left * weight[k] / by > cap * order[k][1]]
        if not over:
            out |= {k: left * weight[k] / by for k in free}
            break
        out |= {k: cap * float(order[k][1]) for k in over}
        free -= set(over)
    return [(name, n, float(out[k])) for k, (name, n) in enumerate(order)]


def uniform(doc_id: F.Column, seed: str = "mix") -> F.Column:
    """A number in (0, 1] from the first 48 bits of a digest of the id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + 1.0) / float(1 << 48)


def mix(sized: DataFrame, weights=WEIGHTS, share: float = 1.0, cap: float = MAX_EPOCHS, buckets: int = BUCKETS, seed: str = "mix", ties: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, weight and the columns ``ties`` of sized, with source_size, target, epochs and taken.

    taken = epochs * size, plus what the fractional selection takes of the document: documents in key order until
    the rest of the target, rounded down to words, is used up; the document at the border gives only the words still
    wanted. A null or non-positive weight counts as 1. Ties in the key fall back to doc_id; rows that repeat a
    doc_id and size take their turns one after the other, by the columns ``ties``; without these they are alike. Sources that hold no word take nothing. Other columns are left out; an empty table gives an empty result.
    The few rows of source totals come to the driver: one row per source.
    """
    spark = sized.sparkSession
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1.0)
    # 1 - exp(-key) spreads keys of weight 1 evenly; other weights stay monotone
    keep = [c for c in ("doc_id", "source", "size", "weight", *ties) if c in sized.columns]
    sized = sized.select(*dict.fromkeys(keep)).withColumn("es_key", key).withColumn("bucket", F.least(F.floor((1.0 - F.exp(-F.col("es_key"))) * buckets), F.lit(buckets - 1)).cast("int"))
    parts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    parts = common.materialize(parts)
    totals = [(r["source"], r["n"] or 0) for r in parts.groupBy("source").agg(F.sum("bucket_size").alias("n")).collect()]
    schema = pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64())])
    plan = F.broadcast(common.rows_of(spark, targets(totals, weights, share, cap), schema))
    same = F.col("source").eqNullSafe(F.col("by"))
    plan = plan.withColumnRenamed("source", "by")
    before = parts.withColumn("before", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("es_key", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(before, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))).join(plan, same)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs)
    rest = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")
    more = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before") - F.col("inside")))
    more = F.when(F.col("epochs") >= int(cap), F.lit(0)).otherwise(more)
    rows = rows.withColumn("taken", (F.col("epochs") * F.col("size") + more).cast("long"))
    return rows.drop("es_key", "bucket", "before", "inside", "s2", "b2", "by")


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id -> weight from ``labels.quality``: 2 for good, 0.5 for poor documents; one row per id."""
    labels = common.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return labels.select(F.col("doc_id").cast("long").alias("label_id"), F.when(F.col("q") == 1, 2.0).when(F.col("q") == 0, 0.5).otherwise(1.0).alias("weight"))


def sized_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, *extra: str) -> DataFrame:
    sized = word_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, "source", "text"))
    weights = quality_weights(spark, sf_dir)
    return sized.join(weights, sized.doc_id == weights.label_id, "left").drop("label_id").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = common.materialize(sized_documents(spark, common.table(spark, sf_dir, "documents"), sf_dir))
    return mix(sized).select("doc_id", "size", "source", "source_size", "target", "taken")
