"""Exact duplicate detection by progressive refinement, with built-in expressions only.

Rows are first grouped by length, then by a hash of a prefix, and only rows of groups that still hold several
rows have their full content read and hashed. Only small keys are shuffled, never a text, and every grouping is a
partial aggregate, so a group that holds a third of all rows reaches a reducer as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Longest table of surviving (length, prefix) groups that is broadcast; beyond it the join is shuffled.
BROADCAST_GROUPS = 200_000
PREFIX_CHARS = 256
#: Rows of a group of equal texts from which it is joined back by broadcast, if there are no more than BROADCAST_GROUPS such groups.
HOT_GROUP = 1000


def normalized(text: F.Column) -> F.Column:
    """The text with each run of ASCII white space replaced by one space; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike(r"[\x09-\x0D]|\x20[\x09-\x0D\x20]"), F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")).otherwise(text)


def exact_dedup(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, digest_all: bool = False, broadcast_groups: int = BROADCAST_GROUPS, hot_group: int = HOT_GROUP) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal means identical after white-space normalisation; the row with the smallest doc_id stays. Null texts are
    empty texts and duplicates of each other. Rows that repeat a doc_id are rows of their own: each counts in
    group_size, and all rows that carry the smallest id are marked kept. A group of null ids only has a null
    keep_id and is kept. text_sha256 is null for rows whose full content needn't be read, unless ``digest_all``.
    Columns other than doc_id and text are ignored. An empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("body"))
    length, prefix = F.length("body").alias("len"), F.xxhash64(F.substring("body", 1, prefix_chars)).alias("prefix")
    sized = common.materialize(base.select(length, prefix).groupBy("len", "prefix").agg(F.count("*").alias("rows")))
    lengths = sized.groupBy("len").agg(F.sum("rows").alias("of_len")).where("of_len > 1")
    suspects = sized.where("rows > 1").join(lengths, "len", "left_semi").select("len", "prefix")
    bound = suspects.limit(broadcast_groups + 1).count()
    if bound <= broadcast_groups:
        suspects = F.broadcast(suspects)
    keyed = base.select("doc_id", length, prefix, "body")
    digest = F.sha2(F.col("body").cast("binary"), 256)
    if digest_all:
        hashed = keyed.select("doc_id", "len", "prefix", digest.alias("text_sha256")).join(suspects.withColumn("suspect", F.lit(True)), ["len", "prefix"], "left")
    else:
        suspects = suspects.withColumn("suspect", F.lit(True))
        hashed = keyed.join(suspects, ["len", "prefix"], "left").select("doc_id", "len", "prefix", "suspect", F.when(F.col("suspect"), digest).alias("text_sha256"))
    hashed = common.materialize(hashed.select("doc_id", "len", "suspect", "text_sha256"))
    groups = hashed.where("suspect").groupBy("len", "text_sha256").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = common.materialize(groups)
    hot = groups.where(F.col("n") >= hot_group)
    by = ["len", "text_sha256"]
    if hot.limit(broadcast_groups + 1).count() <= broadcast_groups:
        # rows of hot groups never meet in one task
        found = hashed.join(F.broadcast(hot), by)
        rest = hashed.join(F.broadcast(hot.select(*by)), by, "left_anti").join(groups.where(F.col("n") < hot_group), by, "left")
        out = found.unionByName(rest)
    else:
        out = hashed.join(groups, by, "left")
    keep = F.when(F.col("n").isNotNull(), F.col("first")).otherwise(F.col("doc_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"), digest_all=True)


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
