"""From documents to token ids: language ID, exact and near deduplication, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, common, exact_dedup, language_id, mixing, near_dedup

#: Documents whose main language has a smaller share are rejected. Shares sum to 1, so with four languages or fewer none is.
MIN_LANGUAGE_SHARE = 0.25


#: Names each row from the first stage to the mix; written with a stage's result, so that later reads agree on it.
ROW = "row_key"


def _columns(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", "n_chars", *more)


def _with_rows(docs: DataFrame) -> DataFrame:
    """docs with ROW; a table that lacks it is written with one."""
    if ROW in docs.columns:
        return docs
    return common.materialize(_columns(docs).withColumn(ROW, F.monotonically_increasing_id()))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (``und``); the least share rejects none more unless there are over four languages. Every row is judged by itself and gets its ROW, whether its doc_id is null or occurs again. Columns beyond those of documents go; an empty table stays empty."""
    found = language_id.identify(docs, carry=True)
    found = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return _columns(found.withColumn(ROW, F.monotonically_increasing_id()), ROW)


def _keep(docs: DataFrame, decided: DataFrame, group: str) -> DataFrame:
    """One row of each group: that of the smallest doc_id, null last; rows that repeat the id fall back to ROW.

    decided has ROW as its doc_id, and group has the same value in all rows of a group.
    """
    ids = docs.select(F.col(ROW).alias("of"), F.col("doc_id").cast("long").alias("id"))
    members = decided.select(F.col("doc_id").alias("row"), F.col(group).alias("group"))
    members = members.join(ids, members.row == ids.of)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "of"))
    stay = members.groupBy("group").agg(first.alias("first")).select(F.col("first.of").alias("stay"))
    return _columns(docs.join(stay, docs[ROW] == stay.stay, "left_semi"), ROW)


def _by_row(docs: DataFrame) -> DataFrame:
    return docs.select(F.col(ROW).alias("doc_id"), "text")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts. Rows with a null doc_id and rows that repeat one are rows like all others."""
    docs = _with_rows(docs)
    return _keep(docs, exact_dedup.exact_dedup(_by_row(docs)), "keep_id")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies. Rows with a null doc_id and rows that repeat one are rows like all others."""
    docs = _with_rows(docs)
    return _keep(docs, near_dedup.near_duplicates(_by_row(docs)), "component_id")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it; what it takes in part counts from half the document.

    Each row is taken by itself: rows that share a doc_id share the mix's key and label and take their turns one after
    the other, rows with a null doc_id likewise, with weight 1.
    """
    docs = _with_rows(docs)
    sized = common.materialize(mixing.sized_documents(spark, docs, sf_dir, ROW))
    plan = mixing.mix(sized, ties=(ROW,)).select(F.col(ROW).alias("of"), F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.col("epochs")).cast("int").alias("copies"))
    plan = plan.where("copies > 0")
    rows = docs.join(plan, docs[ROW] == plan.of)
    return _columns(rows.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row, rows with a null or repeated doc_id and repeated rows included; an empty text has no ids."""
    return bpe.encode_decode(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language_id", by_language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix_sources", mixed),
    ("bpe", encoded),
]

#: EM over trigrams, minima of digests and byte-pair merges aren't expressible in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return docs
