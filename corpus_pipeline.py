"""A training corpus from `documents`: quality, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet
and read back as the next one's docs. All but the last keep the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden.llm.common import table, written
from paywarden.llm.exact_dedup import SPACE, exact_duplicates
from paywarden.llm.length_buckets import pack_by_length
from paywarden.llm.order_filters import jaccard_components
from paywarden.llm.piece_merge import count_pieces
from paywarden.llm.quality_trees import keep_quality, train_quality


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose doc_id is not dropped; rows without doc_id stay."""
    return docs.join(dropped.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees, fitted on the labelled ones among docs, score at 0.7 or more."""
    return keep_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the longest as written, then the smallest id; of rows that share both, the greatest."""
    kept = exact_duplicates(docs).where("kept").groupBy("text_sha256", "keep_id").agg(F.count("*").alias("_rows"))
    kept = written(kept.select(F.col("text_sha256").alias("_kept"), F.col("keep_id").alias("_keep"), "_rows"))
    # Null-safe on both sides, as no filter on the digest shall compute it once more.
    same = F.col("_digest").eqNullSafe(F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_keep"))
    digest = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, ""), 256)
    stay = docs.withColumn("_digest", digest).join(kept.hint("merge"), same)
    once = stay.where("_rows = 1").select(*docs.columns)
    if not kept.where("_rows > 1").limit(1).count():
        return once
    # Rows ingested more than once under one id, or spelt with other white space under it.
    first = F.max(F.struct(F.length("text").alias("_points"), *docs.columns)).alias("_row")
    return once.union(stay.where("_rows > 1").groupBy("_digest").agg(first).select(*(F.col(f"_row.{c}").alias(c) for c in docs.columns)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join: the smallest id."""
    return _without(docs, jaccard_components(docs).where("component_id <> doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document that is left: bucket, batch and slot; lengths are ids of a tokenizer."""
    return pack_by_length(count_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")), length=F.col("n"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("ngram_jaccard", near), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


# The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None
