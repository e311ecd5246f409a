"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

The index is a Parquet table with one row per distinct text. A batch is reduced to
its distinct digests (combined before the shuffle), joined against the index by a
sort-merge anti-join that reads the index in its own buckets without a shuffle, and
what is new is appended bucket by bucket.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden.llm.common import blank, shared_folder, written

# The characters that do not count when two texts are compared.
SPACE = "[\\x20\\x09-\\x0D]+"


def text_digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, digest, n_points): SHA-256 of the text without white space, code points of the text as it is."""
    text = blank(text_column)
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.sha2(F.regexp_replace(text, SPACE, ""), 256).alias("digest"),
        F.length(text).cast("long").alias("n_points"),
    )


class DigestIndex:
    """A digest index at `path`, created when absent; any session can open it again.

    `buckets` is fixed when the index is made; choose it so that a bucket of digests
    fits a task (64 bytes of digest and 16 of values a row).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        # Spark reads the location as a string literal.
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT, n_points BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'"
        )

    def close(self) -> None:
        """Forget the name in this session; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """Add a batch; one row per row of the batch, dropped ones too.

        Of equal texts the one already in the index stays; within a batch the one
        with most code points, then the smallest id. A null text counts as empty, a
        null id as smaller than any other; rows with one id are rows of their own in
        `group_size` and are kept or dropped together. A batch that is added again,
        as after a failed job, gives the same answer and appends nothing. Returns
        doc_id, keep_id, group_size (rows of the batch with this text), kept, text_sha256.
        """
        rows = written(text_digests(docs, id_column, text_column))
        groups = written(
            rows.groupBy("digest").agg(
                F.min(F.struct((-F.col("n_points")).alias("less"), "doc_id")).alias("best"),
                F.count("*").alias("group_size"),
            ).select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("n_points"), "group_size")
        )
        fresh = groups.hint("merge").join(self.rows().hint("merge"), "digest", "left_anti")
        # One task per bucket, so an append adds one sorted file to each.
        fresh.repartition(self.buckets, "digest").select("digest", "keep_id", "n_points").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        stay = written(
            groups.select("digest", "group_size").hint("merge").join(self.rows().hint("merge"), "digest")
            .select("digest", "keep_id", "group_size")
        )
        # Both sides are dealt out here, so adaptive execution can split a digest that holds a third of the rows.
        return rows.join(stay, "digest").select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


def exact_duplicates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All rows of `docs` against the index at `path`, or against a new index in the shared folder."""
    spark = docs.sparkSession
    index = DigestIndex(spark, path or f"{shared_folder(spark)}-digests")
    try:
        return index.add(docs)
    finally:
        index.close()


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), h AS (
  SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM d
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS FIRST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w
"""
