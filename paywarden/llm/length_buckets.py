"""Length buckets with the least padding, and token-budget batches inside them.

Lengths are counted into a global histogram whose size does not grow with the data:
exact up to 255, then 128 bins an octave. Dynamic programming over its bins puts the
bucket boundaries where the padding of all documents is least. The documents of a bucket are
then numbered in the order of a hash, range by range, and cut into batches.

What a token is, the caller says with `length`: the registered query gives the ids
of a tokenizer (`piece_merge.count_pieces`); without it words stand for tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.llm.common import blank, numbered, written


def word_count(text: str | Column = "text") -> Column:
    """Words of a text: runs of anything but ASCII white space; 0 for a null text."""
    return F.regexp_count(blank(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def length_bin(n: str) -> Column:
    """The smallest length of the histogram bin of n: n itself below 256, else its eight leading bits."""
    shift = f"greatest(length(bin({n})) - 8, 0)"
    return F.expr(f"shiftleft(shiftright({n}, {shift}), {shift})")


def histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """(greatest length, documents, tokens) of the bins, ascending: at most 256 + 56 * 128 rows."""
    rows = lengths.groupBy(length_bin("n").alias("bin")).agg(F.max("n").alias("top"), F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    return sorted((r["top"], r["docs"], r["tokens"]) for r in rows.collect())


@dataclass(frozen=True)
class Buckets:
    """Ascending boundaries (the padded lengths), documents in each bucket, and the padding of all."""

    bounds: tuple[int, ...]
    docs: tuple[int, ...]
    padding: int


def best_buckets(bins: list[tuple[int, int, int]], buckets: int) -> Buckets:
    """Boundaries with the least padding among all cuts of the bins into at most `buckets` runs.

    Cost of a run: its greatest length times its documents, less their tokens. Of
    equal plans the one whose last buckets begin first.
    """
    if not bins:
        return Buckets((), (), 0)
    top = np.array([b[0] for b in bins], np.int64)
    docs = np.concatenate([[0], np.cumsum([b[1] for b in bins])])
    n = len(bins)
    # The tokens of all runs add up to one total, so the padded size alone decides.
    best = np.full((min(buckets, n) + 1, n + 1), np.iinfo(np.int64).max, np.int64)
    best[:, 0] = 0
    came = np.zeros(best.shape, np.int64)
    for k in range(1, len(best)):
        first = np.arange(n) if k > 1 else np.zeros(1, np.int64)
        for j in range(1, n + 1):
            i = first[first < j]
            cost = best[k - 1, i] + top[j - 1] * (docs[j] - docs[i])
            at = int(cost.argmin())
            best[k, j], came[k, j] = cost[at], i[at]
    cuts, j = [], n
    for k in range(len(best) - 1, 0, -1):
        if j == 0:
            break
        cuts.append((int(top[j - 1]), int(docs[j] - docs[came[k, j]])))
        j = int(came[k, j])
    cuts.reverse()
    return Buckets(tuple(c[0] for c in cuts), tuple(c[1] for c in cuts), int(best[-1, n] - sum(b[2] for b in bins)))


def pack_by_length(docs: DataFrame, buckets: int = 16, token_budget: int = 65_536, length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch, slot of every row of `docs`.

    A batch is a run of documents of one bucket, all padded to `bucket_length`, and
    holds at most `token_budget` tokens with the padding, or one document that alone
    is longer. `length` is the number of tokens of a row, words (`word_count`) if not
    given. Batches are full but for the last of a bucket. A null text has no
    tokens and lies in the first bucket; repeated rows are packed each, and rows that
    share an id and a length may fill many ranges.
    """
    spark = docs.sparkSession
    lengths = written(docs.select(F.col("doc_id"), (word_count() if length is None else length).cast("long").alias("n")))
    plan = best_buckets(histogram(lengths), buckets)
    # One row a bucket.
    table = spark.createDataFrame(
        [(k, b, max(1, token_budget // max(b, 1))) for k, b in enumerate(plan.bounds)], "bucket int, bucket_length long, batch_rows long"
    )
    bucket = F.lit(0)
    for b in plan.bounds[:-1]:
        bucket = bucket + (F.col("n") > b).cast("int")
    rows = lengths.select("doc_id", F.col("n").alias("n_tokens"), bucket.alias("bucket"), F.xxhash64("doc_id", "n").alias("h"))
    at = numbered(rows, "bucket", "h", "doc_id", "n_tokens").join(F.broadcast(table), "bucket")
    return at.select(
        "doc_id", "n_tokens", "bucket", "bucket_length",
        F.floor(F.col("rank") / F.col("batch_rows")).cast("long").alias("batch"), (F.col("rank") % F.col("batch_rows")).cast("long").alias("slot"),
    )
