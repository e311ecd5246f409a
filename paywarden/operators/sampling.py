"""Seeded sampling that gives the same rows on every run.

Each row gets a hash; samples are the rows with the smallest hashes. That is
repeatable when tasks are re-run and needs no random state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_RANGE = 1 << 31
BUCKETS = 1 << 12


def row_hash(id_column: str, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_column)), F.lit(HASH_RANGE))


def take_by_hash(
    df: DataFrame, n: int, id_column: str, by: Sequence[str] = (), hash_column: Column | None = None, seed: int = 42
) -> DataFrame:
    """Exactly ``n`` rows (per ``by`` group), those with the smallest hashes.

    Hash buckets are counted first. Buckets that fit whole are kept by a join with
    that small table; only the one bucket that crosses ``n`` is ranked.
    """
    h = row_hash(id_column, seed) if hash_column is None else hash_column
    by = list(by)
    hashed = df.withColumn("_h", h.cast("long")).withColumn(
        "_bucket", F.floor(F.col("_h") / (HASH_RANGE // BUCKETS)).cast("int")
    )
    counts = hashed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    order = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_bucket")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = counts.withColumn("_before", before).filter(F.col("_before") < n)
    # Without groups the table has at most one row per bucket.
    plan = plan if by else F.broadcast(plan)
    placed = hashed.join(plan, [*by, "_bucket"])
    fits = F.col("_before") + F.col("_n") <= n
    within = Window.partitionBy(*by, "_bucket").orderBy("_h", id_column)
    crossing = (
        placed.filter(~fits).withColumn("_rank", F.row_number().over(within)).filter(F.col("_rank") <= n - F.col("_before"))
    )
    return placed.filter(fits).select(*df.columns).unionByName(crossing.select(*df.columns))


def hash_split(df: DataFrame, hash_value: Column, fraction: float, first: str, second: str, out: str = "split") -> DataFrame:
    """Two-way split by hash: about ``fraction`` of the rows go to ``first``."""
    return df.withColumn(out, F.when(hash_value % 10_000 < round(fraction * 10_000), first).otherwise(second))


def carve_validation(df: DataFrame, hash_value: Column, fraction: float = 0.15, split: str = "split") -> DataFrame:
    """Turn a share of the training rows into validation rows."""
    chosen = (F.col(split) == "train") & (hash_value % 10_000 < round(fraction * 10_000))
    return df.withColumn(split, F.when(chosen, "validation").otherwise(F.col(split)))


def ensure_evaluation_splits(df: DataFrame, hash_value: Column, fraction: float = 0.15, split: str = "split") -> DataFrame:
    """Carve validation out of train when there is none; reuse it as test when there is no test."""
    names = ("validation", "test")
    present = df.agg(*[F.coalesce(F.bool_or(F.col(split) == n), F.lit(False)).alias(n) for n in names]).first()
    if not present["validation"]:
        df = carve_validation(df, hash_value, fraction, split)
    if not present["test"]:
        df = df.unionByName(df.filter(F.col(split) == "validation").withColumn(split, F.lit("test")))
    return df


def rows_for_prevalence(n_legit: int, prevalence: float) -> int:
    """Fraud rows that give ``prevalence`` against ``n_legit`` legitimate rows."""
    return int(n_legit * prevalence / (1 - prevalence))


def downsample_fraud(df: DataFrame, prevalence: float, id_column: str, label: str = "y", hash_column: Column | None = None) -> DataFrame:
    """All legitimate rows, and as many fraud rows as the prevalence allows."""
    legit = df.filter(F.col(label) != 1)
    fraud = df.filter(F.col(label) == 1)
    return legit.unionByName(
        take_by_hash(fraud, rows_for_prevalence(legit.count(), prevalence), id_column, hash_column=hash_column)
    )


def retained_budget(n_base: int, n_fraud: int, n_feedback_fraud: int, n_retained: int, limit: float = 0.05) -> int:
    """How many retained attack rows keep the fraud share within ``limit``."""
    share = n_fraud / n_base if n_base else 0.0
    if share < limit:
        return max(0, int((limit * n_base - n_fraud - n_feedback_fraud) / (1 - limit)))
    return min(n_retained, max(100, int(0.03 * n_base)))


def cap_retained(
    base: DataFrame, retained: DataFrame, id_column: str, feedback_fraud: int = 0, limit: float = 0.05,
    label: str = "y", hash_column: Column | None = None,
) -> DataFrame:
    """Base rows plus the retained attacks that fit the fraud budget."""
    row = base.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("f")).first()
    n_retained = retained.count()
    budget = retained_budget(row["n"], row["f"], feedback_fraud, n_retained, limit)
    kept = retained if n_retained <= budget else take_by_hash(retained, budget, id_column, hash_column=hash_column)
    return base.unionByName(kept, allowMissingColumns=True)


def best_checkpoint(log: DataFrame, name: str = "checkpoint", level: str = "level", evasion: str = "evasion") -> DataFrame:
    """Lowest evasion; of equal ones the later level."""
    key = F.struct(F.col(evasion), -F.col(level))
    return log.agg(F.min_by(name, key).alias(name), F.min(evasion).alias(evasion))
