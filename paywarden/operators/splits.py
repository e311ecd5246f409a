"""Temporal splits: by time and by campaign, never by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.operators.quantiles import exact_quantiles
from paywarden.operators.scan import MAX_ROWS_PER_TASK

SPLITS = ("train", "validation", "test")


def split_windows(
    start_us: int, end_us: int, fractions: tuple[float, float, float] = (0.6, 0.2, 0.2)
) -> dict[str, tuple[int, int]]:
    """Half-open ``[start, end)`` bounds of train, validation and test."""
    if abs(sum(fractions) - 1.0) > 1e-9:
        raise ValueError("temporal split fractions must sum to 1.0")
    if start_us >= end_us:
        raise ValueError("temporal split start must be before end")
    span = end_us - start_us
    train_end = start_us + round(span * fractions[0])
    validation_end = train_end + round(span * fractions[1])
    return {
        "train": (start_us, train_end),
        "validation": (train_end, validation_end),
        "test": (validation_end, end_us),
    }


def assign_split(ts_us: str | Column, windows: dict[str, tuple[int, int]], outside: str | None = None) -> Column:
    """Split name of a time; ``outside`` (null by default) when no window holds it."""
    ts = F.col(ts_us) if isinstance(ts_us, str) else ts_us
    out = F.lit(outside).cast("string")
    for name in reversed(SPLITS):
        lo, hi = windows[name]
        out = F.when((ts >= lo) & (ts < hi), name).otherwise(out)
    return out


def hold_out_family(split: Column, attack_id: Column, family: str) -> Column:
    """Rows of the held-out attack family always go to the test split."""
    return F.when(attack_id == family, "test").otherwise(split)


def split_labels(labels: DataFrame, payments: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Labels with the split of their payment; labels of unsplit payments drop out."""
    splits = payments.select("txn_id", assign_split("ts_us", windows).alias("split"))
    return labels.join(splits.filter(F.col("split").isNotNull()), "txn_id")


def campaign_splits(
    rows: DataFrame, windows: dict[str, tuple[int, int]], max_rows: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """One split per campaign, by the median time of its payments."""
    medians = exact_quantiles(rows, ["campaign_id"], "ts_us", {"median_us": 0.5}, "linear", max_rows)
    return medians.select(
        "campaign_id", "median_us", assign_split("median_us", windows, outside="test").alias("split")
    )
