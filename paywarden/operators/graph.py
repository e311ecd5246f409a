"""Counterparty graph: directed payer -> payee edges and pass-through detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.operators.scan import MAX_ROWS_PER_TASK, Metric, find_hot_keys, prefix_scan

DAY_US = 86_400_000_000


def in_window(payments: DataFrame, start_us: int | None, end_us: int | None) -> DataFrame:
    """Half-open time filter, on the stored ``timestamp`` where there is one so that Parquet can skip row groups."""
    if "timestamp" in payments.columns:
        ts, bound = F.col("timestamp"), lambda us: F.timestamp_micros(F.lit(us))
    else:
        ts, bound = F.col("ts_us"), F.lit
    if start_us is not None:
        payments = payments.filter(ts >= bound(start_us))
    if end_us is not None:
        payments = payments.filter(ts < bound(end_us))
    return payments


def forwarding_times(
    payments: DataFrame,
    within_us: int = DAY_US,
    by: Sequence[str] = (),
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """For each payment, when its payee first paid someone else within ``within_us``.

    A party's incoming and outgoing payments are put on one timeline and read
    backwards once. An incoming payment needs the next outgoing one; if that goes
    back to the payer, the next outgoing one to a different payee. Both are the
    latest values of a running scan, so no pair of payments is ever formed.
    """
    sides = F.array(
        F.struct(F.col("payer_id").alias("party"), F.col("payee_id").alias("other"), F.lit(0).alias("k")),
        F.struct(F.col("payee_id").alias("party"), F.col("payer_id").alias("other"), F.lit(1).alias("k")),
    )
    timeline = payments.select(
        *by, "txn_id", "ts_us", "amount", F.explode(sides).alias("_s")
    ).select(*by, "txn_id", "ts_us", "amount", "_s.*")
    keys = [*by, "party"]
    hot = find_hot_keys(timeline, keys, "ts_us", max_rows)
    order = ["ts_us", "k", "txn_id"]
    outgoing = F.when(F.col("k") == 0, F.struct("ts_us", "other"))
    scanned = prefix_scan(timeline, keys, order, {"nxt": Metric("last", outgoing)}, hot, reverse=True)
    switch = F.when(
        (F.col("k") == 0) & (F.col("nxt.other") != F.col("other")), F.col("nxt.ts_us")
    )
    scanned = prefix_scan(scanned, keys, order, {"switch": Metric("last", switch)}, hot, reverse=True)
    found = F.when(F.col("nxt.other") != F.col("other"), F.col("nxt.ts_us")).otherwise(F.col("switch"))
    return scanned.filter(F.col("k") == 1).select(
        *by,
        "txn_id",
        "ts_us",
        F.col("other").alias("payer_id"),
        F.col("party").alias("payee_id"),
        "amount",
        F.when(found <= F.col("ts_us") + within_us, found).alias("forwarded_us"),
    )


def degrees(payments: DataFrame, party: str, other: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct counterparties per party; both steps combine before the shuffle."""
    return (
        payments.select(*by, party, other).distinct().groupBy(*by, party).agg(F.count("*").alias(name))
    )


def graph_edges(
    payments: DataFrame,
    start_us: int | None = None,
    end_us: int | None = None,
    passthrough_us: int = DAY_US,
    by: Sequence[str] = (),
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Aggregated edges of the window: count, value, mean gap, degrees, pass-through."""
    by = list(by)
    rows = in_window(payments, start_us, end_us)
    edges = (
        forwarding_times(rows, passthrough_us, by, max_rows)
        .groupBy(*by, "payer_id", "payee_id")
        .agg(
            F.count("*").cast("int").alias("edge_count"),
            F.sum("amount").alias("edge_value_total"),
            ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("_span_s"),
            F.max(F.col("forwarded_us").isNotNull()).alias("is_two_hop_passthrough"),
        )
    )
    out_degree = degrees(rows, "payer_id", "payee_id", "src_out_degree", by)
    in_degree = degrees(rows, "payee_id", "payer_id", "dst_in_degree", by)
    # Gaps of one edge add up to its span, so their mean needs no ordering.
    gap = F.when(F.col("edge_count") > 1, F.col("_span_s") / (F.col("edge_count") - 1)).otherwise(0.0)
    return (
        edges.join(out_degree, [*by, "payer_id"])
        .join(in_degree, [*by, "payee_id"])
        .select(
            *by,
            F.col("payer_id").alias("src_party_id"),
            F.col("payee_id").alias("dst_party_id"),
            F.lit(start_us).cast("long").alias("window_start_us"),
            F.lit(end_us).cast("long").alias("window_end_us"),
            "edge_count",
            "edge_value_total",
            gap.alias("mean_inter_arrival_s"),
            F.col("src_out_degree").cast("int").alias("src_out_degree"),
            F.col("dst_in_degree").cast("int").alias("dst_in_degree"),
            "is_two_hop_passthrough",
        )
    )
