"""Summaries of a payments data set: counts, rates, quantiles and party profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.operators.features import calendar_features
from paywarden.operators.quantiles import exact_quantiles
from paywarden.operators.scan import MAX_ROWS_PER_TASK, Metric, find_hot_keys, prefix_scan, sliding

DAY_US = 86_400_000_000
QUANTILES = {"p50": 0.50, "p90": 0.90, "p99": 0.99}


def count_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row counts per value of each column, in one pass over grouping sets."""
    cols = [F.col(c) for c in columns]
    grouped = df.groupingSets([[c] for c in cols], *cols).agg(
        F.count("*").alias("n"), F.grouping_id(*cols).alias("_g")
    )
    # Only the grouped column's bit is 0 in the grouping id.
    full = (1 << len(columns)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        is_c = F.col("_g") == full - (1 << (len(columns) - 1 - i))
        name = F.when(is_c, c).otherwise(name)
        value = F.when(is_c, F.col(c).cast("string")).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


def quantile_summary(df: DataFrame, value: str, metric: str, keys: Sequence[str] = (), max_rows=MAX_ROWS_PER_TASK) -> DataFrame:
    """p50 / p90 / p99 by the nearest-lower rule."""
    out = exact_quantiles(df, keys, value, QUANTILES, "lower", max_rows)
    return out.select(
        F.lit(metric).alias("metric"), *keys, "n_values", *[F.col(q).cast("double").alias(q) for q in QUANTILES]
    )


def volume_quantiles(payments: DataFrame, max_rows=MAX_ROWS_PER_TASK) -> DataFrame:
    """Quantiles of amount, payments per payer and payments per merchant."""
    per_payer = payments.groupBy("payer_id").agg(F.count("*").alias("n"))
    per_merchant = (
        payments.filter(F.col("merchant_id").isNotNull()).groupBy("merchant_id").agg(F.count("*").alias("n"))
    )
    return (
        quantile_summary(payments, "amount", "amount", max_rows=max_rows)
        .unionByName(quantile_summary(per_payer, "n", "transactions_per_party", max_rows=max_rows))
        .unionByName(quantile_summary(per_merchant, "n", "transactions_per_merchant", max_rows=max_rows))
    )


def rates(payments: DataFrame) -> DataFrame:
    return payments.agg(
        F.count("*").alias("n"),
        F.avg(F.col("device_is_known_for_payer").cast("int")).alias("known_device_rate"),
        F.avg(F.col("beneficiary_first_time").cast("int")).alias("first_time_beneficiary_rate"),
    )


def label_distribution(labels: DataFrame) -> DataFrame:
    c = F.col
    metadata = c("attack_id").isNotNull() | c("campaign_id").isNotNull() | c("pretext").isNotNull()
    return labels.agg(
        F.count_if(c("is_fraud")).alias("is_fraud_true"),
        F.count_if(~c("is_fraud")).alias("is_fraud_false"),
        F.count_if(c("is_legit_lookalike")).alias("lookalike_true"),
        F.count_if(metadata).alias("attack_metadata_rows"),
    )


def entity_counts(parties: DataFrame, merchants: DataFrame, devices: DataFrame) -> DataFrame:
    parts = [("parties", parties, "party_id"), ("merchants", merchants, "merchant_id"), ("devices", devices, "device_id")]
    out = None
    for name, df, key in parts:
        row = df.agg(F.lit(name).alias("entity"), F.countDistinct(key).alias("n_distinct"))
        out = row if out is None else out.unionByName(row)
    return out


def split_sizes(rows: DataFrame) -> DataFrame:
    """Rows, ids and time range of each split (null: outside every window)."""
    return rows.groupBy("split").agg(
        F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )


def dataset_metadata(tables: dict[str, tuple[DataFrame, str | None]], version: str) -> DataFrame:
    """Row count and time range of each table of a data set version."""
    out = None
    for name, (df, ts) in tables.items():
        lo = F.min(ts) if ts else F.lit(None).cast("long")
        hi = F.max(ts) if ts else F.lit(None).cast("long")
        row = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), lo.alias("first_us"), hi.alias("last_us"))
        out = row if out is None else out.unionByName(row)
    return out.select(F.lit(version).alias("dataset_version"), "*")


def prevalence(labels: DataFrame) -> DataFrame:
    return labels.agg(
        F.count("*").alias("n"),
        F.avg(F.col("is_fraud").cast("int")).alias("fraud_share"),
        F.avg(F.col("is_legit_lookalike").cast("int")).alias("lookalike_share"),
    )


def attack_summary(labels: DataFrame) -> DataFrame:
    """Rows, campaigns and pretexts per attack, and whether it spans one campaign."""
    rows = labels.filter(F.col("attack_id").isNotNull())
    pretexts = (
        rows.groupBy("attack_id", F.coalesce("pretext", F.lit("None")).alias("pretext"))
        .agg(F.count("*").alias("n"))
        .groupBy("attack_id")
        .agg(
            F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("pretext", "n"))),
                                         lambda s: F.concat_ws("=", s["pretext"], s["n"].cast("string")))).alias("pretexts"),
        )
    )
    counts = rows.groupBy("attack_id").agg(
        F.count("*").alias("n_rows"), F.countDistinct("campaign_id").alias("n_campaigns")
    )
    return counts.join(pretexts, "attack_id").withColumn("one_campaign", F.col("n_campaigns") <= 1)


def weekday_shares(payments: DataFrame, max_spread: float = 0.5 / 7, tz: str = "UTC") -> DataFrame:
    """Share of payments per weekday and whether the week is flat enough."""
    days = calendar_features(payments, tz).groupBy("tx_dayofweek").agg(F.count("*").alias("n"))
    total = days.agg(F.sum("n").alias("_t"), F.max("n").alias("_hi"), F.min("n").alias("_lo"))
    return days.crossJoin(F.broadcast(total)).select(
        "tx_dayofweek",
        "n",
        (F.col("n") / F.col("_t")).alias("share"),
        ((F.col("_hi") - F.col("_lo")) / F.col("_t") <= max_spread).alias("flat"),
    )


def amount_profile(payments: DataFrame, by: str, max_rows=MAX_ROWS_PER_TASK) -> DataFrame:
    """Count, mean and nearest-lower quantiles of the amount per value of ``by``."""
    rows = payments.filter(F.col(by).isNotNull())
    base = rows.groupBy(by).agg((F.sum("cents") / 100.0 / F.count("*")).alias("mean_amount"))
    return base.join(quantile_summary(rows, "amount", by, [by], max_rows).drop("metric"), by)


def party_profile(payments: DataFrame, max_rows: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """Ratios of each party as of its last payment.

    Organic spend is merchant spend over all outflow; throughput is outflow over
    inflow in the last 24 h; counterparties are the distinct ones of the last 30 days.
    """
    c = F.col
    zero = F.lit(0).cast("long")
    side = F.array(
        F.struct(c("payer_id").alias("party_id"), c("payee_id").alias("other"), c("cents").alias("out"),
                 zero.alias("in"), F.concat(c("txn_id"), F.lit("/0")).alias("event")),
        F.struct(c("payee_id").alias("party_id"), c("payer_id").alias("other"), zero.alias("out"),
                 c("cents").alias("in"), F.concat(c("txn_id"), F.lit("/1")).alias("event")),
    )
    timeline = payments.select("ts_us", "merchant_id", F.explode(side).alias("_s")).select("ts_us", "merchant_id", "_s.*")
    hot = find_hot_keys(timeline, ["party_id"], "ts_us", max_rows)
    scanned = sliding(
        timeline, ["party_id"], "ts_us", "event", {"24h": DAY_US}, sums={"out": "out", "in": "in"},
        count=None, include_current=True, hot=hot,
    )
    scanned = sliding(
        scanned, ["party_id"], "ts_us", "event", {"30d": 30 * DAY_US}, distincts={"counterparties": "other"},
        count=None, include_current=True, hot=hot,
    )
    spend = F.sum(F.when(c("merchant_id").isNotNull(), c("out")).otherwise(0))
    last = F.max_by(F.struct("out_24h", "in_24h", "counterparties_30d"), F.struct("ts_us", "event"))
    out = scanned.groupBy("party_id").agg(spend.alias("_spend"), F.sum("out").alias("_out"), last.alias("_last"))
    return out.select(
        "party_id",
        F.when(c("_out") > 0, c("_spend") / c("_out")).otherwise(0.0).alias("organic_spend_ratio"),
        F.when(c("_last.in_24h") > 0, c("_last.out_24h") / c("_last.in_24h")).otherwise(0.0).alias("throughput_ratio_24h"),
        c("_last.counterparties_30d").cast("int").alias("distinct_counterparties_30d"),
    )


def merchant_decline_rate(payments: DataFrame, days: int = 30, max_rows: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """Share of declined payments of the merchant over the trailing days, row included."""
    rows = payments.filter(F.col("merchant_id").isNotNull()).select(
        "txn_id", "merchant_id", "ts_us", F.when(F.col("decision") == "declined", 1).otherwise(0).alias("declined")
    )
    hot = find_hot_keys(rows, ["merchant_id"], "ts_us", max_rows)
    out = sliding(
        rows, ["merchant_id"], "ts_us", "txn_id", {"w": days * DAY_US}, sums={"declined": "declined"},
        include_current=True, hot=hot,
    )
    return out.select("txn_id", "merchant_id", (F.col("declined_w") / F.col("count_w")).alias("decline_rate"))


def claimant_history(disputes: DataFrame, payments: DataFrame, max_rows: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """Earlier disputes of the claimant, and their share of the claimant's earlier payments."""
    rows = payments.select("txn_id", "payer_id", "ts_us").join(
        disputes.select("txn_id", "dispute_id"), "txn_id", "left"
    )
    hot = find_hot_keys(payments, ["payer_id"], "ts_us", max_rows)
    out = prefix_scan(
        rows,
        ["payer_id"],
        ["ts_us", "txn_id"],
        {
            "prior": Metric("sum", F.when(F.col("dispute_id").isNotNull(), 1).otherwise(0).cast("long")),
            "seen": Metric("sum", F.lit(1).cast("long")),
        },
        hot,
    )
    return out.filter(F.col("dispute_id").isNotNull()).select(
        "dispute_id",
        "txn_id",
        "payer_id",
        F.col("prior").alias("claimant_prior_dispute_count"),
        F.when(F.col("seen") > 0, F.col("prior") / F.col("seen")).otherwise(0.0).alias("claimant_prior_dispute_rate"),
    )
