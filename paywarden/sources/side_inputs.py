"""Side inputs: external fraud CSV, JSON reports, JSONL events, verdicts, usage logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden.operators.feedback import parse_usage

# Columns of the external fraud table and the features they stand for.
EXTERNAL_COLUMNS = {
    "account_age_days": "D1",
    "beneficiary_added_ago_s": "D2",
    "time_since_prev_txn": "D4",
    "inter_txn_time_mean": "D10",
    "inter_txn_time_max": "D15",
    "txn_count_last_1h": "C1",
    "txn_count_last_24h": "C2",
    "unique_payee_count": "C13",
    "merchant_diversity": "C14",
    "channel": "ProductCD",
    "auth_method": "card4",
    "rail": "card6",
    "historical_average_amount": "oldbalanceOrg",
    "direction": "type",
}
TEXT_FEATURES = ("channel", "auth_method", "rail", "direction")

VERDICT_SCHEMA = (
    "transaction_id STRING, ts_us BIGINT, analyst_verdict STRING, analyst_confidence DOUBLE,"
    " analyst_reasoning STRING, key_signals ARRAY<STRING>, patterns ARRAY<STRING>, batch_id STRING, verdict_date DATE"
)


def read_external_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def category_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Codes 0..k-1 of the distinct values in order; null stays null.

    Only the distinct values are ordered, and the rows meet them by a join.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    codes = values.selectExpr(column, f"cast(row_number() over (order by {column}) - 1 as int) as {out}")
    return df.join(codes, column, "left")


def map_external(df: DataFrame, id_columns: tuple[str, ...] = ()) -> DataFrame:
    """External fraud rows on the feature schema; absent inputs give null."""

    def source(name: str) -> F.Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    if "category" in df.columns:
        df = category_codes(df, "category", "_mcc")
    step = source("step").cast("long")
    balances = source("newbalanceOrig").cast("double") - source("oldbalanceOrg").cast("double")
    mapped = {
        "amount": F.coalesce(source("amount").cast("double"), source("TransactionAmt").cast("double")),
        "tx_hour": F.pmod(step, F.lit(24)),
        "tx_dayofweek": F.pmod(F.floor(step / 24), F.lit(7)),
        "geo_matches_billing": source("dist1").cast("double") < 50,
        "device_is_known_for_payer": source("DeviceType").isNotNull(),
        "mcc": F.col("_mcc") if "_mcc" in df.columns else F.lit(None).cast("int"),
        "amount_deviation": balances,
    }
    for feature, column in EXTERNAL_COLUMNS.items():
        mapped[feature] = source(column) if feature in TEXT_FEATURES else source(column).cast("double")
    return df.select(
        *id_columns,
        *[c.alias(n) for n, c in mapped.items()],
        F.lit(True).alias("is_fraud"),
        F.lit(False).alias("is_legit_lookalike"),
        F.lit("synthetic_pattern_fraud").alias("attack_id"),
        F.lit("synthetic_v1").alias("campaign_id"),
    )


def read_battery_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nested battery report: one table per family, one per family and intensity."""
    report = spark.read.json(path, multiLine=True)
    by_family = report.select(F.explode("by_family").alias("r")).select("r.*")
    by_intensity = report.select(F.explode("by_intensity").alias("r")).select("r.*")
    return by_family, by_intensity


def _append(df: DataFrame, path: str, batch: str | None, by: tuple[str, ...], form: str) -> None:
    """Write a batch into folders of its own, in place of what an earlier try of it left there."""
    named = df.withColumn("batch_id", F.lit(batch or uuid.uuid4().hex))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *by).format(form).save(path)


def append_channel_events(events: DataFrame, path: str, channel: str = "PAYPAL", batch: str | None = None) -> None:
    """Append the events of one channel as JSON lines.

    ``batch`` names the input: the same batch written again replaces itself, so a job
    that is run twice adds its rows once. Without a name every call adds.
    """
    _append(events.filter(F.col("channel") == channel), path, batch, (), "json")


def append_verdicts(verdicts: DataFrame, path: str, batch: str | None = None) -> None:
    """Add verdicts to the store, a folder per batch and day; other batches stay untouched. ``batch`` as above."""
    dated = verdicts.withColumn("verdict_date", F.to_date(F.timestamp_micros("ts_us")))
    _append(dated, path, batch, ("verdict_date",), "parquet")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERDICT_SCHEMA).parquet(path)


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_usage(spark.read.text(path).withColumnRenamed("value", "line"))
