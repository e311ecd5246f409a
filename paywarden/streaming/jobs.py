"""Streaming jobs: verdict trigger, live scoring, session summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from paywarden.operators.feedback import feedback_summary
from paywarden.operators.scoring import assess

def retrain_trigger(verdicts: DataFrame) -> DataFrame:
    """Running feedback summary with the retrain decision; use output mode ``complete`` or ``update``."""
    return feedback_summary(verdicts)


def score_stream(requests: DataFrame, model=None) -> DataFrame:
    """Model (when given) and rules over a stream; all of it is stateless."""
    scored = model.score(requests, "probability") if model is not None else requests
    return assess(scored)


def write_by_action(assessed: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Parquet files under one folder per action."""
    return (
        assessed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("action")
    )


def session_summary(payments: DataFrame, gap: str = "30 minutes", key: str = "session_id", late: str | None = None) -> DataFrame:
    """Activity windows per session: they end after ``gap`` without a payment."""
    timed = payments.withColumn("event_time", F.timestamp_micros("ts_us"))
    if late is not None:
        timed = timed.withWatermark("event_time", late)
    coerced = F.col("call_active_during_txn") | F.col("screen_share_active")
    out = timed.groupBy(F.session_window("event_time", gap).alias("w"), key).agg(
        F.count("*").alias("n"),
        F.sum("amount").alias("amount"),
        F.count_if(coerced).alias("n_coerced"),
        F.max("pin_attempts").alias("max_pin_attempts"),
    )
    return out.select(
        key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n", "amount", "n_coerced", "max_pin_attempts"
    )
