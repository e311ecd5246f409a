"""Streaming operators over the driver's events, read as a file stream until it is drained."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.catalog.features import D, H, HIST, HIST0, _rng
from paywarden.catalog.registry import QUERIES, query, r, sr
from paywarden.catalog.scoring import CTES, LEVEL, LINKS, RECENT, SIM
from paywarden.sources.adapter import DAY_US, HOUR_US, DriverTables
from paywarden.operators.sessions import session_windows
from paywarden.session import scratch_folder
from paywarden.streaming.jobs import retrain_trigger, score_stream, session_summary, write_by_action
from paywarden.streaming.links import link_sessions
from paywarden.streaming.quota import batch_quota, stream_quota
from paywarden.streaming.velocity import online_velocity, payee_fan_in


class StreamTables(DriverTables):
    """The same tables, with every driver table read as a stream of files."""

    def raw(self, name: str) -> DataFrame:
        schema = super().raw(name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}*.parquet")


def _streams(t: DriverTables) -> StreamTables:
    return StreamTables(t.spark, t.sf_dir)


def _folder(t: DriverTables) -> str:
    """A new folder for one run, under the folder that all executors share."""
    return f"{scratch_folder(t.spark, 'paywarden-stream-').rstrip('/')}/stream-{uuid.uuid4().hex}"


def _drain(t: DriverTables, stream: DataFrame) -> DataFrame:
    """Run the stream over all files there are, and read back what it wrote."""
    folder = _folder(t)
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(
    "session_windows",
    "I-7",
    f"""SELECT payer_id, min(ts_us) AS start_us, max(ts_us) + {12 * HOUR_US} AS end_us, count(*) AS n, sum(amount) AS amount,
    count(*) FILTER (call_active_during_txn OR screen_share_active) AS n_coerced, max(pin_attempts) AS max_pin_attempts FROM (
    SELECT *, sum(CASE WHEN gap <= {12 * HOUR_US} THEN 0 ELSE 1 END) OVER (PARTITION BY payer_id ORDER BY ts_us) AS island FROM (
    SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY payer_id ORDER BY ts_us) AS gap FROM payments)) GROUP BY payer_id, island""",
)
def _sessions(t):
    return session_windows(t.payments, 12 * HOUR_US, "payer_id")


@query(
    "session_windows_builtin",
    "I-7",
    QUERIES["session_windows"].sql,
)
def _sessions_builtin(t):
    # Spark's own session windows, as the streaming job uses them.
    return session_summary(t.payments, "12 hours", "payer_id")


# The quota is a recursion: what is accepted depends on what was accepted before.
QUOTA = f"""SELECT client, request_id, ts_us, accepted, retry_after_s FROM (
 WITH RECURSIVE asked AS (SELECT payer_id AS client, txn_id AS request_id, ts_us, row_number() OVER (PARTITION BY payer_id ORDER BY ts_us, txn_id) AS k FROM payments),
 decided AS (
  SELECT client, request_id, ts_us, k, [ts_us] AS held, true AS accepted, cast(NULL AS int) AS retry_after_s FROM asked WHERE k = 1
  UNION ALL
  SELECT client, request_id, ts_us, k, CASE WHEN len(live) < 2 THEN list_append(live, ts_us) ELSE live END, len(live) < 2,
   CASE WHEN len(live) >= 2 THEN cast(greatest(1, ceil(({DAY_US} - (ts_us - live[1])) / 1e6)) AS int) END
  FROM (SELECT a.*, list_filter(d.held, lambda x: a.ts_us - x < {DAY_US}) AS live FROM decided d JOIN asked a ON a.client = d.client AND a.k = d.k + 1))
 SELECT * FROM decided)"""


@query("request_quota", "I-3", QUOTA)
def _quota(t):
    # Events are sparse, so the published 30 per minute becomes 2 per day.
    rows = t.payments.select(F.col("payer_id").alias("client"), F.col("txn_id").alias("request_id"), "ts_us")
    return batch_quota(rows, DAY_US, 2)


@query("stream_quota", "I-3", QUOTA)
def _stream_quota(t):
    rows = _streams(t).payments.select(F.col("payer_id").alias("client"), F.col("txn_id").alias("request_id"), "ts_us")
    return _drain(t, stream_quota(rows, DAY_US, 2))


# What the watermark has passed when a stream with ten minutes of grace is drained.
PASSED = "(SELECT max(ts_us) // 1000 * 1000 - 600000000 FROM payments)"
AVERAGE = "(sum(cents) OVER (PARTITION BY payer_id ORDER BY ts_us, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / 100e0 / count(*) OVER (PARTITION BY payer_id ORDER BY ts_us, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(
    "stream_velocity",
    "I-1",
    f"""SELECT * FROM (SELECT txn_id, cast(count(*) OVER {_rng('payer_id', H)} as double) AS txn_count_last_1h, cast(count(*) OVER {_rng('payer_id', D)} as double) AS txn_count_last_24h,
    coalesce(sum(cents) OVER {_rng('payer_id', H)}, 0) / 100e0 AS amount_spent_last_1h, coalesce(sum(cents) OVER {_rng('payer_id', D)}, 0) / 100e0 AS amount_spent_last_24h,
    {sr(f'coalesce({AVERAGE}, 0)')} AS historical_average_amount, {sr(f'coalesce(abs(cents / 100e0 - {AVERAGE}), 0)')} AS amount_deviation,
    {sr('coalesce(gap, 999999)')} AS time_since_prev_txn, CASE WHEN rn_payee = 1 THEN 1e0 ELSE 0e0 END AS new_merchant_indicator,
    CASE WHEN rn_device = 1 THEN 1e0 ELSE 0e0 END AS new_device_indicator, CASE WHEN rn_ip = 1 THEN 1e0 ELSE 0e0 END AS new_ip_indicator FROM hist)
    WHERE txn_id IN (SELECT txn_id FROM payments WHERE ts_us <= {PASSED})""",
    hist0=HIST0,
    hist=HIST,
)
def _stream_velocity(t):
    out = _drain(t, online_velocity(_streams(t).payments))
    return out.select(
        "txn_id", "txn_count_last_1h", "txn_count_last_24h", "amount_spent_last_1h", "amount_spent_last_24h",
        *[r(c).alias(c) for c in ("historical_average_amount", "amount_deviation", "time_since_prev_txn")], "new_merchant_indicator", "new_device_indicator", "new_ip_indicator",
    )


@query(
    "stream_payee_fan_in",
    "I-2",
    f"""SELECT start_us, payee_id, count(DISTINCT payer_id) AS distinct_payers, count(*) AS n FROM (SELECT payee_id, payer_id, unnest(range(ts_us // {6 * HOUR_US} - 3, ts_us // {6 * HOUR_US} + 1)) * {6 * HOUR_US} AS start_us FROM payments)
    WHERE start_us + {DAY_US} <= (SELECT max(ts_us) // 1000 * 1000 - 600000000 FROM payments) GROUP BY start_us, payee_id""",
)
def _stream_fan_in(t):
    out = _drain(t, payee_fan_in(_streams(t).payments, "24 hours", "6 hours"))
    return out.select(F.unix_micros("window.start").alias("start_us"), "payee_id", "distinct_payers", "n")


@query(
    "stream_session_links",
    "I-4",
    f"SELECT session_id, source_txn, target_txn, {sr('sim')} AS similarity FROM (SELECT *, {SIM} AS sim FROM links) WHERE sim >= 0.7",
    recent=RECENT,
    links=LINKS,
)
def _stream_links(t):
    out = _drain(t, link_sessions(_streams(t).payments))
    return out.select("session_id", "source_txn", "target_txn", r("similarity").alias("similarity"))


@query(
    "stream_retrain_trigger",
    "I-5",
    """SELECT count(*) AS total_feedback, count(*) FILTER (analyst_verdict = 'FRAUD') AS fraud_confirmed, count(*) >= 5 OR count(*) FILTER (analyst_verdict = 'FRAUD') >= 5 AS should_retrain FROM verdicts""",
)
def _stream_trigger(t):
    folder = _folder(t)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/trigger")

    stream = retrain_trigger(_streams(t).verdicts).writeStream.outputMode("complete").foreachBatch(step)
    stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/trigger").select("total_feedback", "fraud_confirmed", "should_retrain")


@query(
    "stream_scores",
    "I-6",
    f"""SELECT txn_id, {sr('risk_score')} AS risk_score, {LEVEL} AS risk_level,
    CASE WHEN risk_score >= 60 THEN 'BLOCK' WHEN risk_score >= 30 THEN 'REVIEW' ELSE 'ALLOW' END AS action FROM final""",
    **CTES,
)
def _stream_scores(t):
    folder = _folder(t)
    scored = score_stream(_streams(t).requests).select("txn_id", "risk_score", "risk_level", "action")
    write_by_action(scored, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("txn_id", r("risk_score").alias("risk_score"), "risk_level", "action")
