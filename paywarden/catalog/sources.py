"""Sources and sinks: tables are written to the shared scratch folder, read back and compared with the input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paywarden.catalog.feedback import _usage_lines
from paywarden.catalog.registry import QUERIES, query
from paywarden.schema import TABLES
from paywarden.session import scratch_folder
from paywarden.sources import dataset as ds
from paywarden.sources import side_inputs as si


def _folder(t) -> str:
    return f"{scratch_folder(t.spark, 'paywarden-files-')}/files-{uuid.uuid4().hex}"


def _sql(name: str) -> str:
    """The oracle of a registered query, whose input is the same."""
    return QUERIES[name].sql


@query(
    "verdict_store_round_trip",
    "A-10",
    """SELECT transaction_id, ts_us, analyst_verdict, analyst_confidence, array_to_string(key_signals, ',') AS key_signals, CASE WHEN analyst_verdict = 'FRAUD' THEN 'first' ELSE 'second' END AS batch_id,
    cast(cast(make_timestamp(ts_us) as date) as varchar) AS verdict_date FROM verdicts""",
)
def _verdict_store(t):
    path = _folder(t)
    fraud = F.col("analyst_verdict") == "FRAUD"
    wanted = [c.split()[0] for c in si.VERDICT_SCHEMA.split(",") if c.split()[0] in t.verdicts.columns]
    rows = t.verdicts.select(*wanted)
    # The first batch is written twice, as by a job that was run again.
    for part, batch in ((fraud, "first"), (~fraud, "second"), (fraud, "first")):
        si.append_verdicts(rows.filter(part), path, batch)
    return si.read_verdicts(t.spark, path).select(
        "transaction_id", "ts_us", "analyst_verdict", "analyst_confidence", F.array_join("key_signals", ",").alias("key_signals"),
        "batch_id", F.col("verdict_date").cast("string").alias("verdict_date"),
    )


@query(
    "channel_event_log",
    "A-9",
    "SELECT txn_id, payer_id, payee_id, ts_us, cents, channel FROM payments WHERE channel = 'web'",
)
def _event_log(t):
    path = _folder(t)
    events = t.payments.select("txn_id", "payer_id", "payee_id", "ts_us", "cents", "channel")
    for _ in range(2):
        si.append_channel_events(events, path, "web", "day")
    return t.spark.read.schema(events.schema).json(path).select(*events.columns)


@query(
    "retained_rows",
    "A-13",
    "SELECT txn_id, cents, CASE WHEN rail = 'neft' THEN device_id END AS device_id FROM payments WHERE rail IN ('neft', 'card_cnp')",
)
def _retained(t):
    path = _folder(t)
    rows = t.payments.select("txn_id", "cents", "device_id", "rail")
    rows.filter("rail = 'neft'").drop("rail").write.parquet(f"{path}/neft")
    rows.filter("rail = 'card_cnp'").drop("rail", "device_id").write.parquet(f"{path}/card")
    return ds.read_existing(t.spark, [f"{path}/neft", f"{path}/never_written", f"{path}/card"])


@query(
    "dataset_round_trip",
    "A-1 A-4 A-5",
    """SELECT 'labels' AS name, txn_id AS id, cast(is_fraud as varchar) AS value FROM labelrows
    UNION ALL SELECT 'transactions', txn_id, cast(ts_us as varchar) || '/' || cast(cents as varchar) FROM payments
    UNION ALL SELECT 'merchants', merchant_id, volume_growth_curve FROM merchants""",
)
def _round_trip(t):
    path = _folder(t)
    given = {"transactions": t.payments.withColumn("timestamp", F.timestamp_micros("ts_us")), "labels": t.labels, "merchants": t.merchants}
    for name, schema in TABLES.items():
        if name in given:
            df = given[name]
            absent = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
            ds.write_table(df.withColumns(absent), name, path)
        else:
            ds.write_empty_table(t.spark, name, path)
    back = ds.load_dataset(t.spark, path)
    payments = ds.with_event_time(back["transactions"])
    parts = [
        back["labels"].select(F.lit("labels").alias("name"), F.col("txn_id").alias("id"), F.col("is_fraud").cast("string").alias("value")),
        payments.select(F.lit("transactions"), "txn_id", F.concat_ws("/", "ts_us", "cents")),
        back["merchants"].select(F.lit("merchants"), "merchant_id", "volume_growth_curve"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("usage_log_file", "A-11", _sql("usage_log"))
def _usage_file(t):
    path = _folder(t)
    _usage_lines(t).write.text(path)
    return si.read_usage_log(t.spark, path).select(F.unix_micros("used_at").alias("used_us"), "cost_usd")
