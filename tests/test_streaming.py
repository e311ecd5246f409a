"""Streams against their batch twins and against plain loops."""

import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from paywarden.operators import features as feat
from paywarden.operators.sessions import session_links
from paywarden.streaming.jobs import retrain_trigger, score_stream, session_summary, write_by_action
from paywarden.streaming.links import link_sessions
from paywarden.streaming.quota import batch_quota, decide, stream_quota
from paywarden.streaming.velocity import LateRows, online_velocity, payee_fan_in

H = 3_600_000_000
BASE = 1_704_067_200_000_000


@pytest.fixture
def payments(spark, tmp_path):
    """Payments in three files by time, so a stream reads them in order."""
    rnd = random.Random(4)
    rows = []
    for i in range(120):
        day = i // 40
        rows.append(
            (
                f"T{i:04d}", f"P{rnd.randrange(3)}", f"P{rnd.randrange(5)}", BASE + (day * 24 + rnd.randrange(24)) * H,
                rnd.randrange(100, 90_000), f"D{rnd.randrange(3)}", f"AS{rnd.randrange(2)}", f"S{rnd.randrange(2)}_{day}",
                rnd.random() < 0.4, rnd.random() < 0.2, rnd.random() < 0.4, rnd.randrange(0, 8000), day,
            )
        )
    schema = (
        "txn_id string, payer_id string, payee_id string, ts_us long, cents long, device_id string, ip_asn string,"
        " session_id string, call_active_during_txn boolean, screen_share_active boolean, ip_is_proxy boolean,"
        " beneficiary_added_ago_s long, day int"
    )
    df = spark.createDataFrame(rows, schema).withColumn("amount", (F.col("cents") / 100).cast("decimal(12,2)"))
    df = df.withColumn("pin_attempts", F.lit(1))
    path = str(tmp_path / "in")
    for day in range(3):
        df.filter(F.col("day") == day).coalesce(1).write.mode("append").parquet(path)
    return df, path


def stream_of(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, mode, name, checkpoint):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return q


def closed(df, path):
    """One more payment of nobody, long after the others, so that the watermark passes them all."""
    df.limit(1).withColumns({"txn_id": F.lit("END"), "payer_id": F.lit("NOBODY"), "ts_us": F.lit(BASE + 900 * H)}).coalesce(1).write.mode("append").parquet(path)


def batch_velocity(df):
    full = df.select(
        "*", F.lit(None).cast("string").alias("merchant_id"), F.lit("imps").alias("rail"), F.lit(False).alias("is_agent_initiated"),
        F.lit(False).alias("beneficiary_first_time"), F.lit("").alias("tpap_app"), F.lit("").alias("linked_account_id"),
    )
    return {r["txn_id"]: r for r in feat.payer_history(feat.payer_velocity(full)).collect()}


def assert_velocity(got, want):
    assert set(got) == set(want)
    for t, g in got.items():
        for c in g:
            if isinstance(g[c], float):
                assert g[c] == pytest.approx(want[t][c]), (t, c)


def test_online_velocity_matches_batch(spark, payments, tmp_path):
    df, path = payments
    closed(df, path)
    run(online_velocity(stream_of(spark, df, path)), "append", "velocity", str(tmp_path / "cp"))
    assert_velocity({r["txn_id"]: r.asDict() for r in spark.table("velocity").collect()}, batch_velocity(df))


def test_online_velocity_of_shuffled_files(spark, payments, tmp_path):
    """Rows out of order within and across files, but inside the watermark, get the batch numbers."""
    df, _ = payments
    path = str(tmp_path / "shuffled")
    for k in range(4):
        df.filter(F.abs(F.xxhash64("txn_id")) % 4 == k).orderBy(F.hash("txn_id")).coalesce(1).write.mode("append").parquet(path)
    closed(df, path)
    run(online_velocity(stream_of(spark, df, path), "100 hours"), "append", "velocity_shuffled", str(tmp_path / "cp"))
    assert_velocity({r["txn_id"]: r.asDict() for r in spark.table("velocity_shuffled").collect()}, batch_velocity(df))


def test_late_rows_are_dropped_and_counted(spark, payments, tmp_path):
    df, path = payments
    closed(df, path)
    late = df.limit(1).withColumns({"txn_id": F.lit("LATE"), "ts_us": F.lit(BASE - 48 * H)})
    counter = LateRows()
    spark.streams.addListener(counter)
    try:
        for k in range(3):
            late.withColumn("txn_id", F.lit(f"LATE{k}")).coalesce(1).write.mode("append").parquet(path)
        q = run(online_velocity(stream_of(spark, df, path)), "append", "velocity_late", str(tmp_path / "cp"))
        other = run(online_velocity(stream_of(spark, df, path).filter("txn_id NOT LIKE 'LATE%'")), "append", "velocity_in_time", str(tmp_path / "cp2"))
        for _ in range(100):
            if counter.of(q) == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counter)
    ids = {r["txn_id"] for r in spark.table("velocity_late").collect()}
    assert not any(i.startswith("LATE") for i in ids) and len(ids) == 120
    # The counts are of one run each, however many progress entries a query still holds.
    assert counter.of(q) == 3 and counter.of(other) == 0


def test_payee_fan_in_windows(spark, payments, tmp_path):
    df, path = payments
    run(payee_fan_in(stream_of(spark, df, path), "24 hours", "24 hours"), "append", "fan_in", str(tmp_path / "cp"))
    rows = spark.table("fan_in").collect()
    assert rows
    for r in rows:
        lo = int(r["window"]["start"].timestamp() * 1e6)
        want = {
            x["payer_id"] for x in df.collect() if x["payee_id"] == r["payee_id"] and lo <= x["ts_us"] < lo + 24 * H
        }
        assert r["distinct_payers"] == len(want)


def brute_quota(rows, window, limit):
    buckets, out = {}, {}
    for client, rid, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        out[rid] = decide(buckets.setdefault(client, deque()), ts, window, limit)
    return out


def test_quota_batch_and_stream(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(f"c{rnd.randrange(2)}", f"r{i:04d}", BASE + rnd.randrange(0, 400) * 1_000_000) for i in range(300)]
    df = spark.createDataFrame(rows, "client string, request_id string, ts_us long")
    want = brute_quota(rows, 60_000_000, 10)
    assert any(not ok for ok, _ in want.values())
    for max_rows in (10**9, 40):
        got = batch_quota(df, 60_000_000, 10, max_rows).collect()
        assert {r["request_id"]: (r["accepted"], r["retry_after_s"]) for r in got} == want
    path = str(tmp_path / "in")
    for lo in (BASE, BASE + 200_000_000):
        df.filter((F.col("ts_us") >= lo) & (F.col("ts_us") < lo + 200_000_000)).coalesce(1).write.mode("append").parquet(path)
    run(stream_quota(stream_of(spark, df, path), 60_000_000, 10), "append", "quota", str(tmp_path / "cp"))
    got = spark.table("quota").collect()
    assert {r["request_id"]: (r["accepted"], r["retry_after_s"]) for r in got} == want


def test_quota_budget_slides_and_clients_are_apart():
    bucket = deque()
    assert all(decide(bucket, i, 60_000_000, 30)[0] for i in range(30))
    ok, wait = decide(bucket, 1_000_000, 60_000_000, 30)
    assert not ok and wait == 59
    assert decide(bucket, 60_000_000, 60_000_000, 30) == (True, None)
    assert decide(deque(), 1_000_000, 60_000_000, 30) == (True, None)


LINK = ("session_id", "source_txn", "target_txn", "similarity", "label", "summary")


@pytest.mark.parametrize("n, parts", [(50, 3), (4, 3), (4, 12)])
def test_session_links_stream_matches_batch(spark, payments, tmp_path, n, parts):
    df, _ = payments
    # Few long sessions, cut into files by time, so that links reach over the batches.
    df = df.withColumn("session_id", F.when(F.col("txn_id") == "T0005", None).otherwise(F.substring("session_id", 1, 2))).orderBy("ts_us", "txn_id")
    path, out = str(tmp_path / "by_time"), f"links_{n}_{parts}"
    times = [r[0] for r in df.select("ts_us").orderBy("ts_us", "txn_id").collect()]
    cuts = [times[i * len(times) // parts] for i in range(parts)] + [times[-1] + 1]
    for lo, hi in zip(cuts, cuts[1:]):
        df.filter((F.col("ts_us") >= lo) & (F.col("ts_us") < hi)).coalesce(1).write.mode("append").parquet(path)
    run(link_sessions(stream_of(spark, df, path), ttl_us=500 * H, n=n), "append", out, str(tmp_path / "cp"))
    got = sorted(map(tuple, spark.table(out).select(*LINK).collect()))
    assert got == sorted(map(tuple, session_links(df, n=n).select(*LINK).collect())) and got


def state_rows(q) -> list[int]:
    return [sum(op.numRowsTotal for op in p.stateOperators) for p in q.recentProgress]


def test_idle_sessions_leave_the_state(spark, payments, tmp_path):
    """Every file brings new sessions, a day apart from the last ones: the state holds those of about one file."""
    df, _ = payments
    path = str(tmp_path / "idle")
    base = df.limit(20)
    for k in range(6):
        base.withColumns({
            "ts_us": F.lit(BASE) + F.lit(k * 48) * H + F.hash("txn_id") % 1000, "txn_id": F.concat("txn_id", F.lit(f"_{k}")),
            "session_id": F.concat("txn_id", F.lit(f"_{k}")),
        }).coalesce(1).write.mode("append").parquet(path)
    q = run(link_sessions(stream_of(spark, df, path), ttl_us=H, late="1 hour"), "append", "links_idle", str(tmp_path / "cp"))
    rows = state_rows(q)
    assert len(rows) >= 6 and max(rows[3:]) <= max(rows[:3]) + 20 and max(rows) <= 100
    asked = df.select(F.col("txn_id").alias("client"), F.col("txn_id").alias("request_id"), "ts_us").limit(20)
    path = str(tmp_path / "asked")
    for k in range(6):
        asked.withColumns({"client": F.concat("client", F.lit(f"_{k}")), "ts_us": F.lit(BASE) + F.lit(k * 48) * H}).coalesce(1).write.mode("append").parquet(path)
    q = run(stream_quota(stream_of(spark, asked, path)), "append", "quota_idle", str(tmp_path / "cp2"))
    rows = state_rows(q)
    assert len(rows) >= 6 and max(rows[3:]) <= max(rows[:3]) + 20 and max(rows) <= 100
    assert spark.table("quota_idle").count() == 120


def test_retrain_trigger_updates(spark, tmp_path):
    schema = "transaction_id string, analyst_verdict string, analyst_confidence double, ts_us long"
    path = str(tmp_path / "in")
    for batch in ([("a", "FRAUD", 0.9, 1)] * 2, [("b", "FRAUD", 0.8, 2)] * 3):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    run(retrain_trigger(stream), "complete", "trigger", str(tmp_path / "cp"))
    (row,) = spark.table("trigger").collect()
    assert row["should_retrain"] and row["fraud_confirmed"] == 5


def test_scored_stream_is_written_by_action(spark, tmp_path):
    from paywarden.sources.adapter import DriverTables

    requests = DriverTables(spark, "/root/testdata/sf0.001").requests
    path = str(tmp_path / "in")
    requests.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(requests.schema).parquet(path)
    q = write_by_action(score_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == requests.count()
    assert {r["action"] for r in out.select("action").distinct().collect()} <= {"BLOCK", "REVIEW", "ALLOW"}
    batch = {r["txn_id"]: r["risk_score"] for r in score_stream(requests).collect()}
    assert all(batch[r["txn_id"]] == pytest.approx(r["risk_score"]) for r in out.collect())


def test_session_windows_on_a_stream(spark, payments, tmp_path):
    df, path = payments
    run(session_summary(stream_of(spark, df, path), "2 hours", late="1 hour"), "append", "sessions", str(tmp_path / "cp"))
    batch = {(r["session_id"], r["start_us"], r["n"]) for r in session_summary(df, "2 hours").collect()}
    got = {(r["session_id"], r["start_us"], r["n"]) for r in spark.table("sessions").collect()}
    # The last windows are still open when the input ends.
    assert got and got <= batch
