"""Plans and calls that must stay small, whatever the rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paywarden.operators import ml
from paywarden.operators.detectors import mandate_anomalies
from paywarden.operators.scan import CHUNK, Metric, find_hot_keys, prefix_scan
from paywarden.streaming.links import FIELDS, SessionRing
from paywarden.streaming.velocity import PayerVelocity


class Cell:
    """List and value state that counts its calls."""

    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def get(self):
        self.calls.append("get")
        return iter(self.rows) if isinstance(self.rows, list) else self.rows

    def exists(self):
        self.calls.append("exists")
        return bool(self.rows)

    def put(self, rows):
        self.calls.append("put")
        self.rows = list(rows)

    def appendList(self, rows):
        self.calls.append("append")
        self.rows += rows

    def update(self, row):
        self.calls.append("update")
        self.rows = row

    def clear(self):
        self.calls.append("clear")
        self.rows = []


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getListState(self, *_):
        return Cell(self.calls)

    getValueState = getListState

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.append(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_velocity_asks_the_state_store_a_few_times_only():
    handle, payer = Handle(), PayerVelocity()
    payer.init(handle)
    frame = pd.DataFrame({
        "ts_us": range(0, 600), "txn_id": [f"t{i}" for i in range(600)], "cents": [100] * 600, "payee_id": [f"p{i % 300}" for i in range(600)],
        "device_id": [None] * 600, "ip_asn": ["a"] * 600,
    })
    for part in (frame[:400], frame[400:]):
        list(payer.handleInputRows(("x",), iter([part]), None))
        (out,) = payer.handleExpiredTimer(("x",), At(1), None)
        assert len(out) == len(part)
        assert out["new_merchant_indicator"].sum() == (300 if part.index[0] == 0 else 0) and not out["new_device_indicator"].any()
    assert len(handle.calls) < 40


def test_sessions_of_a_part_share_calls_and_leave_one_by_one():
    handle, ring = Handle(), SessionRing(n=2, ttl_us=1_000_000)
    ring.init(handle)
    rows = [(f"s{i % 50}", i // 50 * 1000 + i % 50 * 10_000, f"t{i:04d}", 1.0, True, True, True, 5, True) for i in range(250)]
    random.Random(1).shuffle(rows)
    frame = pd.DataFrame(rows, columns=["session_id", *FIELDS])
    (pairs,) = ring.handleInputRows((0,), iter([frame]), None)
    # Of five payments of a session those after the first meet one, two, two and two.
    assert len(pairs) == 50 * 7 and len(handle.calls) < 10 and len(ring._rings.rows) == 100
    assert (pairs["a_ts_us"] <= pairs["b_ts_us"]).all()
    list(ring.handleExpiredTimer((0,), At(handle.timers[-1]), None))
    assert {r[0] for r in ring._rings.rows} == {f"s{i}" for i in range(1, 50)}
    list(ring.handleExpiredTimer((0,), At(10_000), None))
    assert ring._rings.rows == []


def test_first_registrations_are_not_joined(spark):
    rows = [(f"m{i}", "p", 10.0, 1.0, i, 3 if i == 2 else None, "m2" if i in (5, 6) else "gone" if i == 7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "mandate_id string, payer_id string, max_amount double, actual_amount double, created_us long, cancelled_us long, re_registered_from_mandate_id string")
    out = mandate_anomalies(df, 3.0)
    got = out.groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in got} == {"limit_far_above_charge": 400, "re_registered_after_cancel": 2}
    # Only rows with an earlier mandate pass the join's exchange.
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()


def test_small_ranges_share_a_file(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), "id")
    hot = find_hot_keys(df, ["k"], "id", 40)
    _, rows = hot.lanes(df, ["id"])
    assert hot.ranges == 150 and rows.rdd.getNumPartitions() == 1
    sizes = [r["count"] for r in rows.groupBy(CHUNK).count().collect()]
    assert len(sizes) > 100 and max(sizes) < 200
    got = prefix_scan(df, ["k"], ["id"], {"n": Metric("sum", F.lit(1).cast("long"))}, hot)
    assert got.filter("n <> id div 2").count() == 0 and got.count() == 6000


def test_rows_for_a_fit_have_no_lineage_and_few_tasks(spark):
    df = spark.range(40_000, numPartitions=64).withColumn("x", F.rand(1)).repartition(64)
    rows = ml.to_iterate(df)
    assert rows.count() == 40_000 and rows.rdd.getNumPartitions() == 3
    plan = rows._jdf.queryExecution().logical().toString()
    assert "rand" not in plan.lower()
    rows.unpersist()


def test_a_stress_matrix_plans_the_model_once(spark):
    rows = [(f"t{i}", i % 2, "train" if i % 4 < 2 else "validation" if i % 4 == 2 else "test", float(i % 7), float(i % 2 * 3 + i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "txn_id string, y int, split string, a double, b double").withColumn("c", F.lit("v"))
    model, _, _ = ml.train_fraud_model(df, ["c"], ["a", "b"], {"boosted_trees": ml.classifiers(rounds=2, depth=2)["boosted_trees"]}, guard=False)
    fraud = df.filter("y = 1")
    out = ml.stress_matrix(model, {f"v{i}": fraud.withColumn("a", F.lit(float(i))) for i in range(12)}, model.threshold)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < text.count("UDF(") < 12
    one = {f"v{i}": model.score(fraud.withColumn("a", F.lit(float(i)))).filter(F.col("score") > model.threshold).count() for i in range(12)}
    assert {r["generation"]: r["caught"] for r in out.collect()} == one and out.first()["total"] == 200


@pytest.mark.parametrize("name", ["cluster_families"])
def test_clusters_run_the_rows_plan_once(spark, name):
    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            ran.add(len(b))
            yield b

    df = spark.range(60).select((F.col("id") % 3).cast("double").alias("a"), F.col("id").cast("double").alias("b")).mapInPandas(seen, "a double, b double")
    assert getattr(ml, name)(df, ["a", "b"], k_max=3).count() == 2
    assert ran.value == 60
