"""Work that must not grow faster than the rows."""

import pytest
from pyspark.sql import functions as F

from paywarden.operators import features as feat
from paywarden.operators import ml, quantiles, scan
from paywarden.operators.scan import CHUNK, find_hot_keys, sliding


def test_ranges_need_no_exchange_of_their_number(spark, monkeypatch):
    monkeypatch.setattr(scan, "cut_lineage", lambda df: df)
    monkeypatch.setattr(scan, "MAX_RANGE_PARTS", 10, raising=False)
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), "id")
    _, rows = find_hot_keys(df, ["k"], "id", 40).lanes(df, ["id"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 150" not in plan
    # Ranges are whole, in the order of the rows, and hold no more than their share.
    got = rows.groupBy(CHUNK).agg(F.min(F.struct("k", "id")).alias("lo"), F.max(F.struct("k", "id")).alias("hi"), F.count("*").alias("n")).orderBy(CHUNK).collect()
    assert len(got) == 150 and {r["n"] for r in got} == {40}
    assert all(a["hi"] < b["lo"] for a, b in zip(got, got[1:], strict=False))


def test_scans_that_follow_each_other_part_the_rows_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            ran.add(len(b))
            yield b

    source = spark.range(300).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 30)).alias("k"), (F.col("id") * 1000).alias("ts"),
        F.concat(F.lit("t"), F.lpad("id", 4, "0")).alias("id"), (F.col("id") % 7).cast("string").alias("v"),
    )
    df = source.mapInPandas(seen, source.schema)
    args = (["k"], "ts", "id", {"w": 50_000})
    hot = find_hot_keys(source, ["k"], "ts", 100)
    got = sliding(df, *args, distincts={"d": "v"}, hot=hot).select("id", "count_w", "d_w").collect()
    # Twice for the hot rows, whose ranges are sampled before they are written, and once for the others.
    assert ran.value == 900
    assert sorted(got) == sorted(sliding(source, *args, distincts={"d": "v"}).select("id", "count_w", "d_w").collect())


def test_values_that_most_rows_share_become_no_rows(spark, monkeypatch):
    written = []
    cut = quantiles.cut_lineage
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    i = F.col("id")
    df = spark.range(40_000).select(
        (i % 2).cast("int").alias("y"), (i % 5 == 0).cast("int").alias("flag"), (i % 50 == 0).cast("double").alias("rare"), F.when(i % 3 == 0, -0.0).otherwise(0.0).alias("zero"),
        F.when(i % 400 < 39, 1.0).otherwise(i.cast("double")).alias("mixed"), F.lit(float("nan")).alias("nan"), F.lit(None).cast("double").alias("none"),
    )
    names = ["flag", "rare", "zero", "mixed", "nan", "none"]
    probs = {"lo": 0.05, "hi": 0.95}
    got = quantiles.bracketed_quantiles(df, ["y"], names, probs, accuracy=100).collect()
    want = {
        (r["y"], f, r["n_values"], str(r["lo"]), str(r["hi"]))
        for f in names[:-1] for r in quantiles.exact_quantiles(df.withColumn("v", F.col(f).cast("double")), ["y"], "v", probs, "linear").collect()
    }
    assert {(r["y"], r["feature"], r["n_values"], str(r["lo"]), str(r["hi"])) for r in got} == want and len(got) == 10
    # Only the bracket of the one column with many values was counted.
    assert {r["_f"] for r in written[1].select("_f").distinct().collect()} == {names.index("mixed")}


@pytest.mark.parametrize("n", [300, 30_000])
def test_rows_compare_with_bounds_that_are_computed_before(spark, monkeypatch, n):
    written = []
    cut = quantiles.cut_lineage
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df: written.append(df) or cut(df))
    df = spark.range(n).select((F.col("id") % 2).cast("int").alias("y"), ((F.col("id") * 7919) % n).cast("double").alias("x"))
    got = quantiles.bracketed_quantiles(df, ["y"], ["x"], {"lo": 0.05, "hi": 0.95}, accuracy=100).collect()
    want = {(r["y"], r["n_values"], r["lo"], r["hi"]) for r in quantiles.exact_quantiles(df, ["y"], "x", {"lo": 0.05, "hi": 0.95}, "linear").collect()}
    assert {(r["y"], r["n_values"], r["lo"], r["hi"]) for r in got} == want
    assert "_e0" not in written[0].columns and "_e0" not in written[1]._jdf.queryExecution().optimizedPlan().toString()


def test_wide_rows_are_exchanged_once_after_the_windows(spark, monkeypatch):
    rows = [(f"T{i:04d}", f"P{i % 30}", f"Q{i % 24}", i * 3_600_000_000, i + 1) for i in range(240)]
    base = spark.createDataFrame(rows, "txn_id string, payer_id string, payee_id string, ts_us long, cents long")
    payments = base.select(
        "*", (F.col("cents") / 100).cast("decimal(12,2)").alias("amount"), F.lit(None).cast("string").alias("merchant_id"), F.lit("D").alias("device_id"),
        F.lit("A").alias("ip_asn"), F.lit("imps").alias("rail"), F.lit(False).alias("is_agent_initiated"), F.lit(False).alias("beneficiary_first_time"),
        F.col("cents").alias("beneficiary_added_ago_s"), F.lit("a").alias("tpap_app"), F.lit("L").alias("linked_account_id"),
    )
    parties = spark.range(28).select(F.concat(F.lit("P"), "id").alias("party_id"), (F.col("id") * 10).cast("int").alias("account_age_days"))
    labels = base.filter("cents % 2 = 0").select("txn_id", (F.col("cents") % 3 == 0).alias("is_fraud"), F.lit(False).alias("is_legit_lookalike"))
    monkeypatch.setattr(scan, "ROWS_PER_SPREAD_TASK", 10)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = feat.feature_frame(payments, parties, labels)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["txn_id"]: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    # The joins on txn_id have as many tasks as the rows need; no wide row goes back to its payer.
    by_id = [x for x in plan.splitlines() if "hashpartitioning(txn_id" in x]
    assert len(by_id) == 3 and all(", 24)" in x for x in by_id), by_id
    assert not [x for x in plan.splitlines() if "hashpartitioning(payer_id" in x and "ENSURE_REQUIREMENTS" in x and ", 24)" not in x and "payee" not in x]
    assert out.columns[:2] == ["txn_id", "payer_id"] and len(got) == 240
    assert all(r["account_age_days"] == (None if int(r["payer_id"][1:]) >= 28 else int(r["payer_id"][1:]) * 10) for r in got.values())
    assert all(r["is_fraud"] == (r["cents"] % 2 == 0 and r["cents"] % 3 == 0) for r in got.values())


def test_fits_have_few_tasks_that_hold_few_rows():
    assert [ml.fit_tasks(n, 12) for n in (0, 16_384, 60_000, 3_600_000, 21_600_000)] == [1, 1, 4, 24, 87]
