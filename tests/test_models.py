"""The model queries train on all features, and overrides are whole."""

import pytest

from pyspark.sql import functions as F

from paywarden.catalog import models
from paywarden.operators import ml
from paywarden.schema import ALL_FEATURES
from paywarden.sources.adapter import DriverTables


def test_all_features_and_overrides(spark):
    df = models.training_frame(DriverTables(spark, "/root/testdata/sf0.001"))
    assert [*models.CATEGORICAL, *models.NUMERIC] == list(ALL_FEATURES) and set(ALL_FEATURES) <= set(df.columns)
    given = {"amount_range": (10, 20), "probe_count": 6, "final_amount_multiplier": 4.0, "num_mule_hops": 50}
    for name, changes in ml.OVERRIDES.items():
        assert set(changes) <= set(ml.apply_overrides(df, [(name, given.get(name))]).columns)
    with pytest.raises(ValueError, match="edge_count"):
        ml.apply_overrides(df.drop("edge_count"), ["use_single_top_counterparty"])


def test_overrides_of_mixed_families(spark):
    cols = ["amount", "amount_spent_last_1h", "tx_hour", "edge_count", "beneficiary_added_ago_s"]
    df = spark.range(400).select(F.concat(F.lit("t"), "id").alias("txn_id"), *[F.lit(100.0).alias(c) for c in cols])
    small = ml.apply_overrides(df, ["small_amounts"]).collect()
    assert all(0.99 <= r["amount"] < 9.99 and r["amount_spent_last_1h"] == pytest.approx(3 * r["amount"]) for r in small)
    rows = df.withColumn("time_since_prev_txn", F.lit(0.0))
    assert {r["tx_hour"] for r in ml.apply_overrides(rows, ["timing_mimics_user"]).collect()} == {9, 10, 14, 15, 20, 21}
    names = [("num_mule_hops", 50), ("final_amount_multiplier", 4.0), "spoof_multiple_features"]
    for r in ml.apply_overrides(df, names).collect():
        assert (r["edge_count"], r["amount"]) == (10, 400) and r["beneficiary_added_ago_s"] % 86_400 == 0
    with pytest.raises(ValueError, match="value"):
        ml.apply_overrides(df, ["probe_count" if "txn_count_last_24h" in df.columns else "num_mule_hops"])
    varied = [r[c] for r in ml.vary_features(df, cols).collect() for c in cols]
    changed = [v for v in varied if v != 100.0]
    assert 0.05 < len(changed) / len(varied) < 0.11 and all(85 <= v <= 115 for v in changed)


@pytest.mark.parametrize("max_rows", [7, 10**9])
def test_draws_follow_the_pool(spark, max_rows):
    pool = spark.createDataFrame([("a", 1.0)] * 30 + [("b", 2.0)] * 10 + [("c", None)] * 5, "txn_id string, x double").withColumn("none", F.lit(None).cast("int"))
    rows = spark.range(800).select(F.concat(F.lit("r"), "id").alias("txn_id"), F.lit(-1.0).alias("x"), F.lit(9).alias("none"))
    got = ml.with_drawn(ml.draw_from(rows, pool, ["x", "none"], max_rows=max_rows), ["x", "none"]).collect()
    assert len(got) == 800 and {r["none"] for r in got} == {9} and {r["x"] for r in got} == {1.0, 2.0}
    assert 0.68 < sum(r["x"] == 1.0 for r in got) / 800 < 0.82
    # The place decides the value.
    exact = ml.draw_from(spark.range(40).select("id"), pool, ["x"], "id", unit=lambda f: F.col("id") / 40, max_rows=max_rows)
    assert sorted((r["id"], r["_drawn_x"]) for r in exact.collect()) == [(i, 1.0 if i < 30 else 2.0) for i in range(40)]
