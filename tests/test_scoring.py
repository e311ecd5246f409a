"""Risk fusion anchors and the output contract."""

import pytest
from pyspark.sql import functions as F

from paywarden.functions import scalars as sc
from paywarden.operators import scoring
from paywarden.sources.requests import parse_requests

CALM = {
    "probability": 0.0, "amount": 500.0, "pin_attempts": 1, "screen_share_active": False, "call_active_during_txn": False,
    "accessibility_service_active": False, "beneficiary_added_ago_s": 900_000.0, "beneficiary_first_time": False,
    "edge_count": 3.0, "historical_average_amount": 450.0, "amount_deviation": 50.0, "ip_is_proxy": False,
    "new_device_indicator": False, "new_ip_indicator": False, "auth_method": "upi_pin", "auth_result": "success",
    "rail": "upi_p2p", "channel": "app", "payee_id": "p", "device_is_known_for_payer": True, "geo_matches_payer_home": True,
}


def assess(spark, *changes, probs=None, **kw):
    rows = [{**CALM, **c} for c in (changes or ({},))]
    names = list(CALM)
    schema = ", ".join(
        f"{n} {'boolean' if isinstance(CALM[n], bool) else 'int' if n == 'pin_attempts' else 'double' if isinstance(CALM[n], float) else 'string'}"
        for n in names
    )
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    pairs = [F.lit(x) for kv in (probs or {}).items() for x in kv]
    probs_col = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    return scoring.narrate(scoring.assess(df.withColumn("attack_probabilities", probs_col), **kw)).collect()


def test_base_score_anchors_and_monotone(spark):
    ps = [0.0, 0.004, 0.008, 0.1, 0.35, 0.6, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(sc.calibrated_base_score("p", 0.008, 0.35)).collect()]
    assert [got[0], got[2], got[4], got[6]] == pytest.approx([0, 30, 60, 100])
    assert got == sorted(got)
    zero = [r[0] for r in df.select(sc.calibrated_base_score("p", 0.0, 0.0)).collect()]
    assert zero[0] == 60.0 and zero[-1] == 100.0
    assert df.select(sc.calibrated_base_score("p", 0.5, 1.0)).collect()[-1][0] == 100.0


def test_ramps(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,), (3.0,), (9.0,)], "v double")
    assert [r[0] for r in df.select(sc.ramp_up("v", 1.0, 3.0)).collect()] == [0.0, 0.0, 0.5, 1.0, 1.0]
    assert [r[0] for r in df.select(sc.ramp_down("v", 1.0, 3.0)).collect()] == [0.0, 1.0, 0.5, 0.0, 0.0]


def test_calm_payment_is_allowed(spark):
    (r,) = assess(spark)
    assert r["risk_score"] == 0.0 and (r["risk_level"], r["action"]) == ("LOW", "ALLOW")
    assert r["contributing_signals"] == [] and r["key_evidence"] == ["Score of the model"]
    assert r["top_attack"] is None and r["attack_family_interpretation"].startswith("No pattern was named")


def test_policy_floors(spark):
    got = assess(
        spark,
        {"pin_attempts": 3, "amount": 10_001.0},
        {"pin_attempts": 5, "amount": 100_000.0},
        {"call_active_during_txn": True, "amount": 100_000.0},
        {"auth_method": "none"},
        {"beneficiary_added_ago_s": 43_199.0},
        {"beneficiary_added_ago_s": 43_199.0, "beneficiary_first_time": True},
        {"device_is_known_for_payer": False, "geo_matches_payer_home": False},
        {"rail": "card_cnp", "auth_result": "failure", "amount": 14.0},
    )
    scores = [r["risk_score"] for r in got]
    assert scores[0] == pytest.approx(85.0, abs=0.01) and scores[1] == pytest.approx(95.0)
    assert scores[2] == pytest.approx(98.0)
    assert scores[3:] == pytest.approx([75.0, 55.0, 0.0, 65.0, 70.0])
    assert got[3]["action"] == "BLOCK" and got[4]["action"] == "REVIEW"
    assert "Paid without any authentication" in got[3]["contributing_signals"]


def test_no_auth_rails_can_be_exempt(spark):
    rows = ({"auth_method": "none", "rail": "wallet"}, {"auth_method": "none", "rail": "neft"})
    assert [r["risk_score"] for r in assess(spark, *rows)] == [75.0, 75.0]
    assert [r["risk_score"] for r in assess(spark, *rows, no_auth_rails_exempt=True)] == [0.0, 75.0]


def test_severity_and_confidence(spark):
    (r,) = assess(spark, {"probability": 0.9}, probs={"mule_network": 0.6, "unheard_of": 0.4})
    assert r["expected_severity"] == pytest.approx(0.6 * 1.0 + 0.4 * 0.5)
    assert r["model_confidence"] == pytest.approx(0.8 * 0.7 + 0.6 * 0.3)
    assert r["model_uncertainty"] == pytest.approx(1 - r["model_confidence"])
    assert "'mule_network' at 60.0%" in r["attack_family_interpretation"]
    assert r["risk_score"] <= 100.0


def test_nulls_are_no_risk(spark):
    (r,) = assess(spark, {"beneficiary_added_ago_s": None, "edge_count": None, "amount_deviation": None, "pin_attempts": None})
    assert r["risk_score"] == 0.0


def test_equal_families_go_by_name(spark):
    df = spark.sql("SELECT map('b', 0.4D, 'a', 0.4D, 'c', 0.2D) AS m")
    assert df.select(sc.top_family("m").alias("t")).first()["t"]["family"] == "a"


def test_triage_bounds_and_errors(spark):
    df = spark.createDataFrame(
        [(0.99, 10.0), (0.55, 10.0), (0.1, 10.0), (None, 10.0)], "probability double, amount double"
    ).withColumns({"channel": F.lit("app"), "payee_id": F.lit("p"), "contributions": F.expr("array(named_struct('name', 'edge_count', 'contribution', 0.2D))")})
    got = scoring.triage(df).collect()
    assert [r["analyst_verdict"] for r in got] == ["FRAUD", "FRAUD", "LEGITIMATE", "ERROR"]
    assert [r["analyst_confidence"] for r in got] == pytest.approx([0.95, 0.70, 0.90, 0.0])
    assert got[0]["key_signals"] == ["edge count (+20.0%)"] and got[3]["key_signals"] == []


def test_request_parsing(spark):
    df = spark.createDataFrame(
        [('{"transaction": {"amount": 120.5, "channel": "app"}, "baseline_amount": 100}',),
         ('{"transaction": {"amount": 7, "amount_deviation": 1.0}}',), ("not json",)], "body string",
    )
    got = parse_requests(df).collect()
    assert (got[0]["historical_average_amount"], got[0]["amount_deviation"]) == (100.0, 20.5)
    assert got[1]["amount_deviation"] == 1.0 and got[1]["historical_average_amount"] is None
    assert got[2]["amount"] is None


def test_money(spark):
    df = spark.createDataFrame([(1.005,), (0.0,), (2.125,)], "v double")
    assert [str(r[0]) for r in df.select(sc.money("v")).collect()] == ["1.01", "0.01", "2.13"]
