"""Metrics against loops, feedback rules, sampling, and detectors under skew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paywarden.operators import detectors as d
from paywarden.operators import feedback as fb
from paywarden.operators import metrics as m
from paywarden.operators import ml, sampling
from paywarden.plans.promotion import ModelStore
from paywarden.sources.adapter import DriverTables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        y = int(rnd.random() < 0.2)
        rows.append((f"t{i}", y, round(min(1.0, max(0.0, rnd.gauss(0.6 if y else 0.3, 0.2))), 2), rnd.choice("ab")))
    return spark.createDataFrame(rows, "txn_id string, y int, score double, family string"), rows


@pytest.mark.parametrize("max_rows", [10**9, 25])
def test_curves_match_loops(scored, max_rows):
    df, rows = scored
    y, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    area = m.area_metrics(df, max_rows=max_rows).first()
    pos, neg = s[y == 1], s[y == 0]
    roc = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert area["roc_auc"] == pytest.approx(roc)
    pts, pr = [(0.0, 1.0)], 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        pts.append(((hit & (y == 1)).sum() / len(pos), (hit & (y == 1)).sum() / hit.sum()))
    for (r0, p0), (r1, p1) in zip(pts, pts[1:], strict=False):
        pr += (r1 - r0) * (p1 + p0) / 2
    assert area["pr_auc"] == pytest.approx(pr)
    for row in m.operating_points(df, (0.0, 0.01, 0.2), max_rows=max_rows).collect():
        ok = [t for t in set(s) if (neg >= t).mean() <= row["target_fpr"]]
        want = min(ok) if ok else float("inf")
        assert row["threshold"] == want
        assert row["recall"] == pytest.approx((pos >= want).mean())


def test_no_fitting_point_gives_infinity(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.9)], "y int, score double")
    row = m.operating_points(df, (0.001,)).first()
    assert row["threshold"] == float("inf") and row["recall"] == 0.0 and row["precision"] == 0.0


def test_sweep_matches_confusion(scored):
    df, _ = scored
    sweep = {round(r["threshold"], 2): r for r in m.threshold_sweep(df).collect()}
    assert len(sweep) == 17
    for th in m.SWEEP[::4]:
        one = m.confusion(df, th).first()
        assert all(sweep[round(th, 2)][c] == pytest.approx(one[c]) for c in ("tp", "fp", "fn", "tn", "f1", "fpr"))
    best = m.best_threshold(m.threshold_sweep(df)).first()
    top = max(r["f1"] for r in sweep.values())
    assert best["f1"] == top and best["threshold"] == min(r["threshold"] for r in sweep.values() if r["f1"] == top)
    nothing = m.best_threshold(m.threshold_sweep(df.filter("y = 0"))).first()
    assert (nothing["threshold"], nothing["f1"]) == (0.5, 0.0)


def test_bootstrap_is_seeded_and_centred(scored):
    df, rows = scored
    a, b = m.bootstrap_recall(df, 0.5).first(), m.bootstrap_recall(df, 0.5).first()
    assert a == b and a["resamples"] == 100
    recall = np.mean([r[2] >= 0.5 for r in rows if r[1] == 1])
    assert a["ci_lower"] <= recall <= a["ci_upper"] and a["point_estimate"] == pytest.approx(recall, abs=0.03)
    assert m.bootstrap_recall(df, 0.5, seed=7).first() != a


def test_evasion_is_strict(spark):
    df = spark.createDataFrame([("gen2", 0.45), ("gen2", 0.46), ("gen9", 0.9)], "generation string, score double")
    got = {r["generation"]: r for r in m.evasion(df).collect()}
    assert (got["gen2"]["slipped"], got["gen2"]["status"]) == (1, "FAIL")
    assert (got["gen9"]["target"], got["gen9"]["status"]) == (0.05, "PASS")
    one = m.compare_generations(m.evasion(df.filter("generation = 'gen2'"))).first()
    assert one["trend"] == "unknown (single generation)"


def test_gate(spark):
    def gate(new, old):
        a = spark.createDataFrame([(new,)], "pr_auc double")
        b = None if old is None else spark.createDataFrame([(old,)], "pr_auc double")
        return m.promotion_gate(a, b).first()["decision"]

    assert (gate(0.95, 0.98), gate(0.97, 0.98), gate(0.5, None)) == ("rejected", "passed", "skipped")


def test_family_diversity_matches_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(f, *map(float, rng.normal(i, 1 + i, 3))) for i, f in enumerate("abc") for _ in range(8)]
    df = spark.createDataFrame(rows, "attack_id string, x double, y double, z double")
    got = m.family_diversity(df, ["x", "y", "z"]).first()
    v = np.array([r[1:] for r in rows])
    v = v / v.std(axis=0)
    groups = {f: v[[r[0] == f for r in rows]] for f in "abc"}

    def rms(a, b, same):
        dist = [((p - q) ** 2).sum() for i, p in enumerate(a) for j, q in enumerate(b) if not same or i != j]
        return np.sqrt(np.mean(dist))

    intra = np.mean([rms(g, g, True) for g in groups.values()])
    inter = np.mean([rms(groups[a], groups[b], False) for a, b in ("ab", "ac", "bc")])
    assert got["avg_intra"] == pytest.approx(intra) and got["avg_inter"] == pytest.approx(inter)


@pytest.mark.parametrize("max_rows", [30, 10**9])
def test_mean_pair_distance_is_near_all_pairs(spark, max_rows):
    rng = np.random.default_rng(4)
    sizes = {"a": 90, "b": 40, "c": 7, "d": 1}
    rows = [(f"{f}{j}", f, *map(float, rng.normal(i, 1 + i, 3))) for i, (f, n) in enumerate(sizes.items()) for j in range(n)]
    rows += [("n1", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "txn_id string, attack_id string, x double, y double, z double")
    got = m.mean_pair_distance(df, ["x", "y", "z"], max_rows=max_rows).first()
    kept = [r for r in rows if r[1]]
    v = np.array([r[2:] for r in kept])
    v = v / v.std(axis=0)
    groups = {f: v[[r[1] == f for r in kept]] for f in "abc"}

    def mean(a, b):
        far = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        return far[far > 0].mean()

    intra = np.mean([mean(g, g) for g in groups.values()])
    inter = np.mean([mean(groups[a], groups[b]) for a, b in ("ab", "ac", "bc")])
    assert got["n_families"] == 3
    assert 0 < got["intra_error"] < 0.1 * intra and abs(got["avg_intra"] - intra) < 3 * got["intra_error"]
    assert 0 < got["inter_error"] < 0.1 * inter and abs(got["avg_inter"] - inter) < 3 * got["inter_error"]
    # A family no larger than its partners is counted whole.
    one = m.mean_pair_distance(df.filter("attack_id = 'c'"), ["x", "y", "z"]).first()
    w = np.array([r[2:] for r in kept if r[1] == "c"])
    w = w / w.std(axis=0)
    assert one["avg_intra"] == pytest.approx(mean(w, w)) and one["avg_inter"] is None
    assert m.mean_pair_distance(df.limit(0), ["x"]).first()["n_families"] == 0


def test_verdicts_latest_wins_and_moves_to_train(spark):
    rows = spark.createDataFrame([("t1", 0, "test"), ("t2", 1, "validation")], "txn_id string, y int, split string")
    verdicts = spark.createDataFrame(
        [("t1", "LEGITIMATE", 0.8, 1), ("t1", "FRAUD", 0.9, 2), ("t2", "UNSURE", 0.5, 3), ("live", "FRAUD", 0.9, 4)],
        "transaction_id string, analyst_verdict string, analyst_confidence double, ts_us long",
    )
    got = {r["txn_id"]: (r["y"], r["split"]) for r in fb.apply_verdicts(rows, verdicts).collect()}
    assert got == {"t1": (1, "train"), "t2": (1, "validation")}
    assert [r["transaction_id"] for r in fb.unknown_verdicts(verdicts, rows).collect()] == ["live"]
    summary = fb.feedback_summary(verdicts).first()
    assert not summary["should_retrain"] and summary["reason"] == "Not enough feedback yet (4/5, 2/5 fraud)"
    more = fb.feedback_summary(verdicts.unionByName(verdicts.limit(1))).first()
    assert more["should_retrain"] and more["reason"] == "Enough total feedback (5 verdicts)"


def test_retained_rows_respect_the_fraud_share(spark):
    base = spark.range(2000).select(F.concat(F.lit("b"), "id").alias("txn_id"), (F.col("id") < 10).cast("int").alias("y"))
    retained = spark.range(4000).select(F.concat(F.lit("r"), "id").alias("txn_id"), F.lit(1).alias("y"))
    out = sampling.cap_retained(base, retained, "txn_id").agg(F.avg("y").alias("share"), F.count("*").alias("n")).first()
    assert 0.045 < out["share"] <= 0.05
    assert sampling.retained_budget(1000, 100, 0, 5000) == 100 and sampling.retained_budget(10_000, 1000, 0, 50) == 50


@pytest.mark.parametrize("n", [0, 1, 137, 500, 900])
def test_take_by_hash_is_exact_and_repeatable(spark, n):
    df = spark.range(500).select(F.concat(F.lit("t"), "id").alias("txn_id"))
    a = {r[0] for r in sampling.take_by_hash(df, n, "txn_id").collect()}
    b = {r[0] for r in sampling.take_by_hash(df.repartition(7), n, "txn_id").collect()}
    assert a == b and len(a) == min(n, 500)


def test_missing_evaluation_splits_are_made(spark):
    df = spark.range(1000).select("id", F.lit("train").alias("split"))
    out = sampling.ensure_evaluation_splits(df, F.pmod(F.xxhash64("id"), F.lit(1 << 31)))
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert n["validation"] == n["test"] and 100 < n["validation"] < 200 and n["train"] + n["validation"] == 1000


def test_usage_budget(spark):
    lines = spark.createDataFrame([("2026-03-02T10:00:00|0.4",)] * 2 + [("2026-03-03T10:00:00|0.001",)] * 20, "line string")
    got = {str(r["day"]): r["can_proceed"] for r in fb.daily_usage(fb.parse_usage(lines)).collect()}
    assert got == {"2026-03-02": True, "2026-03-03": False}


H = d.HOUR_US
CASES = {
    "scam": lambda t, k: d.scam_induced_push(t.payments, 4000, 480 * H, 1, max_rows=k),
    "mule": lambda t, k: d.mule_network(t.payments, 2, 24 * H, 48 * H, 0.5, max_rows=k),
    "probe": lambda t, k: d.card_testing_probe(t.payments, 400.0, 400 * H, 2, 1, max_rows=k),
    "slow": lambda t, k: d.adversarial_evasion(t.payments, 10_000.0, (0, 40 * H), 400 * H, 2, 10.0, max_rows=k),
    "dispute": lambda t, k: d.first_party_dispute(t.payments, t.disputes, 0, 1, max_rows=k),
    "mandate": lambda t, k: d.stealth_mandate(t.payments, 1, max_rows=k),
    "takeover": lambda t, k: d.credential_takeover(t.payments, 700 * H, 0, max_rows=k),
    "bustout": lambda t, k: d.synthetic_identity_bustout(t.payments, 3, 1.5, max_rows=k),
    "fragments": lambda t, k: d.subthreshold_fragmentation(t.payments, 400.0, 400 * H, 2, max_rows=k),
    "agent": lambda t, k: d.agentic_injection(t.payments, 700 * H, 1, max_rows=k),
    "insider": lambda t, k: d.insider_abuse(t.payments, 300 * H, 2, max_rows=k),
    "fan_out": lambda t, k: d.device_fan_out(t.payments, 300 * H, 2, max_rows=k),
    "drain": lambda t, k: d.balance_drain_exit(t.payments, 48 * H, (0.3, 0.95)),
    "switch": lambda t, k: d.tpap_account_switch(t.payments, 48 * H, 2, max_rows=k),
    "controls": lambda t, k: d.matched_controls(t.payments, t.labels, (0.2, 3.0), max_rows=k),
}


@pytest.mark.parametrize("name", CASES)
def test_detectors_agree_when_keys_are_hot(spark, name):
    """Cut every large key into chunks: the hits must stay the same."""
    t = DriverTables(spark, SF)
    plain = sorted(map(tuple, CASES[name](t, 10**9).collect()))
    cut = sorted(map(tuple, CASES[name](t, 30).collect()))
    assert plain == cut
    assert plain or name in ("mandate",)


def test_model_job_end_to_end(spark):
    from paywarden.catalog.models import CATEGORICAL, NUMERIC, training_frame
    from paywarden.plans.lifecycle import retrain_with_feedback

    t = DriverTables(spark, SF)
    rows = training_frame(t)
    models = {k: v for k, v in ml.classifiers(trees=5, rounds=3, depth=3).items() if k == "boosted_trees"}
    out = retrain_with_feedback(
        rows, t.verdicts, t.payments, None, spark.createDataFrame([(2.0,)], "pr_auc double"), CATEGORICAL, NUMERIC, models
    )
    assert out["gate"].first()["decision"] == "rejected"
    assert out["comparison"].count() == 1 and out["test"].count() > 0
    assert all(r["transaction_id"].startswith("LIVE") for r in out["quarantine"].collect())
    again = out["model"].score(rows.filter("split = 'test'"))
    assert again.filter("score < 0 or score > 1 or score is null").count() == 0


def test_promotion_is_a_commit(spark, tmp_path, monkeypatch):
    rows = spark.range(200).select(
        F.concat(F.lit("t"), "id").alias("txn_id"), (F.col("id") % 2).cast("int").alias("y"),
        (F.col("id") % 2 * 3 + F.col("id") % 5).cast("double").alias("x"), F.lit("train").alias("split"),
    )
    models = {"boosted_trees": ml.classifiers(rounds=2, depth=2)["boosted_trees"]}
    model, _, test = ml.train_fraud_model(rows, [], ["x"], models, guard=False)
    schema = "transaction_id string, analyst_verdict string, ts_us long"
    first = spark.createDataFrame([("t1", "FRAUD", 1), ("t2", "UNSURE", None)], schema)
    store = ModelStore(str(tmp_path / "store"))
    assert store.live(spark) is None and store.deployed(spark) is None and store.pending(first).count() == 2
    areas = m.area_metrics(test)
    assert store.promote(model, m.promotion_gate(areas, store.deployed(spark)), first, "x") == 1
    assert store.live(spark)["version"] == 1 and store.live(spark)["held_out"] == "x" and store.pending(first).count() == 0
    more = first.unionByName(spark.createDataFrame([("t1", "LEGITIMATE", 9)], schema))
    assert [r["ts_us"] for r in store.pending(more).collect()] == [9]

    # A rejected model changes nothing.
    worse = spark.createDataFrame([(store.live(spark)["pr_auc"] - 0.5,)], "pr_auc double")
    assert store.promote(model, m.promotion_gate(worse, store.deployed(spark)), store.pending(more)) is None
    assert store.live(spark)["version"] == 1 and store.pending(more).count() == 1

    # A run that ends between the writes and the commit leaves the old model live.
    same = m.promotion_gate(areas, store.deployed(spark))
    with monkeypatch.context() as patch:
        patch.setattr(ModelStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost driver")))
        with pytest.raises(OSError, match="lost driver"):
            store.promote(model, same, store.pending(more))
    assert store.live(spark)["version"] == 1 and store.pending(more).count() == 1
    assert store.promote(model, same, store.pending(more)) == 2 and store.pending(more).count() == 0
    assert store.load(spark).score(rows).count() == 200
    store.roll_back(spark, 1)
    assert store.live(spark)["version"] == 1 and store.history(spark).count() == 3 and store.pending(more).count() == 0
    assert store.promote(model, same, more) == 3


def test_masked_values_come_from_legit_rows(spark):
    fraud = spark.range(50).select(F.concat(F.lit("f"), "id").alias("txn_id"), F.lit(-1.0).alias("x"))
    legit = spark.range(10).select(F.concat(F.lit("l"), "id").alias("txn_id"), F.col("id").cast("double").alias("x"))
    a = {r["txn_id"]: r["x"] for r in ml.mask_features(fraud, legit, ["x"]).collect()}
    assert len(a) == 50 and set(a.values()) <= set(map(float, range(10))) and len(set(a.values())) > 3
    assert a == {r["txn_id"]: r["x"] for r in ml.mask_features(fraud.repartition(3), legit, ["x"]).collect()}
