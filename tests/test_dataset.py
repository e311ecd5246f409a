"""Data set round trips, graph micro cases, splits and injected faults."""

from datetime import timedelta

import pytest
from helpers import END, START, columns, dataset, device, label, txn, us
from pyspark.sql import functions as F

from paywarden.operators import splits, validate
from paywarden.operators.features import with_labels
from paywarden.operators.graph import graph_edges
from paywarden.plans import lifecycle
from paywarden.schema import ALL_FEATURES, BEHAVIORAL_FEATURES, TABLES, TRANSACTIONS
from paywarden.sources import dataset as ds
from paywarden.sources import side_inputs as si


def test_schema_sizes():
    assert {n: len(s.fields) for n, s in TABLES.items()} == {
        "transactions": 43, "labels": 7, "parties": 11, "devices": 13, "merchants": 13, "mandates": 12,
        "disputes": 8, "graph_edges": 10,
    }
    assert len(ALL_FEATURES) == 81 and len(BEHAVIORAL_FEATURES) == 43
    assert not TRANSACTIONS["txn_id"].nullable and TRANSACTIONS["merchant_id"].nullable


def test_round_trip_and_missing_table(spark, tmp_path):
    folder = str(tmp_path / "data")
    tables = dataset(spark)
    for name, df in tables.items():
        ds.write_table(df.select(*reversed(df.columns)), name, folder)
    back = ds.load_dataset(spark, folder)
    for name, df in back.items():
        assert df.columns == TABLES[name].names
        assert df.count() == tables[name].count()
    assert columns(back["transactions"], "txn_id", "amount") == columns(tables["transactions"], "txn_id", "amount")
    ds.write_empty_table(spark, "mandates", str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty/mandates.parquet")).count() == 0
    with pytest.raises(FileNotFoundError):
        ds.load_dataset(spark, str(tmp_path / "empty"))


def test_edges_of_the_micro_case(spark):
    payments = ds.with_event_time(dataset(spark)["transactions"])
    for rows in (payments, payments.orderBy(F.col("ts_us").desc())):
        edges = {(r["src_party_id"], r["dst_party_id"]): r for r in graph_edges(rows, us(START), us(END)).collect()}
        bc = edges[("b", "c")]
        assert (bc["edge_count"], str(bc["edge_value_total"]), bc["mean_inter_arrival_s"]) == (3, "24.00", 5400.0)
        assert (bc["src_out_degree"], bc["dst_in_degree"], bc["is_two_hop_passthrough"]) == (1, 1, True)
        # d waits longer than a day before it pays on.
        assert not edges[("c", "d")]["is_two_hop_passthrough"] and edges[("d", "a")]["mean_inter_arrival_s"] == 0.0


def test_passthrough_needs_a_later_third_party(spark):
    def flag(rows):
        payments = ds.with_event_time(dataset(spark, rows)["transactions"])
        return {(r["src_party_id"], r["dst_party_id"]): r["is_two_hop_passthrough"] for r in graph_edges(payments).collect()}

    h = lambda n: START + timedelta(hours=n)
    into = txn(1, "d", "c", "52", h(7))
    onward = lambda i, to, hour: txn(i, "c", to, "48", h(hour))
    assert flag([into, onward(2, "a", 11)])[("d", "c")]
    assert not flag([into, onward(2, "d", 11)])[("d", "c")]
    assert not flag([into, onward(2, "a", 7)])[("d", "c")]
    assert flag([into, onward(2, "a", 31)])[("d", "c")]
    assert not flag([into, onward(2, "a", 32)])[("d", "c")]
    # Payments back to the payer do not hide the next one to someone else.
    assert flag([into, onward(2, "d", 8), onward(3, "d", 9), onward(4, "b", 12)])[("d", "c")]


def test_split_boundaries(spark):
    w = splits.split_windows(us(START), us(END))
    days = spark.createDataFrame([(us(START + timedelta(days=d)),) for d in (1, 55, 75, 90)], "ts_us long")
    got = [r[0] for r in days.select(splits.assign_split("ts_us", w)).collect()]
    assert got == ["train", "validation", "test", None]
    w = splits.split_windows(us(START), us(END), (0.5, 0.25, 0.25))
    days = spark.createDataFrame([(us(START + timedelta(days=d)),) for d in (41, 42, 70)], "ts_us long")
    assert [r[0] for r in days.select(splits.assign_split("ts_us", w)).collect()] == ["train", "validation", "test"]
    with pytest.raises(ValueError):
        splits.split_windows(0, 10, (0.5, 0.2, 0.2))
    with pytest.raises(ValueError):
        splits.split_windows(10, 10)


def checks_of(spark, tables):
    payments = ds.with_event_time(tables["transactions"])
    edges = graph_edges(payments, us(START), us(END))
    tables = {**tables, "graph_edges": lifecycle._edge_table(edges)}
    return {(r["check"], r["rule"]): r["n"] for r in lifecycle.leakage_checks(tables, us(START), us(END)).collect()}


def test_clean_dataset_passes(spark):
    assert checks_of(spark, dataset(spark)) == {}


def test_injected_faults_are_found(spark):
    rows = [
        txn(1, "a", "b", "10.00", START + timedelta(hours=1), device_id="missing-device"),
        txn(2, "a", "a", "-1.00", START + timedelta(hours=2), currency="USD"),
        txn(3, "a", "zz", "5.00", START + timedelta(days=200)),
        txn(4, "a", "b", "5.00", START + timedelta(hours=4), rail="cheque", decision="declined"),
    ]
    labels = [label("t1"), label("t1"), label("t2", is_fraud=True), label("t3"), label("t5")]
    tables = dataset(spark, rows, labels)
    tables["transactions"] = tables["transactions"].withColumn("is_fraud", F.lit(False))
    found = checks_of(spark, tables)
    for key in [
        ("references", "invalid device reference"), ("references", "invalid payee reference"),
        ("transactions", "payer_equals_payee"), ("transactions", "non_positive_amount"),
        ("transactions", "unexpected_currency"), ("transactions", "declined_without_reason"), ("vocabulary", "rail"),
        ("keys", "duplicate labels"), ("keys", "left_only"), ("keys", "right_only"), ("labels", "is_fraud"),
        ("splits", "outside every split window"), ("features", "label-only fields"),
        ("devices", "device_not_active"),
    ]:
        assert found.get(key), (key, found)
    assert found[("keys", "duplicate labels")] == 1


def test_device_chain(spark):
    devices = [
        device("old", retired_at=START), device("new", replaced_device_id="old", first_seen_at=START),
        device("late", replaced_device_id="old", first_seen_at=END), device("lost", replaced_device_id="gone"),
    ]
    df = dataset(spark, devices=devices)["devices"].withColumns(
        {"first_seen_us": F.unix_micros("first_seen_at"), "retired_us": F.unix_micros("retired_at")}
    )
    assert columns(validate.device_chain_violations(df), "device_id", "rule") == [
        ("late", "retirement_mismatch"), ("lost", "replaced_device_missing"),
    ]


def test_missing_columns_and_leaks(spark):
    df = spark.createDataFrame([(1, True)], "a int, is_fraud boolean")
    assert validate.label_columns_present(df) == ["is_fraud"]
    assert validate.missing_columns(df, ["a", "b"]) == ["b"]
    out = validate.with_missing_columns(df, ["a", "b"])
    assert out.columns == ["a", "is_fraud", "b"] and out.first()["b"] is None


def test_graph_dataset_job(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for name, df in dataset(spark).items():
        ds.write_table(df, name, source)
    checks = lifecycle.build_graph_dataset(spark, source, target, us(START), us(END))
    assert checks.count() == 0
    assert ds.load_dataset(spark, target)["graph_edges"].count() == 3
    (report,) = spark.read.json(f"{target}/manifest").collect()
    assert report["row_counts"]["transactions"] == 5 and report["dataset_version"] == "v1"
    assert lifecycle.split_graph_counts(
        ds.with_event_time(ds.load_dataset(spark, target)["transactions"]), us(START), us(END)
    ).collect()[0]["n_edges"] == 3
    assert set(lifecycle.data_summary(ds.load_dataset(spark, target))) >= {"counts", "quantiles"}


def test_training_rows_hold_all_features(spark):
    tables = dataset(spark, labels=[label("t1", is_fraud=True, attack_id="synthetic_identity_bustout"), label("t2")])
    out = lifecycle.training_rows(tables, us(START), us(END))
    assert set(ALL_FEATURES) <= set(out.columns)
    got = {r["txn_id"]: r for r in out.collect()}
    assert got["t1"]["split"] == "test" and got["t2"]["split"] == "train"
    assert got["t3"]["is_fraud"] is False
    # History only: the second b -> c payment knows one earlier edge payment.
    assert got["t3"]["edge_count"] == 1.0 and got["t2"]["edge_count"] == 0.0
    assert got["t1"]["txn_burstiness"] == -1.0 and got["t1"]["time_since_prev_txn"] == 999999.0
    assert got["t1"]["tx_hour"] == 14  # 09:00 UTC is 14:30 in Kolkata


def test_layer_and_existing_files(spark, tmp_path):
    base = dataset(spark)
    out = ds.layer(base, {"transactions": base["transactions"].limit(1).withColumn("origin", F.lit("attack"))})
    assert out["transactions"].count() == 6 and "origin" in out["transactions"].columns
    assert out["parties"] is base["parties"]
    path = str(tmp_path / "gen3")
    base["labels"].write.parquet(path)
    assert ds.read_existing(spark, [path, str(tmp_path / "gen4")]).count() == 5
    assert ds.read_existing(spark, [str(tmp_path / "gen5")]) is None


def test_zoneless_timestamps_are_read_in_their_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2025-09-15 05:30:00' AS t")
    assert ds.normalise_timestamps(df, "Asia/Kolkata").select(F.unix_micros("t")).first()[0] == us(START)


def test_labels_default_to_clean(spark):
    out = with_labels(spark.createDataFrame([("x",)], "txn_id string"), dataset(spark)["labels"]).first()
    assert out["is_fraud"] is False and out["is_legit_lookalike"] is False and out["attack_id"] is None


def test_side_inputs(spark, tmp_path):
    csv = tmp_path / "ext.csv"
    csv.write_text(
        "step,TransactionAmt,D1,dist1,DeviceType,category,oldbalanceOrg,newbalanceOrig,ProductCD\n"
        "25,10.5,3,49,mobile,food,100,80,W\n170,2,,51,,gas,5,9,C\n1,1,1,,,,1,1,W\n"
    )
    out = si.map_external(si.read_external_csv(spark, str(csv)))
    got = sorted((r["tx_hour"], r["tx_dayofweek"], r["amount"], r["geo_matches_billing"], r["device_is_known_for_payer"], r["mcc"], r["amount_deviation"]) for r in out.collect())
    assert got == [(1, 0, 1.0, None, False, None, 0.0), (1, 1, 10.5, True, True, 0, -20.0), (2, 0, 2.0, False, False, 1, 4.0)]

    log = tmp_path / "usage.log"
    log.write_text("2026-03-02T10:00:00|0.005\nbroken\n2026-03-02T11:00:00|x\n2026-03-03T11:00:00.123|0.9\n")
    assert si.read_usage_log(spark, str(log)).count() == 2

    report = tmp_path / "report.json"
    report.write_text('{"by_family": [{"family": "f", "n": 2}],\n "by_intensity": [{"family": "f", "LOW": 0.5}, {"family": "g", "LOW": null}]}')
    fam, inten = si.read_battery_report(spark, str(report))
    assert fam.first()["n"] == 2 and inten.count() == 2

    events = spark.createDataFrame([("a", "PAYPAL"), ("b", "app")], "txn_id string, channel string")
    for _ in range(2):
        si.append_channel_events(events, str(tmp_path / "events"))
    assert spark.read.json(str(tmp_path / "events")).count() == 2
    for batch in ("b1", "b1", "b2"):
        si.append_channel_events(events, str(tmp_path / "events"), batch=batch)
    assert spark.read.json(str(tmp_path / "events")).count() == 4

    store = str(tmp_path / "verdicts")
    verdict = spark.createDataFrame(
        [("t1", us(START), "FRAUD", 0.9, "why", ["x"], ["p"])],
        "transaction_id string, ts_us long, analyst_verdict string, analyst_confidence double, analyst_reasoning string, key_signals array<string>, patterns array<string>",
    )
    si.append_verdicts(verdict, store)
    si.append_verdicts(verdict.withColumn("ts_us", F.lit(us(END))), store)
    both = verdict.unionByName(verdict.withColumn("ts_us", F.lit(us(END))))
    for _ in range(2):
        si.append_verdicts(both, f"{store}_named", "morning")
    assert si.read_verdicts(spark, f"{store}_named").groupBy("batch_id").count().collect() == [("morning", 2)]
    back = si.read_verdicts(spark, store)
    assert back.count() == 2 and back.filter(F.col("verdict_date") == "2025-09-15").count() == 1


def test_window_filter_reaches_the_scan(spark, tmp_path):
    folder = str(tmp_path / "data")
    ds.write_table(dataset(spark)["transactions"], "transactions", folder)
    stored = ds.with_event_time(spark.read.schema(TRANSACTIONS).parquet(f"{folder}/transactions.parquet"))
    edges = graph_edges(stored, us(START), us(START) + 14_400_000_000)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThan(timestamp" in plan
    assert "rail" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert edges.count() == 1
