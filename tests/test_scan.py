"""Scans and trailing windows against plain loops, on both sides of the hot-key limit."""

import random

import pytest
from pyspark.sql import functions as F

from paywarden.catalog import detectors as cards
from paywarden.operators import detectors, scan
from paywarden.operators import features as feat
from paywarden.operators.graph import graph_edges
from paywarden.operators.quantiles import bracketed_quantiles, exact_quantiles, percent_rank_average
from paywarden.operators.scan import Metric, find_hot_keys, prefix_scan, sliding
from paywarden.sources.adapter import DriverTables

H = 3_600_000_000
SCHEMA = "txn_id string, payer_id string, payee_id string, ts_us long, cents long, app string"


def make_rows(n=240, seed=3):
    """Few keys, one of them holding most rows, whole-hour times so that ties are common."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        payer = "P0" if rnd.random() < 0.6 else f"P{rnd.randrange(1, 5)}"
        payee = rnd.choice(["P0", "P1", "P2", "P7", "P8"])
        app = rnd.choice(["a", "b", "c", "", None])
        rows.append((f"T{i:04d}", payer, payee, rnd.randrange(0, 120) * H, rnd.randrange(1, 50_000), app))
    return rows


def earlier(rows, row, key, width):
    return [
        r
        for r in rows
        if r[key] == row[key] and (r[3], r[0]) < (row[3], row[0]) and r[3] >= row[3] - width
    ]


@pytest.mark.parametrize("max_rows", [10**9, 20])
def test_sliding_matches_loops(spark, max_rows):
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    hot = find_hot_keys(df, ["payer_id"], "ts_us", max_rows)
    assert (hot is None) == (max_rows > 1000)
    out = sliding(
        df, ["payer_id"], "ts_us", "txn_id", {"1h": H, "24h": 24 * H},
        sums={"spent": "cents"}, distincts={"apps": "app"}, hot=hot,
    )
    got = {r["txn_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for row in rows:
        for suffix, width in (("1h", H), ("24h", 24 * H)):
            past = earlier(rows, row, 1, width)
            g = got[row[0]]
            assert g[f"count_{suffix}"] == len(past)
            assert g[f"spent_{suffix}"] == sum(p[4] for p in past)
            assert g[f"apps_{suffix}"] == len({p[5] for p in past if p[5]})


@pytest.mark.parametrize("max_rows", [10**9, 20])
def test_sliding_including_current_row(spark, max_rows):
    rows = make_rows(seed=9)
    df = spark.createDataFrame(rows, SCHEMA)
    hot = find_hot_keys(df, ["payee_id"], "ts_us", max_rows)
    out = sliding(
        df, ["payee_id"], "ts_us", "txn_id", {"w": 5 * H}, distincts={"payers": "payer_id"},
        include_current=True, hot=hot,
    )
    got = {r["txn_id"]: r for r in out.collect()}
    for row in rows:
        past = earlier(rows, row, 2, 5 * H) + [row]
        assert got[row[0]]["count_w"] == len(past)
        assert got[row[0]]["payers_w"] == len({p[1] for p in past})


@pytest.mark.parametrize("reverse", [False, True])
def test_hot_and_plain_scans_agree(spark, reverse):
    df = spark.createDataFrame(make_rows(seed=5), SCHEMA)
    metrics = {
        "s": Metric("sum", F.col("cents")),
        "mx": Metric("max", F.col("cents"), True),
        "mn": Metric("min", F.col("cents")),
        "b": Metric("bit_or", F.expr("shiftleft(1, cast(cents % 30 as int))"), True),
        "l": Metric("last", F.when(F.col("app") != "", F.col("app"))),
        "m": Metric("moments", F.col("cents").cast("double"), True),
    }
    hot = find_hot_keys(df, ["payer_id"], "ts_us", 15)
    assert hot is not None
    for within in ((), ("app",)):
        plain = prefix_scan(df, ["payer_id"], ["ts_us", "txn_id"], metrics, None, within, reverse)
        cut = prefix_scan(df, ["payer_id"], ["ts_us", "txn_id"], metrics, hot, within, reverse)
        a = {r["txn_id"]: r.asDict() for r in plain.collect()}
        b = {r["txn_id"]: r.asDict() for r in cut.collect()}
        assert a.keys() == b.keys()
        for k in a:
            for c, v in a[k].items():
                assert (b[k][c] == pytest.approx(v, rel=1e-9, abs=1e-6)) if isinstance(v, float) else (b[k][c] == v), (k, c)


def test_global_scan_is_chunked(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "id long, v long")
    hot = find_hot_keys(df, [], "v", 10)
    out = prefix_scan(df, [], ["v"], {"below": Metric("sum", F.lit(1))}, hot).collect()
    assert all(r["below"] == r["v"] for r in out)


def full_payments(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select(
        "txn_id", "payer_id", "payee_id", "ts_us", "cents",
        (F.col("cents") / 100).cast("decimal(12,2)").alias("amount"),
        F.when(F.col("cents") % 3 == 0, F.col("payee_id")).alias("merchant_id"),
        F.concat(F.lit("D"), F.col("cents") % 4).alias("device_id"),
        F.concat(F.lit("AS"), F.col("cents") % 3).alias("ip_asn"),
        F.when(F.col("cents") % 5 == 0, "upi_mandate").otherwise("imps").alias("rail"),
        (F.col("cents") % 3 == 1).alias("is_agent_initiated"),
        (F.col("cents") % 2 == 0).alias("beneficiary_first_time"),
        (F.col("cents") * 7).alias("beneficiary_added_ago_s"),
        F.col("app").alias("tpap_app"),
        F.concat(F.lit("L"), F.col("cents") % 6).alias("linked_account_id"),
    )


def test_all_features_agree_under_skew(spark):
    """The 43 features are the same when the big payer and payee are cut into chunks."""
    df = full_payments(spark, make_rows(n=150, seed=11))
    plain = {r["txn_id"]: r.asDict() for r in feat.behavioural_features(df).collect()}
    cut = {r["txn_id"]: r.asDict() for r in feat.behavioural_features(df, max_rows=25).collect()}
    assert plain.keys() == cut.keys() and len(plain) == 150
    for k, row in plain.items():
        for c, v in row.items():
            if isinstance(v, float):
                assert cut[k][c] == pytest.approx(v, rel=1e-9, abs=1e-6), (k, c)
            else:
                assert cut[k][c] == v, (k, c)


@pytest.mark.parametrize("name", ["payee_velocity", "payer_velocity", "payer_history", "behavioural_features", "asof_graph_features"])
def test_tasks_of_features_follow_the_rows(spark, monkeypatch, name):
    """More rows make more tasks, not larger ones, whatever the session's shuffle partitions."""
    rows = [(f"T{i:04d}", f"P{i % 60}", f"Q{i % 48}", i * H, i + 1, "a") for i in range(240)]
    df = full_payments(spark, rows)
    want = sorted(map(str, getattr(feat, name)(df).collect()))
    monkeypatch.setattr(scan, "ROWS_PER_SPREAD_TASK", 10, raising=False)
    out = getattr(feat, name)(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < 24
    # One exchange a key, on the payee and on the payer.
    assert plan.count("RepartitionByExpression") >= 1 and plan.count(", 24") >= plan.count("RepartitionByExpression")
    if name != "asof_graph_features":  # its last join has an exchange of its own
        parts = out.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 12 and max(r["count"] for r in parts) <= 60
    assert sorted(map(str, out.collect())) == want


def test_keys_beside_hot_ones_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS_PER_SPREAD_TASK", 20, raising=False)
    df = spark.range(400).select(F.when(F.col("id") < 100, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    tasks, hot = scan.count_keys(df, ["k"], "id", 50)
    assert tasks == 20 and hot.table.count() == 1 and hot.rows == 100
    cold, _ = hot.lanes(df, ["id"])
    assert cold.rdd.getNumPartitions() == 20 and cold.count() == 300
    assert scan.count_keys(df, ["k"], "id", 100) == (20, None)
    assert scan.count_keys(df.limit(0), ["k"], "id", 100)[1] is None


@pytest.mark.parametrize("max_rows", [10**9, 30])
def test_passthrough_matches_loops(spark, max_rows):
    rows = make_rows(seed=21)
    out = graph_edges(full_payments(spark, rows), max_rows=max_rows).collect()
    got = {(r["src_party_id"], r["dst_party_id"]): r for r in out}
    for (src, dst), edge in got.items():
        mine = [r for r in rows if r[1] == src and r[2] == dst]
        assert edge["edge_count"] == len(mine)
        want = any(
            q[1] == dst and r[3] < q[3] <= r[3] + 24 * H and q[2] != src for r in mine for q in rows
        )
        assert edge["is_two_hop_passthrough"] == want, (src, dst)
        assert edge["src_out_degree"] == len({r[2] for r in rows if r[1] == src})
        assert edge["dst_in_degree"] == len({r[1] for r in rows if r[2] == dst})


@pytest.mark.parametrize("max_rows", [10**9, 8])
def test_quantiles_match_sorted_lists(spark, max_rows):
    rows = [(f"k{i % 3}", float((i * 7919) % 53)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p05": 0.05, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    for rule in ("lower", "linear"):
        for r in exact_quantiles(df, ["k"], "v", probs, rule, max_rows).collect():
            vals = sorted(v for k, v in rows if k == r["k"])
            for name, p in probs.items():
                h = (len(vals) - 1) * p
                lo = vals[int(h)]
                want = lo if rule == "lower" else lo + (h - int(h)) * (vals[min(int(h) + 1, len(vals) - 1)] - lo)
                assert r[name] == pytest.approx(want)


def test_bracketed_quantiles_are_exact(spark):
    rng = random.Random(1)
    rows = [
        (k, rng.gauss(0, 1), None if i % 3 else float(rng.randrange(4)), 5.0 if i % 2 else rng.random(), None)
        for k, n in (("a", 6000), ("b", 700), (None, 11)) for i in range(n)
    ]
    df = spark.createDataFrame(rows, "k string, x double, ties double, half double, none double")
    probs = {"lo": 0.05, "mid": 0.5, "hi": 0.95, "min": 0.0, "max": 1.0}
    names = ["x", "ties", "half", "none"]
    out = bracketed_quantiles(df.repartition(7), ["k"], names, probs, accuracy=100, max_rows=40).collect()
    assert len(out) == 9
    for r in out:
        vals = sorted(v for row in rows if row[0] == r["k"] and (v := row[1 + names.index(r["feature"])]) is not None)
        assert r["n_values"] == len(vals)
        for name, p in probs.items():
            h = (len(vals) - 1) * p
            lo, hi = vals[int(h)], vals[min(int(h) + 1, len(vals) - 1)]
            assert r[name] == pytest.approx(lo + (h - int(h)) * (hi - lo))


def test_percent_rank_average_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", None), ("b", 5.0)], "k string, v double")
    got = sorted((r["k"], r["v"] or -1, r["p"]) for r in percent_rank_average(df, ["k"], "v", "p").collect())
    assert got == [("a", -1, None), ("a", 1.0, 0.5), ("a", 1.0, 0.5), ("a", 2.0, 1.0), ("b", 5.0, 1.0)]


def test_null_keys_can_be_hot(spark):
    rows = [(f"T{i:03d}", None if i % 2 else "a", i // 3) for i in range(80)]
    df = spark.createDataFrame(rows, "txn_id string, k string, ts_us long")
    hot = find_hot_keys(df, ["k"], "ts_us", 10)
    assert hot.table.count() == 2
    out = prefix_scan(df, ["k"], ["ts_us", "txn_id"], {"n": Metric("sum", F.lit(1))}, hot).collect()
    for k in (None, "a"):
        assert sorted(r["n"] for r in out if r["k"] == k) == list(range(40))


def test_session_windows_under_skew(spark):
    from paywarden.operators.sessions import session_windows
    from paywarden.streaming.jobs import session_summary

    df = spark.createDataFrame(make_rows(seed=8), SCHEMA).select(
        "txn_id", "ts_us", F.col("payer_id").alias("session_id"), (F.col("cents") / 100).cast("decimal(12,2)").alias("amount"),
        F.lit(True).alias("call_active_during_txn"), F.lit(False).alias("screen_share_active"), F.lit(1).alias("pin_attempts"),
    )
    # Whole-hour times never sit exactly on this gap.
    want = sorted(map(tuple, session_summary(df, "90 minutes").collect()))
    for max_rows in (10**9, 20):
        assert sorted(map(tuple, session_windows(df, 5_400_000_000, max_rows=max_rows).collect())) == want


def test_top_rows_per_group_are_limited_before_the_shuffle(spark):
    from paywarden.operators.sessions import recent_in_session

    df = spark.createDataFrame([("s", 1, "t")], "session_id string, ts_us long, txn_id string")
    plan = recent_in_session(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_only_hot_rows_are_written(spark, monkeypatch):
    from paywarden.operators import scan

    written = []
    monkeypatch.setattr(scan, "cut_lineage", lambda df: written.append(df) or df)
    df = spark.createDataFrame(make_rows(seed=5), SCHEMA)
    hot = find_hot_keys(df, ["payer_id"], "ts_us", 60)
    sliding(df, ["payer_id"], "ts_us", "txn_id", {"1h": H}, distincts={"apps": "app"}, hot=hot)
    big = {r["payer_id"] for r in hot.table.collect()}
    assert big == {"P0"} and len(written) == 2
    assert all({r["payer_id"] for r in w.select("payer_id").distinct().collect()} == big for w in written)


def test_one_value_of_a_hot_key_is_split(spark):
    rows = [(f"T{i:04d}", "a" if i % 8 else "b", 7) for i in range(800)]
    df = spark.createDataFrame(rows, "txn_id string, k string, ts_us long")
    hot = find_hot_keys(df, ["k"], "ts_us", 120)
    cold, dealt = hot.lanes(df, ["ts_us", "txn_id"])
    assert cold.count() == 100
    sizes = [r["count"] for r in dealt.groupBy("_chunk").count().collect()]
    assert sum(sizes) == 700 and max(sizes) <= 240 and len(sizes) >= 4
    out = prefix_scan(df, ["k"], ["ts_us", "txn_id"], {"n": Metric("sum", F.lit(1))}, hot).collect()
    for k in "ab":
        assert [r["n"] for r in sorted((r for r in out if r["k"] == k), key=lambda r: r["txn_id"])] == list(range(sum(x[1] == k for x in rows)))


def test_moments_of_large_values_do_not_cancel(spark):
    rows = [(i, "a", 1e9 + (i * 37 % 101) / 10) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    metrics = {"m": Metric("moments", F.col("v"), True)}
    plain = {r["id"]: r["m_var"] for r in prefix_scan(df, ["k"], ["id"], metrics).collect()}
    cut = {r["id"]: r["m_var"] for r in prefix_scan(df, ["k"], ["id"], metrics, find_hot_keys(df, ["k"], "id", 40)).collect()}
    assert all(cut[i] == pytest.approx(plain[i], rel=1e-6, abs=1e-6) for i in plain)


def test_census_finds_the_keys_of_every_set_in_one_count(spark):
    rows = [("a", "x")] * 9 + [("b", "a")] * 3 + [("b", "y")] * 3 + [(None, "y")] * 6
    df = spark.createDataFrame(rows, "payer string, payee string")
    census = scan.key_census(df, [["payer"], ["payee"], ["payer", "payee"]], 5, {"party": ["payer", "payee"]})
    got = {k: {tuple(r) for r in h.table.collect()} if h else None for k, h in census.found.items()}
    assert got[("payer", "payee")] == {(None, "y"), ("a", "x")}
    assert got[("payer",)] == {("a",), ("b",), (None,)} and got[("payee",)] == {("x",), ("y",)}
    assert got[("party",)] == {("a",), ("b",), (None,), ("x",), ("y",)}
    assert all(h is None for h in scan.key_census(df, [["payer"], ["payee"]], 9).found.values())


def test_scorecard_counts_hot_keys_once(spark, monkeypatch):
    t = DriverTables(spark, "/root/testdata/sf0.001")

    def never(*args, **kw):
        raise AssertionError("a detector counted its keys itself")

    some = ["mule_network", "adversarial_evasion", "agentic_injection", "device_fan_out"]
    runs = [cards.DETECTORS[name][1] for name in some]
    plain = [sorted(map(tuple, run(t).collect())) for run in runs]
    monkeypatch.setattr(detectors, "find_hot_keys", never)
    sc = spark.sparkContext
    cards._card(t)  # reads the tables' schemas, once
    sc.setJobGroup("census", "one count")
    cards._card(t)
    counted = len(sc.statusTracker().getJobIdsForGroup("census"))
    sc.setJobGroup("alone", "the count alone")
    detectors.payment_census(t.payments)
    alone = len(sc.statusTracker().getJobIdsForGroup("alone"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert counted == alone
    census = detectors.payment_census(t.payments, 8)
    assert census.hot(["payer_id"]) and census.hot(["party"])
    assert plain == [sorted(map(tuple, run(t, census=census).collect())) for run in runs]
