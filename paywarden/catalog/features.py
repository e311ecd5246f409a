"""Feature and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paywarden.catalog.registry import query, r, sr
from paywarden.operators import features as feat
from paywarden.operators.graph import graph_edges, in_window
from paywarden.operators.splits import assign_split, split_windows
from paywarden.sources.adapter import DAY_US, END_US, HOUR_US, START_US

H, D = HOUR_US, 24 * HOUR_US

EDGES_SQL = """
SELECT payer_id, payee_id, count(*) AS edge_count, sum(amount) AS edge_value_total,
  CASE WHEN count(*) > 1 THEN (max(ts_us) - min(ts_us)) / 1e6 / (count(*) - 1) ELSE 0 END AS gap,
  bool_or(EXISTS (SELECT 1 FROM {rel} q WHERE q.payer_id = p.payee_id AND q.ts_us > p.ts_us
    AND q.ts_us <= p.ts_us + 86400000000 AND q.payee_id <> p.payer_id {same})) AS two_hop {extra}
FROM {rel} p GROUP BY payer_id, payee_id {extra}
"""
EDGES = EDGES_SQL.format(rel="payments", same="", extra="")
DEGREES = """SELECT *, count(*) OVER (PARTITION BY payer_id) AS out_degree,
 count(*) OVER (PARTITION BY payee_id) AS in_degree FROM edges0"""


@query(
    "graph_edges",
    "D-1 D-2 D-3 C-8",
    f"""SELECT payer_id AS src_party_id, payee_id AS dst_party_id, edge_count,
    edge_value_total, {sr('gap', 3)} AS mean_inter_arrival_s, out_degree AS src_out_degree,
    in_degree AS dst_in_degree, two_hop AS is_two_hop_passthrough FROM edges1""",
    edges0=EDGES,
    edges1=DEGREES,
)
def _graph_edges(t):
    return graph_edges(t.payments, START_US, END_US).select(
        "src_party_id",
        "dst_party_id",
        "edge_count",
        "edge_value_total",
        r("mean_inter_arrival_s", 3).alias("mean_inter_arrival_s"),
        "src_out_degree",
        "dst_in_degree",
        "is_two_hop_passthrough",
    )


SPLIT_CASE = f"""CASE WHEN ts_us >= {START_US} AND ts_us < {START_US + 18 * DAY_US} THEN 'train'
 WHEN ts_us >= {START_US} AND ts_us < {START_US + 24 * DAY_US} THEN 'validation'
 WHEN ts_us >= {START_US} AND ts_us < {END_US} THEN 'test' END"""


@query(
    "graph_edges_per_split",
    "D-4",
    f"""SELECT split, count(*) AS n_edges, sum(edge_value_total) AS value_total,
    max(out_degree) AS max_out_degree, max(in_degree) AS max_in_degree,
    sum(CASE WHEN two_hop THEN 1 ELSE 0 END) AS n_two_hop FROM edges1 GROUP BY split""",
    splitpay=f"SELECT *, {SPLIT_CASE} AS split FROM payments",
    edges0=EDGES_SQL.format(rel="splitpay", same="AND q.split = p.split", extra=", split"),
    edges1="""SELECT *, count(*) OVER (PARTITION BY split, payer_id) AS out_degree,
 count(*) OVER (PARTITION BY split, payee_id) AS in_degree FROM edges0""",
)
def _split_edges(t):
    rows = t.payments.withColumn("split", assign_split("ts_us", split_windows(START_US, END_US)))
    return (
        graph_edges(rows, by=["split"])
        .groupBy("split")
        .agg(
            F.count("*").alias("n_edges"),
            F.sum("edge_value_total").alias("value_total"),
            F.max("src_out_degree").alias("max_out_degree"),
            F.max("dst_in_degree").alias("max_in_degree"),
            F.sum(F.col("is_two_hop_passthrough").cast("int")).alias("n_two_hop"),
        )
    )


@query(
    "half_open_window",
    "B-4",
    f"""SELECT txn_id, ts_us, amount FROM payments
    WHERE ts_us >= {START_US + 5 * DAY_US} AND ts_us < {START_US + 9 * DAY_US}""",
)
def _half_open(t):
    return in_window(t.payments, START_US + 5 * DAY_US, START_US + 9 * DAY_US).select("txn_id", "ts_us", "amount")


@query(
    "calendar_features",
    "B-1 B-2",
    """SELECT txn_id, hour(make_timestamp(ts_us)) AS tx_hour, (dayofweek(make_timestamp(ts_us)) + 6) % 7 AS tx_dayofweek,
    cast(amount as double) AS amount_double FROM payments""",
)
def _calendar(t):
    return feat.calendar_features(t.payments).select(
        "txn_id", "tx_hour", "tx_dayofweek", F.col("amount").cast("double").alias("amount_double")
    )


@query(
    "calendar_features_ist",
    "A-2",
    """SELECT txn_id, hour(make_timestamp(ts_us + 19800000000)) AS tx_hour,
    (dayofweek(make_timestamp(ts_us + 19800000000)) + 6) % 7 AS tx_dayofweek FROM payments""",
)
def _calendar_ist(t):
    return feat.calendar_features(t.payments, "Asia/Kolkata").select("txn_id", "tx_hour", "tx_dayofweek")


# Event times are unique in the driver's tables, so "earlier rows" is a range
# that stops one microsecond before the row; ties are covered by unit tests.
def _rng(key: str, width: int) -> str:
    return f"(PARTITION BY {key} ORDER BY ts_us RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING)"


def _velocity(t):
    return feat.payer_velocity(t.payments.select(*feat.VELOCITY_INPUT))


@query(
    "velocity_counts",
    "E-1",
    f"""SELECT txn_id, cast(count(*) OVER {_rng('payer_id', H)} as double) AS txn_count_last_1h,
    cast(count(*) OVER {_rng('payer_id', D)} as double) AS txn_count_last_24h FROM payments""",
)
def _velocity_counts(t):
    return _velocity(t).select("txn_id", "txn_count_last_1h", "txn_count_last_24h")


@query(
    "velocity_amounts",
    "E-2",
    f"""SELECT txn_id, coalesce(sum(cents) OVER {_rng('payer_id', H)}, 0) / 100e0 AS amount_spent_last_1h,
    coalesce(sum(cents) OVER {_rng('payer_id', D)}, 0) / 100e0 AS amount_spent_last_24h FROM payments""",
)
def _velocity_amounts(t):
    return _velocity(t).select("txn_id", "amount_spent_last_1h", "amount_spent_last_24h")


@query(
    "velocity_distincts",
    "E-3",
    "SELECT txn_id, "
    + ", ".join(
        f"cast(count(DISTINCT nullif({c}, '')) OVER {_rng('payer_id', w)} as double) AS {n}_{s}"
        for n, c in (("distinct_tpap_count", "tpap_app"), ("distinct_linked_account_count", "linked_account_id"))
        for s, w in (("last_1h", H), ("last_24h", D))
    )
    + " FROM payments",
)
def _velocity_distincts(t):
    return _velocity(t).select(
        "txn_id",
        *[f"{n}_{s}" for n in ("distinct_tpap_count", "distinct_linked_account_count") for s in feat.WINDOWS],
    )


def _payee(t):
    return feat.payee_velocity(t.payments.select("txn_id", "payer_id", "payee_id", "ts_us"))


@query(
    "payee_fan_in",
    "E-4",
    f"""SELECT txn_id, cast(count(DISTINCT payer_id) OVER {_rng('payee_id', H)} as double) AS payee_distinct_payer_count_last_1h,
    cast(count(DISTINCT payer_id) OVER {_rng('payee_id', D)} as double) AS payee_distinct_payer_count_last_24h FROM payments""",
)
def _payee_fan_in(t):
    return _payee(t).select("txn_id", *[f"payee_distinct_payer_count_{s}" for s in feat.WINDOWS])


@query(
    "payee_counts",
    "E-5",
    f"""SELECT txn_id, cast(count(*) OVER {_rng('payee_id', H)} as double) AS payee_txn_count_last_1h,
    cast(count(*) OVER {_rng('payee_id', D)} as double) AS payee_txn_count_last_24h FROM payments""",
)
def _payee_counts(t):
    return _payee(t).select("txn_id", *[f"payee_txn_count_{s}" for s in feat.WINDOWS])


_W = "(PARTITION BY payer_id ORDER BY ts_us, txn_id"
PREV = f"{_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
INCL = f"{_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

HIST0 = f"""SELECT *, cast(amount as double) AS amt,
 make_timestamp(ts_us) AS t,
 (ts_us - lag(ts_us) OVER {_W})) / 1e6 AS gap,
 row_number() OVER (PARTITION BY payer_id, payee_id ORDER BY ts_us, txn_id) AS rn_payee,
 row_number() OVER (PARTITION BY payer_id, device_id ORDER BY ts_us, txn_id) AS rn_device,
 row_number() OVER (PARTITION BY payer_id, ip_asn ORDER BY ts_us, txn_id) AS rn_ip,
 row_number() OVER (PARTITION BY payer_id, is_agent_initiated ORDER BY ts_us, txn_id) AS rn_agent,
 CASE WHEN is_agent_initiated THEN (ts_us - lag(ts_us) OVER (PARTITION BY payer_id, is_agent_initiated ORDER BY ts_us, txn_id)) / 1e6 END AS agap,
 count(*) OVER {INCL} AS n, count(*) OVER {PREV} AS n_prev, sum(cents) OVER {INCL} / 100e0 AS total
 FROM payments"""
HIST = f"""SELECT *,
 row_number() OVER (PARTITION BY payer_id, cast(t as date) ORDER BY ts_us, txn_id) AS rn_day,
 row_number() OVER (PARTITION BY payer_id, hour(t) ORDER BY ts_us, txn_id) AS rn_hour,
 coalesce(avg(gap) OVER {INCL}, 999999) AS g_mean, coalesce(stddev_pop(gap) OVER {INCL}, 0) AS g_std,
 avg(agap) OVER {INCL} AS a_mean, stddev_pop(agap) OVER {INCL} AS a_std FROM hist0"""

HISTORY_SQL = {
    "prior_average": ("E-6", {"historical_average_amount": (f"CASE WHEN n_prev > 0 THEN (sum(cents) OVER {PREV}) / 100e0 / n_prev ELSE 0 END", 6)}),
    "amount_deviation": ("E-7", {"amount_deviation": (f"CASE WHEN n_prev > 0 THEN abs(amt - (sum(cents) OVER {PREV}) / 100e0 / n_prev) ELSE 0 END", 6)}),
    "time_since_previous": ("E-8", {"time_since_prev_txn": ("coalesce(gap, 999999)", 6)}),
    "first_seen_flags": (
        "E-9",
        {
            "new_merchant_indicator": ("CASE WHEN rn_payee = 1 THEN 1 ELSE 0 END", 6),
            "new_device_indicator": ("CASE WHEN rn_device = 1 THEN 1 ELSE 0 END", 6),
            "new_ip_indicator": ("CASE WHEN rn_ip = 1 THEN 1 ELSE 0 END", 6),
        },
    ),
    "gap_statistics": (
        "E-10",
        {
            "inter_txn_time_mean": ("g_mean", 3),
            "inter_txn_time_std": ("g_std", 3),
            "inter_txn_time_min": (f"coalesce(min(gap) OVER {INCL}, 999999)", 6),
            "inter_txn_time_max": (f"coalesce(max(gap) OVER {INCL}, 999999)", 6),
        },
    ),
    "burstiness": ("E-11", {"txn_burstiness": ("CASE WHEN g_std + g_mean > 0 THEN (g_std - g_mean) / (g_std + g_mean) ELSE 0 END", 6)}),
    "regularity": ("E-12", {"txn_regularity": ("CASE WHEN g_mean > 0 THEN g_std / g_mean ELSE 0 END", 6)}),
    "active_days_hours": (
        "E-13",
        {
            "active_days_count": (f"sum(CASE WHEN rn_day = 1 THEN 1 ELSE 0 END) OVER {INCL}", 6),
            "active_hours_count": (f"sum(CASE WHEN rn_hour = 1 THEN 1 ELSE 0 END) OVER {INCL}", 6),
        },
    ),
    "per_active_day": ("E-14", {"txns_per_active_day": (f"cast(n as double) / sum(CASE WHEN rn_day = 1 THEN 1 ELSE 0 END) OVER {INCL}", 6)}),
    "amount_spread": (
        "E-15",
        {
            "amount_std": (f"stddev_pop(amt) OVER {INCL}", 4),
            "amount_cv": (f"CASE WHEN avg(amt) OVER {INCL} > 0 THEN stddev_pop(amt) OVER {INCL} / avg(amt) OVER {INCL} ELSE 0 END", 6),
        },
    ),
    "threshold_ratios": (
        "E-16",
        {
            "subthreshold_txn_ratio": (f"avg(CASE WHEN amt < 100 THEN 1e0 ELSE 0e0 END) OVER {INCL}", 6),
            "aggregate_to_threshold_ratio": ("total / 10000e0", 6),
        },
    ),
    "amount_concentration": ("E-17", {"amount_concentration": (f"CASE WHEN total > 0 THEN sum(amt * amt) OVER {INCL} / (total * total) ELSE 1 END", 6)}),
    "payee_diversity": (
        "E-18",
        {
            "unique_payee_count": (f"sum(CASE WHEN rn_payee = 1 THEN 1 ELSE 0 END) OVER {INCL}", 6),
            "merchant_diversity": (f"cast(sum(CASE WHEN rn_payee = 1 THEN 1 ELSE 0 END) OVER {INCL} as double) / n", 6),
        },
    ),
    "same_payee_ratio": ("E-19", {"same_payee_ratio": (f"cast(max(rn_payee) OVER {INCL} as double) / n", 6)}),
    "merchant_ratio": ("E-20", {"merchant_txn_ratio": (f"cast(count(payee_id) OVER {INCL} as double) / n", 6)}),
    "share_ratios": (
        "E-21",
        {
            "beneficiary_reuse_ratio": (f"avg(CASE WHEN beneficiary_first_time THEN 0e0 ELSE 1e0 END) OVER {INCL}", 6),
            "mandate_txn_ratio": (f"avg(CASE WHEN rail = 'upi_mandate' THEN 1e0 ELSE 0e0 END) OVER {INCL}", 6),
            "agent_txn_ratio": (f"avg(CASE WHEN is_agent_initiated THEN 1e0 ELSE 0e0 END) OVER {INCL}", 6),
        },
    ),
    "beneficiary_age": (
        "E-22",
        {
            "mean_beneficiary_added_ago": (f"cast(sum(beneficiary_added_ago_s) OVER {INCL} as double) / n", 3),
            "max_beneficiary_added_ago": (f"max(beneficiary_added_ago_s) OVER {INCL}", 6),
        },
    ),
    "agent_burstiness": ("E-23", {"agent_txn_burstiness": ("CASE WHEN a_mean IS NOT NULL AND a_std + a_mean > 0 THEN (a_std - a_mean) / (a_std + a_mean) ELSE 0 END", 6)}),
    "since_previous_agent": (
        "E-24",
        {"time_since_prev_agent_txn": (f"coalesce((ts_us - max(CASE WHEN is_agent_initiated THEN ts_us END) OVER {PREV}) / 1e6, 999999)", 6)},
    ),
}


def _register_history(name, covers, columns):
    body = "SELECT txn_id, " + ", ".join(f"{sr(f'({sql})', d)} AS {c}" for c, (sql, d) in columns.items()) + " FROM hist"

    @query(name, covers, body, hist0=HIST0, hist=HIST)
    def _run(t):
        out = feat.payer_history(t.payments.select(*feat.HISTORY_INPUT))
        return out.select("txn_id", *[r(c, d).alias(c) for c, (_, d) in columns.items()])


for _name, (_covers, _columns) in HISTORY_SQL.items():
    _register_history(_name, _covers, _columns)


@query(
    "merchant_share",
    "E-20",
    f"""SELECT txn_id, {sr(f"cast(count(merchant_id) OVER {INCL} as double) / count(*) OVER {INCL}")} AS merchant_txn_ratio FROM payments""",
)
def _merchant_share(t):
    out = feat.payer_history(t.payments.select(*feat.HISTORY_INPUT), merchant_column="merchant_id")
    return out.select("txn_id", r("merchant_txn_ratio").alias("merchant_txn_ratio"))


_ALL43 = {c: v for _, (_, cols) in HISTORY_SQL.items() for c, v in cols.items()}
_WINDOWED = {
    **{f"txn_count_{s}": f"count(*) OVER {_rng('payer_id', w)}" for s, w in (("last_1h", H), ("last_24h", D))},
    **{f"amount_spent_{s}": f"coalesce(sum(cents) OVER {_rng('payer_id', w)}, 0) / 100e0" for s, w in (("last_1h", H), ("last_24h", D))},
    **{f"distinct_tpap_count_{s}": f"count(DISTINCT nullif(tpap_app, '')) OVER {_rng('payer_id', w)}" for s, w in (("last_1h", H), ("last_24h", D))},
    **{f"distinct_linked_account_count_{s}": f"count(DISTINCT linked_account_id) OVER {_rng('payer_id', w)}" for s, w in (("last_1h", H), ("last_24h", D))},
    **{f"payee_distinct_payer_count_{s}": f"count(DISTINCT payer_id) OVER {_rng('payee_id', w)}" for s, w in (("last_1h", H), ("last_24h", D))},
    **{f"payee_txn_count_{s}": f"count(*) OVER {_rng('payee_id', w)}" for s, w in (("last_1h", H), ("last_24h", D))},
}


_FEATURE_SQL = (
    "SELECT txn_id, "
    + ", ".join(f"{sr(f'({sql})')} AS {c}" for c, sql in _WINDOWED.items())
    + ", "
    + ", ".join(f"{sr(f'({sql})', d)} AS {c}" for c, (sql, d) in _ALL43.items())
    + " FROM hist"
)
_FEATURES = "E-1 E-2 E-3 E-4 E-5 E-6 E-7 E-8 E-9 E-10 E-11 E-12 E-13 E-14 E-15 E-16 E-17 E-18 E-19 E-20 E-21 E-22 E-23 E-24"


def _all_features(t, **more):
    wanted = dict.fromkeys((*feat.HISTORY_INPUT, *feat.VELOCITY_INPUT))
    out = feat.behavioural_features(t.payments.select(*wanted), **more)
    return out.select(
        "txn_id",
        *[r(c).alias(c) for c in _WINDOWED],
        *[r(c, d).alias(c) for c, (_, d) in _ALL43.items()],
    )


@query("behavioural_features", _FEATURES, _FEATURE_SQL, hist0=HIST0, hist=HIST)
def _behavioural(t):
    return _all_features(t)


@query("behavioural_features_in_ranges", _FEATURES + " F-1", _FEATURE_SQL, hist0=HIST0, hist=HIST)
def _in_ranges(t):
    """Payers and payees of more than 80 payments are cut into ranges."""
    return _all_features(t, max_rows=80)


@query(
    "account_age",
    "C-1",
    "SELECT txn_id, account_age_days FROM payments p LEFT JOIN parties q ON p.payer_id = q.party_id",
)
def _account_age(t):
    return feat.with_account_age(t.payments.select("txn_id", "payer_id"), t.parties).select("txn_id", "account_age_days")


_GRAPH_COLUMNS = ["payer_out_degree", "payee_in_degree", "edge_count", "edge_value_total", "is_two_hop_passthrough"]


@query(
    "graph_features_full",
    "E-26 C-2 C-3",
    f"""SELECT txn_id, cast(coalesce(o.d, 0) as double) AS payer_out_degree, cast(coalesce(i.d, 0) as double) AS payee_in_degree,
    cast(coalesce(e.edge_count, 0) as double) AS edge_count, cast(coalesce(e.edge_value_total, 0) as double) AS edge_value_total,
    CASE WHEN e.two_hop THEN 1e0 ELSE 0e0 END AS is_two_hop_passthrough
    FROM payments p LEFT JOIN edges1 e ON p.payer_id = e.payer_id AND p.payee_id = e.payee_id
    LEFT JOIN (SELECT payer_id, max(out_degree) AS d FROM edges1 GROUP BY payer_id) o ON o.payer_id = p.payer_id
    LEFT JOIN (SELECT payee_id, max(in_degree) AS d FROM edges1 GROUP BY payee_id) i ON i.payee_id = p.payee_id""",
    edges0=EDGES_SQL.format(rel="payments", same="", extra=""),
    edges1=DEGREES,
)
def _graph_full(t):
    edges = graph_edges(t.payments)
    return feat.with_graph_features(t.payments.select("txn_id", "payer_id", "payee_id"), edges).select(
        "txn_id", *_GRAPH_COLUMNS
    )


@query(
    "graph_features_asof",
    "E-27",
    """SELECT txn_id,
    cast(coalesce(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY payer_id ORDER BY ts_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) as double) AS payer_out_degree,
    cast(coalesce(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY payee_id ORDER BY ts_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) as double) AS payee_in_degree,
    cast(rn - 1 as double) AS edge_count,
    coalesce(sum(cents) OVER (PARTITION BY payer_id, payee_id ORDER BY ts_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100e0 AS edge_value_total,
    CASE WHEN EXISTS (SELECT 1 FROM payments a JOIN payments b ON b.payer_id = a.payee_id AND b.ts_us > a.ts_us
      AND b.ts_us <= a.ts_us + 86400000000 AND b.payee_id <> a.payer_id
      WHERE a.payer_id = o.payer_id AND a.payee_id = o.payee_id AND b.ts_us < o.ts_us) THEN 1e0 ELSE 0e0 END AS is_two_hop_passthrough
    FROM ordered o""",
    ordered="SELECT *, row_number() OVER (PARTITION BY payer_id, payee_id ORDER BY ts_us) AS rn FROM payments",
)
def _graph_asof(t):
    slim = t.payments.select("txn_id", "payer_id", "payee_id", "ts_us", "amount", "cents")
    return feat.asof_graph_features(slim).select("txn_id", *_GRAPH_COLUMNS)


@query(
    "label_join",
    "C-4",
    """SELECT p.txn_id, coalesce(is_fraud, false) AS is_fraud, coalesce(is_legit_lookalike, false) AS is_legit_lookalike,
    attack_id, campaign_id FROM payments p LEFT JOIN labelrows l ON p.txn_id = l.txn_id""",
)
def _label_join(t):
    return feat.with_labels(t.payments.select("txn_id"), t.labels).select(
        "txn_id", "is_fraud", "is_legit_lookalike", "attack_id", "campaign_id"
    )
