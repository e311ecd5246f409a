"""Validation, split and profile queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.catalog.features import SPLIT_CASE
from paywarden.catalog.registry import query, r, sr
from paywarden.operators import profile, splits, validate
from paywarden.operators.graph import graph_edges
from paywarden.schema import VOCABULARIES
from paywarden.sources.adapter import DAY_US, END_US, START_US

WINDOWS = splits.split_windows(START_US, END_US)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# Tables with closed vocabularies: name, relation of the oracle, key and columns.
CLOSED = (
    ("payments", "payments", "txn_id", ("rail", "channel", "direction", "auth_method", "auth_result", "exemption_claimed", "decision")),
    ("labels", "labelrows", "txn_id", ("detectable_at",)),
    ("parties", "parties", "party_id", ("party_type", "kyc_level")),
    ("devices", "devices", "device_id", ("device_type",)),
    ("merchants", "merchants", "merchant_id", ("volume_growth_curve",)),
)


@query(
    "vocabulary_violations",
    "B-24",
    " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, cast({key} as varchar) AS id, '{c}' AS \"column\", {c} AS value FROM {rel} WHERE {c} NOT IN {_in(VOCABULARIES[c])}"
        for table, rel, key, columns in CLOSED for c in columns
    ),
)
def _vocabulary(t):
    parts = [
        validate.vocabulary_violations(getattr(t, table), key).select(
            F.lit(table).alias("table_name"), F.col(key).cast("string").alias("id"), "column", "value"
        )
        for table, _, key, _ in CLOSED
    ]
    return reduce(DataFrame.unionByName, parts)


_RULES = {
    "non_positive_amount": "amount <= 0",
    "unexpected_currency": "currency <> 'INR'",
    "p2p_with_mcc": "merchant_id IS NULL AND mcc IS NOT NULL",
    "payee_is_not_merchant": "merchant_id IS NOT NULL AND payee_id <> merchant_id",
    "payer_equals_payee": "payer_id = payee_id",
    "pin_without_latency": "auth_method = 'upi_pin' AND auth_latency_ms IS NULL",
    "latency_without_auth": "auth_method = 'none' AND auth_latency_ms IS NOT NULL",
    "failed_auth_not_declined": "auth_result = 'failure' AND decision <> 'declined'",
    "declined_without_reason": "decision = 'declined' AND decline_reason IS NULL",
    "reason_without_decline": "decision <> 'declined' AND decline_reason IS NOT NULL",
    "negative_beneficiary_age": "beneficiary_added_ago_s < 0",
    "non_positive_session": "session_duration_s <= 0 OR time_on_confirm_screen_s <= 0",
    "negative_pin_attempts": "pin_attempts < 0",
    "agent_traffic": "is_agent_initiated OR agent_declared_principal IS NOT NULL",
}
RULE_ROWS = " UNION ALL ".join(f"SELECT txn_id, '{n}' AS rule FROM payments WHERE {c}" for n, c in _RULES.items())


@query("transaction_violations", "B-25", RULE_ROWS)
def _violations(t):
    return validate.transaction_violations(t.payments)


@query(
    "first_violations",
    "F-4",
    """SELECT txn_id, rule, position FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY txn_id) AS position
    FROM broken) WHERE position <= 5""",
    broken=RULE_ROWS,
)
def _first_violations(t):
    return validate.first_violations(validate.transaction_violations(t.payments))


_DETECT = _in(VOCABULARIES["detectable_at"])


@query(
    "baseline_label_violations",
    "B-26",
    f"""SELECT txn_id, 'is_fraud' AS rule FROM labelrows WHERE is_fraud
    UNION ALL SELECT txn_id, 'attack_metadata' FROM labelrows WHERE attack_id IS NOT NULL OR campaign_id IS NOT NULL OR pretext IS NOT NULL
    UNION ALL SELECT txn_id, 'lookalike' FROM labelrows WHERE is_legit_lookalike
    UNION ALL SELECT txn_id, 'invalid_detectable_at' FROM labelrows WHERE detectable_at NOT IN {_DETECT}""",
)
def _baseline_labels(t):
    return validate.baseline_label_violations(t.labels)


@query(
    "attack_label_violations",
    "B-26",
    f"""SELECT txn_id, rule FROM (
    SELECT txn_id, attack_id, 'not_fraud' AS rule FROM labelrows WHERE NOT is_fraud
    UNION ALL SELECT txn_id, attack_id, 'campaign_missing' FROM labelrows WHERE campaign_id IS NULL
    UNION ALL SELECT txn_id, attack_id, 'pretext_missing' FROM labelrows WHERE pretext IS NULL
    UNION ALL SELECT txn_id, attack_id, 'lookalike' FROM labelrows WHERE is_legit_lookalike
    UNION ALL SELECT txn_id, attack_id, 'invalid_detectable_at' FROM labelrows WHERE detectable_at IS NULL OR detectable_at NOT IN {_DETECT}
    ) WHERE attack_id IS NOT NULL""",
)
def _attack_labels(t):
    return validate.attack_label_violations(t.labels)


@query(
    "edge_violations",
    "B-27",
    f"""SELECT payer_id || '->' || payee_id AS edge, 'outside_dataset' AS rule FROM payments GROUP BY payer_id, payee_id
    UNION ALL SELECT payer_id || '->' || payee_id, 'non_positive_value' FROM payments GROUP BY payer_id, payee_id HAVING sum(amount) <= 0""",
)
def _edge_violations(t):
    # The data set window given here is a day short, so each edge must be reported.
    edges = graph_edges(t.payments, START_US, END_US)
    return validate.edge_violations(edges, START_US, END_US - DAY_US)


def _fk(column: str, table: str, key: str, reason: str) -> str:
    return f"""SELECT txn_id, '{reason}' AS reason FROM payments p WHERE {column} IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM {table} q WHERE q.{key} = p.{column})"""


@query(
    "foreign_key_violations",
    "C-5",
    " UNION ALL ".join(
        [
            _fk("payer_id", "parties", "party_id", "invalid payer reference"),
            _fk("payee_id", "parties", "party_id", "invalid payee reference"),
            _fk("merchant_id", "merchants", "merchant_id", "invalid merchant reference"),
            _fk("device_id", "devices", "device_id", "invalid device reference"),
        ]
    ),
)
def _foreign_keys(t):
    return validate.foreign_key_violations(t.payments, t.parties, t.merchants, t.devices)


@query(
    "edge_endpoint_violations",
    "C-5",
    """SELECT DISTINCT payer_id || '->' || payee_id AS edge, 'invalid source party' AS reason FROM payments
    WHERE payer_id NOT IN (SELECT party_id FROM parties)
    UNION ALL SELECT DISTINCT payer_id || '->' || payee_id, 'invalid destination party' FROM payments
    WHERE payee_id NOT IN (SELECT party_id FROM parties)""",
)
def _edge_endpoints(t):
    edges = t.payments.select(
        F.col("payer_id").alias("src_party_id"), F.col("payee_id").alias("dst_party_id")
    ).distinct()
    return validate.edge_endpoint_violations(edges, t.parties)


_DIFF = """SELECT txn_id, 'left_only' AS side FROM payments WHERE txn_id NOT IN (SELECT txn_id FROM labelrows)
 UNION ALL SELECT txn_id, 'right_only' FROM labelrows WHERE txn_id NOT IN (SELECT txn_id FROM payments)"""


@query("key_set_difference", "C-6", _DIFF)
def _key_diff(t):
    return validate.key_set_difference(t.payments, t.labels)


@query("id_set_difference", "G-3", _DIFF)
def _id_diff(t):
    return validate.id_difference(t.payments, t.labels)


@query(
    "attack_labels_without_payment",
    "C-7",
    "SELECT txn_id, attack_id FROM labelrows WHERE attack_id IS NOT NULL AND txn_id NOT IN (SELECT txn_id FROM payments)",
)
def _attack_orphans(t):
    return validate.attack_labels_without_payment(t.labels, t.payments).select("txn_id", "attack_id")


@query(
    "attack_rows",
    "C-7",
    "SELECT txn_id, payer_id, amount FROM payments WHERE txn_id IN (SELECT txn_id FROM labelrows WHERE attack_id = 'mule_network')",
)
def _attack_rows(t):
    return validate.attack_rows(t.payments, t.labels, "mule_network").select("txn_id", "payer_id", "amount")


@query(
    "inactive_device_use",
    "C-9",
    """SELECT txn_id, 'device_not_active' AS rule FROM payments JOIN devices USING (device_id)
    WHERE NOT (ts_us BETWEEN first_seen_us AND last_seen_us)
    UNION ALL SELECT txn_id, 'device_retired' FROM payments JOIN devices USING (device_id) WHERE ts_us >= retired_us""",
)
def _devices(t):
    return validate.device_activity_violations(t.payments, t.devices)


@query(
    "known_device_mismatches",
    "C-10",
    """SELECT txn_id, device_is_known_for_payer, owned FROM (SELECT p.txn_id, p.device_is_known_for_payer,
    EXISTS (SELECT 1 FROM devices d WHERE d.primary_party_id = p.payer_id AND d.device_id = p.device_id) AS owned
    FROM payments p) WHERE device_is_known_for_payer <> owned""",
)
def _known(t):
    return validate.known_device_mismatches(t.payments, t.devices)


@query(
    "device_chain_violations",
    "C-18",
    """SELECT d.device_id, CASE WHEN o.device_id IS NULL THEN 'replaced_device_missing'
    WHEN o.retired_us IS NULL THEN 'replaced_device_not_retired' ELSE 'retirement_mismatch' END AS rule
    FROM devices d LEFT JOIN devices o ON d.replaced_device_id = o.device_id
    WHERE d.replaced_device_id IS NOT NULL AND (o.retired_us IS NULL OR o.retired_us <> d.first_seen_us)""",
)
def _chain(t):
    return validate.device_chain_violations(t.devices)


@query(
    "duplicate_line_keys",
    "D-9",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
def _duplicates(t):
    return validate.duplicate_keys(t.raw("lineitem"), "l_orderkey", "l_linenumber")


_LINE_SPLIT = """CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN l_shipdate < TIMESTAMP '2000-01-01' THEN 'validation' ELSE 'test' END"""


@query(
    "ids_in_several_splits",
    "G-2",
    """SELECT a.l_orderkey, a.split AS split_a, b.split AS split_b FROM s a JOIN s b
    ON a.l_orderkey = b.l_orderkey AND a.split < b.split""",
    s=f"SELECT DISTINCT l_orderkey, {_LINE_SPLIT} AS split FROM lineitem",
)
def _shared(t):
    year = F.year("l_shipdate")
    split = F.when(year < 1998, "train").when(year < 2000, "validation").otherwise("test")
    return validate.ids_in_several_splits(t.raw("lineitem").select("l_orderkey", split.alias("split")), "l_orderkey")


@query("split_assignment", "B-5 B-6", f"SELECT txn_id, coalesce({SPLIT_CASE}, 'test') AS split FROM payments")
def _split(t):
    return t.payments.select("txn_id", splits.assign_split("ts_us", WINDOWS, outside="test").alias("split"))


@query(
    "split_outside_windows",
    "B-6",
    f"""SELECT txn_id, CASE WHEN ts_us >= {START_US + 2 * DAY_US} AND ts_us < {START_US + 12 * DAY_US} THEN 'train'
    WHEN ts_us >= {START_US + 12 * DAY_US} AND ts_us < {START_US + 17 * DAY_US} THEN 'validation'
    WHEN ts_us >= {START_US + 17 * DAY_US} AND ts_us < {START_US + 22 * DAY_US} THEN 'test' END AS split FROM payments""",
)
def _split_outside(t):
    w = splits.split_windows(START_US + 2 * DAY_US, START_US + 22 * DAY_US, (0.5, 0.25, 0.25))
    return t.payments.select("txn_id", splits.assign_split("ts_us", w).alias("split"))


@query(
    "held_out_family_split",
    "B-7",
    f"""SELECT p.txn_id, CASE WHEN attack_id = 'synthetic_identity_bustout' THEN 'test' ELSE {SPLIT_CASE} END AS split
    FROM payments p LEFT JOIN labelrows l ON p.txn_id = l.txn_id""",
)
def _held_out(t):
    rows = t.payments.select("txn_id", "ts_us").join(t.labels.select("txn_id", "attack_id"), "txn_id", "left")
    split = splits.assign_split("ts_us", WINDOWS)
    return rows.select(
        "txn_id", splits.hold_out_family(split, F.col("attack_id"), "synthetic_identity_bustout").alias("split")
    )


@query(
    "label_splits",
    "C-14",
    f"SELECT l.txn_id, is_fraud, split FROM labelrows l JOIN (SELECT txn_id, {SPLIT_CASE} AS split FROM payments) p ON l.txn_id = p.txn_id",
)
def _label_splits(t):
    return splits.split_labels(t.labels, t.payments, WINDOWS).select("txn_id", "is_fraud", "split")


_CAMPAIGN = f"""SELECT campaign_id, med, CASE WHEN med >= {START_US} AND med < {START_US + 18 * DAY_US} THEN 'train'
 WHEN med >= {START_US} AND med < {START_US + 24 * DAY_US} THEN 'validation' ELSE 'test' END AS split FROM
 (SELECT campaign_id, quantile_cont(cast(ts_us as double), 0.5) AS med FROM payments p JOIN labelrows l ON p.txn_id = l.txn_id
  WHERE campaign_id IS NOT NULL GROUP BY campaign_id)"""


@query("campaign_splits", "D-29", "SELECT campaign_id, split FROM camp", camp=_CAMPAIGN)
def _campaign(t):
    rows = t.payments.select("txn_id", "ts_us").join(t.labels.select("txn_id", "campaign_id"), "txn_id")
    rows = rows.filter(F.col("campaign_id").isNotNull())
    return splits.campaign_splits(rows, WINDOWS).select("campaign_id", "split")


@query(
    "campaign_split_rows",
    "C-15",
    "SELECT p.txn_id, l.campaign_id, c.split FROM payments p JOIN labelrows l ON p.txn_id = l.txn_id JOIN camp c ON c.campaign_id = l.campaign_id",
    camp=_CAMPAIGN,
)
def _campaign_rows(t):
    rows = t.payments.select("txn_id", "ts_us").join(t.labels.select("txn_id", "campaign_id"), "txn_id")
    rows = rows.filter(F.col("campaign_id").isNotNull())
    return rows.join(splits.campaign_splits(rows, WINDOWS), "campaign_id").select("txn_id", "campaign_id", "split")


@query(
    "dataset_metadata",
    "A-3",
    """SELECT 'v1' AS dataset_version, * FROM (SELECT 'transactions' AS table_name, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM payments
    UNION ALL SELECT 'labels', count(*), NULL, NULL FROM labelrows
    UNION ALL SELECT 'parties', count(*), NULL, NULL FROM parties
    UNION ALL SELECT 'devices', count(*), min(first_seen_us), max(first_seen_us) FROM devices
    UNION ALL SELECT 'mandates', count(*), min(created_us), max(created_us) FROM mandates
    UNION ALL SELECT 'merchants', count(*), min(onboarded_us), max(onboarded_us) FROM merchants
    UNION ALL SELECT 'disputes', count(*), NULL, NULL FROM disputes
    UNION ALL SELECT 'graph_edges', count(*), cast(min(window_start_us) as bigint), cast(max(window_start_us) as bigint)
      FROM (SELECT DISTINCT payer_id, payee_id, {start} AS window_start_us FROM payments))""".format(start=START_US),
)
def _metadata(t):
    return profile.dataset_metadata(
        {
            "transactions": (t.payments, "ts_us"),
            "labels": (t.labels, None),
            "parties": (t.parties, None),
            "devices": (t.devices, "first_seen_us"),
            "mandates": (t.mandates, "created_us"),
            "merchants": (t.merchants, "onboarded_us"),
            "disputes": (t.disputes, None),
            "graph_edges": (graph_edges(t.payments, START_US, END_US), "window_start_us"),
        },
        "v1",
    )


@query(
    "count_by_dimension",
    "D-5",
    " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM payments GROUP BY {c}"
        for c in ("rail", "channel", "auth_method", "decision")
    ),
)
def _counts(t):
    return profile.count_by(t.payments, ["rail", "channel", "auth_method", "decision"])


def _lower(rel: str, value: str, metric: str, keys: str = "", where: str = "TRUE") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    sel = f"{keys}," if keys else ""
    picks = ", ".join(
        f"cast(max(CASE WHEN i = cast(floor((n - 1) * {p}e0) as bigint) + 1 THEN v END) as double) AS {q}"
        for q, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))
    )
    return f"""SELECT '{metric}' AS metric, {sel} max(n) AS n_values, {picks} FROM (SELECT {sel} {value} AS v,
    row_number() OVER ({part} ORDER BY {value}) AS i, count(*) OVER ({part}) AS n FROM {rel} WHERE {where}) {f'GROUP BY {keys}' if keys else ''}"""


@query(
    "volume_quantiles",
    "D-6",
    " UNION ALL ".join(
        [
            _lower("payments", "amount", "amount"),
            _lower("(SELECT count(*) AS c FROM payments GROUP BY payer_id)", "c", "transactions_per_party"),
            _lower("(SELECT count(*) AS c FROM payments WHERE merchant_id IS NOT NULL GROUP BY merchant_id)", "c", "transactions_per_merchant"),
        ]
    ),
)
def _volume(t):
    return profile.volume_quantiles(t.payments)


@query("price_quantiles", "D-6", _lower("lineitem", "l_extendedprice", "l_extendedprice", "l_returnflag"))
def _prices(t):
    return profile.quantile_summary(t.raw("lineitem"), "l_extendedprice", "l_extendedprice", ["l_returnflag"])


@query(
    "payment_rates",
    "D-7",
    f"""SELECT count(*) AS n, {sr('avg(CASE WHEN device_is_known_for_payer THEN 1e0 ELSE 0e0 END)')} AS known_device_rate,
    {sr('avg(CASE WHEN beneficiary_first_time THEN 1e0 ELSE 0e0 END)')} AS first_time_beneficiary_rate FROM payments""",
)
def _rates(t):
    out = profile.rates(t.payments)
    return out.select("n", *[r(c).alias(c) for c in ("known_device_rate", "first_time_beneficiary_rate")])


@query(
    "label_distribution",
    "D-8",
    """SELECT count(*) FILTER (is_fraud) AS is_fraud_true, count(*) FILTER (NOT is_fraud) AS is_fraud_false,
    count(*) FILTER (is_legit_lookalike) AS lookalike_true,
    count(*) FILTER (attack_id IS NOT NULL OR campaign_id IS NOT NULL OR pretext IS NOT NULL) AS attack_metadata_rows FROM labelrows""",
)
def _labels(t):
    return profile.label_distribution(t.labels)


@query(
    "entity_counts",
    "D-10",
    """SELECT 'parties' AS entity, count(DISTINCT party_id) AS n_distinct FROM parties
    UNION ALL SELECT 'merchants', count(DISTINCT merchant_id) FROM merchants
    UNION ALL SELECT 'devices', count(DISTINCT device_id) FROM devices""",
)
def _entities(t):
    return profile.entity_counts(t.parties, t.merchants, t.devices)


@query(
    "split_sizes",
    "D-11",
    f"SELECT {SPLIT_CASE} AS split, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM payments GROUP BY 1",
)
def _sizes(t):
    return profile.split_sizes(t.payments.select("ts_us", splits.assign_split("ts_us", WINDOWS).alias("split")))


@query(
    "prevalence",
    "D-32",
    f"""SELECT count(*) AS n, {sr('avg(CASE WHEN is_fraud THEN 1e0 ELSE 0e0 END)')} AS fraud_share,
    {sr('avg(CASE WHEN is_legit_lookalike THEN 1e0 ELSE 0e0 END)')} AS lookalike_share FROM labelrows""",
)
def _prevalence(t):
    return profile.prevalence(t.labels).select("n", *[r(c).alias(c) for c in ("fraud_share", "lookalike_share")])


@query(
    "attack_summary",
    "D-41",
    """SELECT attack_id, sum(n)::bigint AS n_rows, any_value(c) AS n_campaigns, string_agg(pretext || '=' || n, ',' ORDER BY pretext) AS pretexts,
    any_value(c) <= 1 AS one_campaign FROM (SELECT attack_id, coalesce(pretext, 'None') AS pretext, count(*) AS n FROM labelrows
    WHERE attack_id IS NOT NULL GROUP BY 1, 2) JOIN (SELECT attack_id, count(DISTINCT campaign_id) AS c FROM labelrows
    WHERE attack_id IS NOT NULL GROUP BY 1) USING (attack_id) GROUP BY attack_id""",
)
def _attacks(t):
    return profile.attack_summary(t.labels)


@query(
    "weekday_shares",
    "D-38",
    f"""SELECT d AS tx_dayofweek, n, {sr('n / cast(sum(n) OVER () as double)')} AS share,
    (max(n) OVER () - min(n) OVER ()) / cast(sum(n) OVER () as double) <= 0.5e0 / 7 AS flat FROM
    (SELECT (dayofweek(make_timestamp(ts_us)) + 6) % 7 AS d, count(*) AS n FROM payments GROUP BY 1)""",
)
def _weekdays(t):
    return profile.weekday_shares(t.payments).withColumn("share", r("share"))


def _profile_sql(by: str) -> str:
    return f"""SELECT {by}, n_values, p50, p90, p99, mean_amount FROM ({_lower('payments', 'amount', by, by, f'{by} IS NOT NULL')})
    JOIN (SELECT {by}, {sr('sum(cents) / 100e0 / count(*)', 4)} AS mean_amount FROM payments GROUP BY {by}) USING ({by})"""


for _by in ("rail", "mcc"):

    @query(f"amount_profile_{_by}", "D-39", _profile_sql(_by))
    def _profile(t, by=_by):
        return profile.amount_profile(t.payments, by).withColumn("mean_amount", r("mean_amount", 4))


@query(
    "party_profile",
    "D-35",
    f"""SELECT party_id, {sr('CASE WHEN total_out > 0 THEN spend / cast(total_out as double) ELSE 0 END')} AS organic_spend_ratio,
    {sr('CASE WHEN in24 > 0 THEN out24 / cast(in24 as double) ELSE 0 END')} AS throughput_ratio_24h, c30 AS distinct_counterparties_30d FROM (
      SELECT party_id, sum(o) OVER (PARTITION BY party_id) AS total_out,
      sum(CASE WHEN merchant_id IS NOT NULL THEN o ELSE 0 END) OVER (PARTITION BY party_id) AS spend,
      sum(o) OVER w24 AS out24, sum(i) OVER w24 AS in24,
      count(DISTINCT other) OVER (PARTITION BY party_id ORDER BY ts_us RANGE BETWEEN {30 * DAY_US} PRECEDING AND CURRENT ROW) AS c30,
      row_number() OVER (PARTITION BY party_id ORDER BY ts_us DESC) AS rn FROM sides
      WINDOW w24 AS (PARTITION BY party_id ORDER BY ts_us RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW)) WHERE rn = 1""",
    sides="""SELECT payer_id AS party_id, payee_id AS other, ts_us, merchant_id, cents AS o, 0 AS i FROM payments
    UNION ALL SELECT payee_id, payer_id, ts_us, merchant_id, 0, cents FROM payments""",
)
def _party_profile(t):
    out = profile.party_profile(t.payments)
    return out.withColumns({c: r(c) for c in ("organic_spend_ratio", "throughput_ratio_24h")})


@query(
    "merchant_decline_rate",
    "D-36",
    f"""SELECT txn_id, merchant_id, {sr("avg(CASE WHEN decision = 'declined' THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY merchant_id ORDER BY ts_us RANGE BETWEEN " + str(7 * DAY_US) + " PRECEDING AND CURRENT ROW)")} AS decline_rate
    FROM payments WHERE merchant_id IS NOT NULL""",
)
def _decline(t):
    return profile.merchant_decline_rate(t.payments, days=7).withColumn("decline_rate", r("decline_rate"))


@query(
    "claimant_history",
    "D-37",
    f"""SELECT dispute_id, txn_id, payer_id, prior AS claimant_prior_dispute_count,
    {sr('CASE WHEN seen > 0 THEN prior / cast(seen as double) ELSE 0 END')} AS claimant_prior_dispute_rate FROM (
    SELECT d.dispute_id, p.txn_id, p.payer_id, count(d.dispute_id) OVER w AS prior, count(*) OVER w AS seen
    FROM payments p LEFT JOIN disputes d ON d.txn_id = p.txn_id
    WINDOW w AS (PARTITION BY p.payer_id ORDER BY p.ts_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE dispute_id IS NOT NULL""",
)
def _claimant(t):
    return profile.claimant_history(t.disputes, t.payments).withColumn(
        "claimant_prior_dispute_rate", r("claimant_prior_dispute_rate")
    )
