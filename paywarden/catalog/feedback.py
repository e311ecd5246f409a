"""Feedback, sampling, layering and side-input queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paywarden.catalog.features import SPLIT_CASE
from paywarden.catalog.registry import query, r, sr
from paywarden.operators import feedback as fb
from paywarden.operators import metrics, quantiles, sampling
from paywarden.operators.splits import assign_split, split_windows
from paywarden.sources.adapter import END_US, START_US
from paywarden.sources.dataset import layer
from paywarden.sources.side_inputs import map_external

LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY ts_us DESC, analyst_verdict DESC) AS i FROM {rel}) WHERE i = 1"""
HASH = "(cast(substr(txn_id, 2) as bigint) * 48271 % 2147483647)"


def number_hash(column: str = "txn_id"):
    """An integer hash both engines compute alike; the library default is xxhash64."""
    return F.substring(column, 2, 12).cast("long") * 48271 % 2147483647


def _split_rows(t):
    split = assign_split("ts_us", split_windows(START_US, END_US), outside="test")
    return t.scored.select("txn_id", "y", "family", "score", split.alias("split"))


@query(
    "verdict_override",
    "C-12",
    f"""SELECT s.txn_id, CASE v.analyst_verdict WHEN 'FRAUD' THEN 1 WHEN 'LEGITIMATE' THEN 0 ELSE s.y END AS y,
    CASE WHEN v.analyst_verdict IS NOT NULL THEN 'train' ELSE {SPLIT_CASE.replace('ts_us', 's.ts_us')} END AS split
    FROM scored s LEFT JOIN latest v ON v.transaction_id = s.txn_id""",
    usable="SELECT * FROM verdicts WHERE analyst_verdict IN ('FRAUD', 'LEGITIMATE')",
    latest=LATEST.format(rel="usable"),
)
def _override(t):
    return fb.apply_verdicts(_split_rows(t), t.verdicts).select("txn_id", "y", "split")


@query(
    "unknown_verdicts",
    "C-13",
    f"SELECT transaction_id, analyst_verdict, {sr('analyst_confidence')} AS analyst_confidence, ts_us FROM latest WHERE transaction_id NOT IN (SELECT txn_id FROM payments)",
    latest=LATEST.format(rel="verdicts"),
)
def _unknown(t):
    return fb.unknown_verdicts(t.verdicts, t.payments).withColumn("analyst_confidence", r("analyst_confidence"))


@query(
    "feedback_summary",
    "D-30",
    f"""SELECT count(*) AS total_feedback, count(*) FILTER (analyst_verdict = 'FRAUD') AS fraud_confirmed,
    count(*) FILTER (analyst_verdict = 'LEGITIMATE') AS legitimate_confirmed, count(*) FILTER (analyst_verdict = 'UNSURE') AS unsure,
    {sr("avg(analyst_confidence) FILTER (analyst_verdict = 'FRAUD')")} AS fraud_confidence, max(ts_us) AS last_updated_us, count(*) >= 5 OR count(*) FILTER (analyst_verdict = 'FRAUD') >= 5 AS should_retrain,
    'Enough fraud feedback (' || count(*) FILTER (analyst_verdict = 'FRAUD') || ' confirmed)' AS reason FROM verdicts""",
)
def _summary(t):
    return fb.feedback_summary(t.verdicts).withColumn("fraud_confidence", r("fraud_confidence"))


@query("signal_counts", "H-2", "SELECT entry, analyst_verdict, count(*) AS n FROM (SELECT unnest(key_signals) AS entry, analyst_verdict FROM verdicts) GROUP BY ALL")
def _signals(t):
    return fb.signal_counts(t.verdicts)


@query("pattern_counts", "H-2", "SELECT entry, analyst_verdict, count(*) AS n FROM (SELECT unnest(patterns) AS entry, analyst_verdict FROM verdicts) GROUP BY ALL")
def _patterns(t):
    return fb.signal_counts(t.verdicts, "patterns")


@query(
    "analyst_agreement",
    "D-34",
    f"SELECT count(*) AS n, {sr('''avg(CASE WHEN (risk_score >= 60) = (analyst_verdict = 'FRAUD') THEN 1e0 ELSE 0e0 END)''')} AS agreement FROM verdicts",
)
def _agreement(t):
    return fb.agreement_rate(t.verdicts).withColumn("agreement", r("agreement"))


# Usage lines made from orders: some have no cost, some a cost that is not a number.
_LINE = """CASE WHEN o_orderkey % 17 = 0 THEN 'garbage' WHEN o_orderkey % 13 = 0 THEN {ts} || '|n/a' ELSE {ts} || '|' || cast(o_custkey % 9 as string) || '.25' END"""


@query(
    "usage_log",
    "A-11",
    f"SELECT epoch_us(cast(string_split(line, '|')[1] as timestamp)) AS used_us, cast(string_split(line, '|')[2] as double) AS cost_usd FROM lines WHERE try_cast(string_split(line, '|')[2] as double) IS NOT NULL",
    lines=f"SELECT {_LINE.format(ts='''strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')''')} AS line FROM orders",
)
def _usage(t):
    return fb.parse_usage(_usage_lines(t)).select(F.unix_micros("used_at").alias("used_us"), "cost_usd")


def _usage_lines(t):
    ts = "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")"
    return t.raw("orders").selectExpr(f"{_LINE.format(ts=ts)} AS line")


@query(
    "daily_usage",
    "D-31",
    f"""SELECT cast(day as varchar) AS day, {sr('spent')} AS spent_usd, n AS request_count, {sr('20 - spent')} AS remaining_usd, n < 20 AND spent + 0.005 <= 20 AS can_proceed FROM (
    SELECT cast(cast(string_split(line, '|')[1] as timestamp) as date) AS day, sum(cast(string_split(line, '|')[2] as double)) AS spent, count(*) AS n FROM lines
    WHERE try_cast(string_split(line, '|')[2] as double) IS NOT NULL GROUP BY 1)""",
    lines=f"SELECT {_LINE.format(ts='''strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')''')} AS line FROM orders",
)
def _daily(t):
    out = fb.daily_usage(fb.parse_usage(_usage_lines(t)), limit_usd=20.0)
    return out.select(
        F.col("day").cast("string").alias("day"), r("spent_usd").alias("spent_usd"), "request_count",
        r("remaining_usd").alias("remaining_usd"), "can_proceed",
    )


@query(
    "external_csv_mapping",
    "A-8",
    """SELECT event_id, cast(value as double) AS amount, step % 24 AS tx_hour, (step // 24) % 7 AS tx_dayofweek, dist1 < 50 AS geo_matches_billing,
    dt IS NOT NULL AS device_is_known_for_payer, cast(dense_rank() OVER (ORDER BY event_type) - 1 as int) AS mcc,
    """ + sr("value * 2 - user_id") + """ AS amount_deviation, cast(k as double) AS account_age_days, event_type AS channel, true AS is_fraud, 'synthetic_pattern_fraud' AS attack_id
    FROM (SELECT *, ts_us // 3600000000 AS step, k AS dist1, CASE WHEN k % 2 = 0 THEN 'mobile' END AS dt FROM shaped)""",
)
def _external(t):
    raw = t.shaped.selectExpr(
        "event_id", "cast(value as string) AS TransactionAmt", "cast(ts_us div 3600000000 as string) AS step",
        "cast(k as string) AS dist1", "CASE WHEN k % 2 = 0 THEN 'mobile' END AS DeviceType", "event_type AS category",
        "cast(k as string) AS D1", "event_type AS ProductCD", "cast(user_id as string) AS oldbalanceOrg",
        "cast(value * 2 as string) AS newbalanceOrig",
    )
    return map_external(raw, ("event_id",)).select(
        "event_id", "amount", "tx_hour", "tx_dayofweek", "geo_matches_billing", "device_is_known_for_payer", "mcc",
        r("amount_deviation").alias("amount_deviation"), "account_age_days", "channel", "is_fraud", "attack_id",
    )


_LAYER = """SELECT txn_id, amount, cast(NULL as varchar) AS source FROM payments WHERE rail <> 'neft'
 UNION ALL SELECT txn_id, amount, 'attack' FROM payments WHERE rail = 'neft'
 UNION ALL SELECT 'L' || txn_id, cast(amount * 2 as decimal(12,2)), 'lookalike' FROM payments WHERE rail = 'neft'"""


@query("layered_dataset", "A-12 G-1", _LAYER)
def _layer(t):
    slim = t.payments.select("txn_id", "amount", "rail")
    attack = slim.filter("rail = 'neft'").withColumn("source", F.lit("attack"))
    lookalike = attack.withColumns(
        {
            "txn_id": F.concat(F.lit("L"), "txn_id"),
            "amount": (F.col("amount") * 2).cast("decimal(12,2)"),
            "source": F.lit("lookalike"),
        }
    )
    base = {"transactions": slim.filter("rail <> 'neft'"), "labels": t.labels, "parties": t.parties}
    out = layer(base, {"transactions": attack}, {"transactions": lookalike})
    return out["transactions"].select("txn_id", "amount", "source")


@query(
    "percent_rank_average",
    "E-25",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, {sr('(rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2e0) / count(*) OVER (PARTITION BY l_returnflag)')} AS pct
    FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""",
)
def _percent(t):
    rows = t.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity")
    return quantiles.percent_rank_average(rows, ["l_returnflag"], "l_quantity", "pct").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", r("pct").alias("pct")
    )


@query("time_order", "F-1", "SELECT txn_id, ts_us, row_number() OVER (ORDER BY ts_us, txn_id) AS position FROM payments")
def _order(t):
    from paywarden.operators.scan import Metric, find_hot_keys, prefix_scan

    rows = t.payments.select("txn_id", "ts_us")
    out = prefix_scan(
        rows, [], ["ts_us", "txn_id"], {"position": Metric("sum", F.lit(1).cast("long"), True)},
        find_hot_keys(rows, [], "ts_us"),
    )
    return out.orderBy("ts_us", "txn_id")


@query(
    "capped_levels",
    "F-6",
    f"SELECT txn_id, family FROM (SELECT txn_id, family, row_number() OVER (PARTITION BY family ORDER BY {HASH}, txn_id) AS i FROM scored WHERE y = 1) WHERE i <= 30",
)
def _capped(t):
    rows = t.scored.filter("y = 1").select("txn_id", "family")
    return sampling.take_by_hash(rows, 30, "txn_id", ["family"], number_hash())


@query(
    "seeded_sample",
    "F-6",
    f"SELECT txn_id, score FROM scored WHERE y = 0 ORDER BY {HASH}, txn_id LIMIT 3000",
)
def _sample(t):
    rows = t.scored.filter("y = 0").select("txn_id", "score")
    return sampling.take_by_hash(rows, 3000, "txn_id", hash_column=number_hash())


@query(
    "hold_out_split",
    "F-7",
    f"SELECT txn_id, CASE WHEN {HASH} % 10000 < 8000 THEN 'train' ELSE 'test' END AS split FROM scored WHERE y = 1",
)
def _hold_out(t):
    rows = t.scored.filter("y = 1").select("txn_id")
    return sampling.hash_split(rows, number_hash(), 0.8, "train", "test")


@query(
    "downsampled_fraud",
    "F-8",
    f"""SELECT txn_id, y FROM scored WHERE y = 0 UNION ALL SELECT txn_id, y FROM (SELECT txn_id, y, row_number() OVER (ORDER BY {HASH}, txn_id) AS i FROM scored WHERE y = 1)
    WHERE i <= (SELECT cast(floor(count(*) * 0.035e0 / (1 - 0.035e0)) as bigint) FROM scored WHERE y = 0)""",
)
def _downsample(t):
    return sampling.downsample_fraud(t.scored.select("txn_id", "y"), 0.035, "txn_id", hash_column=number_hash())


_BASE = "y = 0 OR family IN ('mule_network', 'insider_abuse')"


@query(
    "capped_retained",
    "F-9",
    f"""SELECT txn_id, y FROM scored WHERE {_BASE} UNION ALL SELECT txn_id, y FROM (SELECT txn_id, y, row_number() OVER (ORDER BY {HASH}, txn_id) AS i FROM scored WHERE NOT ({_BASE}))
    WHERE i <= (SELECT cast(floor((0.05e0 * count(*) - sum(y) - 20) / (1 - 0.05e0)) as bigint) FROM scored WHERE {_BASE})""",
)
def _retained(t):
    rows = t.scored.select("txn_id", "y", "family")
    base, rest = rows.filter(_BASE), rows.filter(f"NOT ({_BASE})")
    return sampling.cap_retained(base, rest, "txn_id", 20, hash_column=number_hash()).select("txn_id", "y")


@query(
    "best_checkpoint",
    "F-10",
    f"""SELECT checkpoint, {sr('evasion')} AS evasion FROM (SELECT checkpoint, 1 - count(*) FILTER (score > 0.45e0) / cast(count(*) as double) AS evasion
    FROM scored WHERE y = 1 GROUP BY checkpoint) ORDER BY evasion, checkpoint DESC LIMIT 1""",
)
def _best(t):
    log = metrics.evasion(t.scored.filter("y = 1"), by="checkpoint").select(
        "checkpoint", F.ascii(F.substring("checkpoint", 6, 1)).alias("level"), F.col("evasion_margin").alias("evasion")
    )
    return sampling.best_checkpoint(log).withColumn("evasion", r("evasion"))


_LVL = """(SELECT txn_id, y, row_number() OVER (ORDER BY {h}, txn_id) AS i FROM scored WHERE y = 1 AND generation = '{g}')"""


@query(
    "curriculum_training_set",
    "J-9",
    f"""SELECT txn_id, y, {SPLIT_CASE} AS split FROM scored WHERE generation = 'gen2' AND {SPLIT_CASE} IN ('train', 'validation')
    UNION ALL SELECT txn_id, y, 'train' FROM {_LVL.format(h=HASH, g='gen3')} WHERE i <= 60 AND cast(floor({HASH} / 7e0) as bigint) % 10000 < 8000
    UNION ALL SELECT txn_id, y, 'train' FROM {_LVL.format(h=HASH, g='gen4')} WHERE i <= 60 AND cast(floor({HASH} / 7e0) as bigint) % 10000 < 8000
    UNION ALL SELECT txn_id, y, 'train' FROM {_LVL.format(h=HASH, g='gen5')} WHERE i <= 25""",
)
def _curriculum(t):
    split = assign_split("ts_us", split_windows(START_US, END_US), outside="test")
    rows = t.scored.select("txn_id", "y", "generation", split.alias("split"))
    attacks = rows.filter("y = 1").drop("split")
    levels = [
        fb.curriculum_level(attacks.filter(F.col("generation") == g), 60, hash_column=number_hash()) for g in ("gen3", "gen4")
    ]
    retained = sampling.take_by_hash(attacks.filter("generation = 'gen5'"), 25, "txn_id", hash_column=number_hash())
    out = fb.assemble_training(rows.filter("generation = 'gen2'"), None, levels, retained)
    return out.select("txn_id", "y", "split")
