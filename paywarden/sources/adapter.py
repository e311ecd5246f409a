"""Payment tables derived from the driver's tables.

The given tables are not payments, so this module derives a payments data set
from them: ``events`` give the transactions and labels, ``customer`` the parties
and devices, ``supplier`` the merchants and ``orders`` the mandates. Every column
is integer or string arithmetic on the given rows. The column lists are plain SQL
text that reads the same in Spark and in the oracle engine, so both sides of a
check start from the same rows; the operators themselves are not shared.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from paywarden.schema import ATTACK_FAMILIES
from paywarden.session import configure

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
# The month the driver's events cover.
START_US = 1_704_067_200_000_000
END_US = START_US + 30 * DAY_US


def _pick(expr: str, values) -> str:
    """``CASE`` over 0..n-1; None gives NULL."""
    whens = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v))
        for i, v in enumerate(values)
    )
    return f"CASE {expr} {whens} END"


SPARK_EVENTS = {
    "event_id": "event_id",
    "ts_us": "unix_micros(cast(ts as timestamp))",
    "user_id": "user_id",
    "k": "cast(get_json_object(props, '$.k') as bigint)",
    "event_type": "event_type",
    "value": "value",
}
ORACLE_EVENTS = {
    **{c: c for c in ("event_id", "user_id", "event_type", "value")},
    "ts_us": "epoch_us(ts)",
    "k": "cast(json_extract_string(props, '$.k') as bigint)",
}

MIX = {
    "m1": "(event_id * 7919 + user_id * 31 + 13) % 1000",
    "m2": "(event_id * 104729 + 7) % 997",
    "m3": "(event_id * 1299709 + k * 17 + 3) % 10007",
    "m4": "(event_id * 31 + user_id * 17 + k * 5) % 1009",
}

SHAPE = {
    "p2m": "k % 3 = 0",
    "rail": (
        "CASE WHEN k % 3 = 0 THEN CASE WHEN m2 % 4 = 0 THEN 'card_cnp' ELSE "
        + _pick("m1 % 7", ["card_cnp", "card_cp", "upi_p2m", "upi_collect_merchant", "upi_mandate", "wallet", "bnpl"])
        + " END ELSE "
        + _pick("m1 % 5", ["upi_p2p", "upi_p2p", "imps", "neft", "upi_lite"])
        + " END"
    ),
    "amount_raw": (
        "CASE WHEN m3 % 25 = 0 THEN value * 500 "
        "WHEN m2 % 9 = 0 THEN floor(value / 50) * 50 + 50 "
        "WHEN m1 % 7 = 0 AND m2 % 3 = 0 THEN (cast(floor(value) as bigint) % 14) + 0.5e0 "
        "ELSE value END"
    ),
    "epoch_day": f"cast(floor(ts_us / {DAY_US}e0) as bigint)",
}

AUTH = {
    "auth_method": (
        "CASE WHEN rail = 'card_cnp' THEN "
        + _pick("m1 % 4", ["cvv_only", "3ds_frictionless", "3ds_challenge_otp", "3ds_challenge_biometric"])
        + " WHEN rail = 'upi_mandate' THEN 'mandate_no_afa' WHEN rail = 'upi_lite' THEN 'lite_none'"
        " WHEN rail IN ('card_cp', 'wallet', 'bnpl') THEN 'none'"
        " WHEN rail = 'neft' AND m2 % 3 = 0 THEN 'none' ELSE 'upi_pin' END"
    ),
    "auth_result": (
        "CASE WHEN event_type = 'error' THEN CASE WHEN m1 % 3 = 0 THEN 'failure' ELSE 'not_attempted' END"
        " WHEN event_type = 'signup' AND m1 % 11 = 0 THEN 'abandoned' ELSE 'success' END"
    ),
    "decision": (
        "CASE WHEN event_type = 'error' AND m2 % 53 <> 0 THEN 'declined'"
        " WHEN event_type = 'signup' AND m1 % 7 = 0 THEN 'flagged_review' ELSE 'approved' END"
    ),
}

TRANSACTION = {
    "txn_id": "'T' || lpad(cast(event_id as string), cast(greatest(12, length(cast(event_id as string))) as int), '0')",
    "ts_us": "ts_us",
    "rail": "rail",
    "channel": _pick(
        "m1 % 9", ["web", "app", "pos", "qr_static", "qr_dynamic", "intent_link", "agent", "app", "PAYPAL"]
    ),
    "direction": "CASE WHEN rail IN ('upi_collect_merchant', 'upi_mandate') THEN 'pull' ELSE 'push' END",
    "payer_id": "'P' || cast(user_id as string)",
    "payee_id": "'P' || cast(k as string)",
    "merchant_id": (
        "CASE WHEN p2m AND m1 % 97 = 0 THEN 'P' || cast((k + 3) % 99 as string)"
        " WHEN p2m THEN 'P' || cast(k as string) END"
    ),
    "amount": "cast(amount_raw as decimal(12,2))",
    "currency": "CASE WHEN m3 % 211 = 0 THEN 'USD' ELSE 'INR' END",
    "amount_is_round": "cast(amount_raw as decimal(12,2)) % 100 = 0",
    "mcc": "CASE WHEN p2m OR m1 % 101 = 0 THEN cast(5400 + k % 7 * 11 as int) END",
    "purpose_code": "CASE WHEN m2 % 6 = 0 THEN 'P0' || cast(m1 % 4 as string) END",
    "auth_method": "auth_method",
    "auth_result": "auth_result",
    "auth_latency_ms": (
        "CASE WHEN auth_method = 'none' AND m1 % 89 <> 0 THEN NULL WHEN m3 % 307 = 0 THEN NULL"
        " ELSE cast(200 + m3 % 4000 as int) END"
    ),
    "eci": "CASE WHEN rail = 'card_cnp' THEN '0' || cast(5 + m2 % 3 as string) END",
    "liability_shift": "CASE WHEN rail = 'card_cnp' THEN m1 % 4 > 0 END",
    "exemption_claimed": (
        "CASE WHEN rail = 'card_cnp' THEN "
        + _pick("m2 % 6", ["none", "tra", "low_value", "mit", "whitelist", "delegated"])
        + " END"
    ),
    "decision": "decision",
    "decline_reason": (
        "CASE WHEN decision = 'declined' AND m1 % 61 <> 0 THEN "
        + _pick("m2 % 3", ["insufficient_funds", "do_not_honor", "auth_failed"])
        + " WHEN decision = 'approved' AND m3 % 401 = 0 THEN 'stale' END"
    ),
    "issuer_risk_score": "m3 / 10007e0",
    "device_id": (
        "CASE WHEN m2 % 31 = 0 THEN 'DX' || cast(k % 5 as string)"
        " ELSE 'D' || cast(user_id as string) || '-' || cast(CASE WHEN m1 % 10 < 7 THEN 0 ELSE m1 % 3 END as string) END"
    ),
    "device_is_known_for_payer": "m2 % 31 <> 0 AND m1 % 67 <> 0",
    "session_id": "'S' || cast(user_id as string) || '_' || cast(cast(floor(epoch_day / 3e0) as bigint) as string)",
    "session_duration_s": "CASE WHEN m3 % 503 = 0 THEN 0 ELSE cast(15 + m1 % 600 as int) END",
    "time_on_confirm_screen_s": "(m2 % 300) / 10e0 + 0.4e0",
    "beneficiary_first_time": "m1 % 4 = 0",
    "beneficiary_added_ago_s": (
        "CASE WHEN m3 % 911 = 0 THEN -5 WHEN m1 % 4 = 0 THEN m2 * 4 WHEN m3 % 29 = 0 THEN m3 % 43200"
        " ELSE 604800 + m3 * 100 END"
    ),
    "pin_attempts": "CASE WHEN auth_method = 'upi_pin' THEN cast(m3 % 6 as int) ELSE 0 END",
    "screen_share_active": "m1 % 23 = 0",
    "call_active_during_txn": "m2 % 11 = 0",
    "accessibility_service_active": "m3 % 37 = 0",
    "paste_used_in_amount": "m1 % 13 = 0",
    "is_agent_initiated": "m2 % 8 = 0",
    "agent_declared_principal": "CASE WHEN m2 % 16 = 0 THEN 'principal-' || cast(user_id % 5 as string) END",
    "ip_country": _pick("m3 % 11 % 5", ["IN", "IN", "IN", "SG", "US"]),
    "ip_asn": "'AS' || cast(CASE WHEN m3 % 10 = 0 THEN 900 + m2 % 20 ELSE user_id % 50 END as string)",
    "ip_is_proxy": "m3 % 7 = 0",
    "geo_matches_billing": "CASE WHEN rail IN ('card_cnp', 'card_cp') THEN m3 % 13 <> 0 END",
    "geo_matches_payer_home": "m3 % 19 <> 0 AND m2 % 31 <> 0",
    "tpap_app": _pick("m2 % 7", ["app_a", "app_b", "app_c", "app_d", "app_a", None, ""]),
    "linked_account_id": (
        "CASE WHEN m1 % 17 = 0 THEN NULL ELSE 'L' || cast(user_id as string) || '-' || cast(m3 % 3 as string) END"
    ),
}

# Ground truth and side inputs keyed by event, kept out of the transactions.
SIDE = {
    # Fraud follows what a payment shows (calls, shared screens, proxies, new payees, place), with hash noise.
    "fraud": (
        "m4 % 48 < 2 + CASE WHEN m1 % 23 = 0 THEN 12 ELSE 0 END + CASE WHEN m2 % 11 = 0 THEN 6 ELSE 0 END"
        " + CASE WHEN m3 % 7 = 0 THEN 3 ELSE 0 END + CASE WHEN m1 % 4 = 0 THEN 3 ELSE 0 END + CASE WHEN m3 % 19 = 0 THEN 9 ELSE 0 END"
    ),
    "lookalike": "m4 % 48 >= 44",
    "family": _pick("cast(floor(m4 / 48e0) as bigint) % 16", ATTACK_FAMILIES),
}

LABEL = {
    "txn_id": "CASE WHEN event_id % 211 = 3 THEN 'TX' ELSE 'T' END || lpad(cast(event_id as string), cast(greatest(12, length(cast(event_id as string))) as int), '0')",
    "is_fraud": "fraud",
    "attack_id": "CASE WHEN fraud THEN family END",
    "campaign_id": (
        f"CASE WHEN fraud AND m2 % 50 <> 0 THEN family || '-' || cast(cast(floor(ts_us / {5 * DAY_US}e0) as bigint) as string) END"
    ),
    "pretext": (
        "CASE WHEN fraud AND m2 % 43 <> 0 THEN "
        + _pick("m2 % 5", ["digital_arrest", "kyc_expiry", "romance", "job_task", "bank_official"])
        + " END"
    ),
    "is_legit_lookalike": "lookalike",
    "detectable_at": (
        "CASE WHEN fraud OR lookalike THEN "
        + _pick("m1 % 5", ["pre_auth", "post_auth", "post_settlement", "only_in_hindsight", "someday"])
        + " END"
    ),
}

# One scoring request per payment: model outputs and the features the rules read.
REQUEST = {
    "probability": "score",
    "family_1": _pick("m1 % 16", ATTACK_FAMILIES),
    "family_2": _pick("(m1 + 5) % 16", ATTACK_FAMILIES),
    "p_1": "0.5e0 + (m1 % 40) / 100e0",
    "p_2": "(0.5e0 - (m1 % 40) / 100e0) * 0.7e0",
    "p_3": "(0.5e0 - (m1 % 40) / 100e0) * 0.3e0",
    "edge_count": "cast(m2 % 45 as double)",
    "historical_average_amount": "CASE WHEN m1 % 19 = 0 THEN 0e0 ELSE 1 + m3 / 100e0 END",
    "amount_deviation": "abs(cast(cast(amount_raw as decimal(12,2)) as double) - (1 + m3 / 100e0))",
    "new_device_indicator": "m1 % 6 = 0",
    "new_ip_indicator": "m2 % 9 = 0",
    "contribution_1": "(m1 % 40 - 10) / 100e0",
    "contribution_2": "(m2 % 30 - 20) / 100e0",
    "contribution_3": "CASE WHEN m3 % 3 = 0 THEN 0e0 ELSE (m3 % 50 - 25) / 300e0 END",
    "body": (
        "'{\"transaction\": {\"amount\": ' || cast(cast(amount_raw as decimal(12,2)) as string) || "
        "', \"channel\": \"' || event_type || '\", \"pin_attempts\": ' || cast(m3 % 6 as string) || '}' || "
        "CASE WHEN m1 % 2 = 0 THEN ', \"baseline_amount\": ' || cast(m2 as string) ELSE '' END || '}'"
    ),
}

_S = "floor((CASE WHEN fraud THEN 0.25e0 + 0.75e0 * (m3 % 1000) / 1000e0 ELSE (m3 % 1000) / 1000e0 * (m3 % 1000) / 1250e0 END) * 1000) / 1000e0"
SCORED = {
    "txn_id": "'T' || lpad(cast(event_id as string), cast(greatest(12, length(cast(event_id as string))) as int), '0')",
    "ts_us": "ts_us",
    "y": "CASE WHEN fraud THEN 1 ELSE 0 END",
    "family": "CASE WHEN fraud THEN family ELSE '__legit__' END",
    "intensity": _pick("m1 % 3", ["LOW", "MEDIUM", "HIGH"]),
    "generation": _pick("m2 % 4", ["gen2", "gen3", "gen4", "gen5"]),
    "checkpoint": _pick("m2 % 3", ["ckpt_a", "ckpt_b", "ckpt_c"]),
    "pred_family": f"CASE WHEN m3 % 4 = 0 THEN {_pick('m3 % 16', ATTACK_FAMILIES)} ELSE family END",
    "score": _S,
}

VERDICT = {
    "transaction_id": (
        "CASE WHEN m1 % 50 = 0 THEN 'LIVE' ELSE 'T' END || lpad(cast(event_id as string), cast(greatest(12, length(cast(event_id as string))) as int), '0')"
    ),
    "ts_us": "ts_us + m1 * 60000000 + rep * 7200000000",
    "analyst_verdict": "CASE (m2 + rep) % 4 WHEN 0 THEN 'LEGITIMATE' WHEN 1 THEN 'UNSURE' ELSE 'FRAUD' END",
    "analyst_confidence": "0.5e0 + (m1 % 50) / 100e0",
    "signals": _pick(
        "m3 % 4",
        [
            "edge_count,beneficiary_added_ago_s",
            "pin_attempts",
            "amount_deviation,new_device_indicator,edge_count",
            "ip_is_proxy,pin_attempts",
        ],
    ),
    "patterns": _pick("m2 % 3", ["mule_network_pattern", "card_testing_pattern,velocity_pattern", "remittance_pattern"]),
    "risk_score": "m3 % 101",
}

PARTY = {
    "party_id": "'P' || cast(c_custkey as string)",
    "party_type": "CASE WHEN c_custkey % 3 = 0 AND c_custkey < 100 THEN 'merchant' ELSE 'consumer' END",
    "account_age_days": "cast(30 + c_custkey * 37 % 3000 as int)",
    "kyc_level": _pick("c_custkey % 4", ["full", "min_kyc", "video_kyc", "none"]),
    "has_salary_credit": "c_acctbal > 3000",
    "home_pincode": "cast(110000 + c_nationkey * 100 + c_custkey % 100 as string)",
    "flagged_by_ffri": "c_custkey % 29 = 0",
}

DEVICE = {
    "device_id": "'D' || cast(c_custkey as string) || '-' || cast(j as string)",
    "primary_party_id": "'P' || cast(c_custkey as string)",
    "device_type": _pick("(c_custkey + j) % 5", ["android", "ios", "desktop", "pos_terminal", "other"]),
    "first_seen_us": (
        f"CASE WHEN j = 1 THEN {START_US} + (c_custkey % 20) * {DAY_US} ELSE {START_US} - (c_custkey % 300) * {DAY_US} END"
    ),
    "last_seen_us": f"{START_US} + (25 + c_custkey % 10) * {DAY_US}",
    "retired_us": (
        f"CASE WHEN j = 0 AND c_custkey % 4 = 0 THEN {START_US} + (c_custkey % 20) * {DAY_US} "
        f"WHEN j = 0 AND c_custkey % 4 = 1 AND c_custkey % 3 = 0 THEN {START_US} + 3 * {DAY_US} END"
    ),
    "replaced_device_id": (
        "CASE WHEN j = 1 AND c_custkey % 4 < 2 THEN 'D' || cast(c_custkey as string) || '-0'"
        " WHEN j = 2 AND c_custkey % 50 = 9 THEN 'D-missing' END"
    ),
}

MERCHANT = {
    "merchant_id": "'P' || cast(s_suppkey as string)",
    "mcc_declared": "cast(5400 + s_suppkey % 7 * 11 as int)",
    "mcc_inferred_from_basket": (
        "CASE WHEN s_suppkey % 5 = 0 THEN cast(5400 + (s_suppkey + 1) % 7 * 11 as int)"
        " WHEN s_suppkey % 11 = 0 THEN NULL ELSE cast(5400 + s_suppkey % 7 * 11 as int) END"
    ),
    "onboarded_us": f"{START_US} - (s_suppkey * 13 % 90 - 8) * {DAY_US}",
    "kyb_docs_verified_against_registry": "s_suppkey % 4 <> 0",
    "volume_growth_curve": _pick("cast(floor(s_suppkey / 12e0) as bigint) % 3", ["organic", "step", "spike"]),
}

MANDATE = {
    "mandate_id": "'M' || cast(o_orderkey as string)",
    "payer_id": "'P' || cast(o_custkey as string)",
    "merchant_id": "'P' || cast(o_orderkey % 33 * 3 as string)",
    "max_amount": "cast(o_totalprice as decimal(12,2))",
    "actual_amount": "cast(o_totalprice as decimal(12,2)) - cast(o_orderkey % 9 * 100 as decimal(12,2))",
    "created_us": "order_us",
    "cancelled_us": f"CASE WHEN o_orderstatus = 'F' THEN order_us + (o_orderkey % 40) * {DAY_US} END",
    "re_registered_from_mandate_id": (
        "CASE WHEN o_orderkey % 6 = 1 THEN 'M' || cast(o_orderkey - 1 as string) END"
    ),
}

DISPUTE = {
    "dispute_id": "'X' || cast(event_id as string)",
    "txn_id": "'T' || lpad(cast(event_id as string), cast(greatest(12, length(cast(event_id as string))) as int), '0')",
    "raised_at_offset_days": "cast(1 + m1 % 30 as int)",
    "reason_code": _pick("m2 % 3", ["not_received", "unauthorised", "not_as_described"]),
}
DISPUTED = "rail = 'card_cnp' AND m3 % 3 = 0"
PARTY_FILTER = "c_custkey % 41 <> 7"
MERCHANT_FILTER = "s_suppkey % 3 = 0 AND s_suppkey % 45 <> 12"
VERDICT_FILTER = "m3 % 5 = 0 AND (rep = 0 OR m3 % 7 = 0)"


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def _items(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


@dataclass
class DriverTables:
    """Lazy payment tables over one folder of driver tables."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        configure(self.spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def shaped(self) -> DataFrame:
        """Events with the mixing columns, rail and authentication."""
        return (
            self.raw("events")
            .selectExpr(*_items(SPARK_EVENTS))
            .selectExpr("*", *_items(MIX))
            .selectExpr("*", *_items(SHAPE))
            .selectExpr("*", *_items(AUTH))
            .selectExpr("*", *_items(SIDE))
        )

    @cached_property
    def payments(self) -> DataFrame:
        """All transaction columns; ``ts_us`` is the event time in microseconds."""
        return self.shaped.selectExpr(*_items(TRANSACTION)).selectExpr(
            "*", "timestamp_micros(ts_us) AS timestamp", "cast(amount * 100 as bigint) AS cents"
        )

    @cached_property
    def labels(self) -> DataFrame:
        return self.shaped.filter("event_id % 503 <> 5").selectExpr(*_items(LABEL))

    @cached_property
    def scored(self) -> DataFrame:
        return self.shaped.selectExpr(*_items(SCORED))

    @cached_property
    def requests(self) -> DataFrame:
        """Payments with their model outputs, as the risk fusion receives them."""
        return (
            self.shaped.selectExpr("*", f"{_S} AS score")
            .selectExpr(*_items({**TRANSACTION, **REQUEST}))
            .selectExpr(
                "*",
                "map(family_1, p_1, family_2, p_2, 'novel_family', p_3) AS attack_probabilities",
                "array(named_struct('name', 'edge_count', 'contribution', contribution_1),"
                " named_struct('name', 'pin_attempts', 'contribution', contribution_2),"
                " named_struct('name', 'amount_deviation', 'contribution', contribution_3)) AS contributions",
            )
        )

    @cached_property
    def verdicts(self) -> DataFrame:
        return (
            self.shaped.selectExpr("*", "explode(sequence(0, 1)) AS rep")
            .filter(VERDICT_FILTER)
            .selectExpr(*_items(VERDICT))
            .selectExpr(
                "* except (signals, patterns)",
                "split(signals, ',') AS key_signals",
                "split(patterns, ',') AS patterns",
            )
        )

    @cached_property
    def disputes(self) -> DataFrame:
        return self.shaped.filter(DISPUTED).selectExpr(*_items(DISPUTE))

    @cached_property
    def parties(self) -> DataFrame:
        return self.raw("customer").filter(PARTY_FILTER).selectExpr(*_items(PARTY))

    @cached_property
    def devices(self) -> DataFrame:
        return (
            self.raw("customer")
            .selectExpr("c_custkey", "explode(sequence(0, 2)) AS j")
            .selectExpr(*_items(DEVICE))
        )

    @cached_property
    def merchants(self) -> DataFrame:
        return self.raw("supplier").filter(MERCHANT_FILTER).selectExpr(*_items(MERCHANT))

    @cached_property
    def mandates(self) -> DataFrame:
        return (
            self.raw("orders")
            .selectExpr("*", "unix_micros(cast(o_orderdate as timestamp)) AS order_us")
            .selectExpr(*_items(MANDATE))
        )


_ORACLE_TABLES = {
    "shaped0": f"SELECT {_select(ORACLE_EVENTS)} FROM events",
    "shaped1": f"SELECT *, {_select(MIX)} FROM shaped0",
    "shaped2": f"SELECT *, {_select(SHAPE)} FROM shaped1",
    "shaped3": f"SELECT *, {_select(AUTH)} FROM shaped2",
    "shaped": f"SELECT *, {_select(SIDE)} FROM shaped3",
    "payments0": f"SELECT {_select(TRANSACTION)} FROM shaped",
    "payments": "SELECT *, cast(amount * 100 as bigint) AS cents FROM payments0",
    "labelrows": f"SELECT {_select(LABEL)} FROM shaped WHERE event_id % 503 <> 5",
    "scored": f"SELECT {_select(SCORED)} FROM shaped",
    "requests0": f"SELECT *, {_S} AS score FROM shaped",
    "requests": f"SELECT {_select({**TRANSACTION, **REQUEST})} FROM requests0",
    "verdicts0": f"SELECT *, unnest([0, 1]) AS rep FROM shaped",
    "verdicts1": f"SELECT {_select(VERDICT)} FROM verdicts0 WHERE {VERDICT_FILTER}",
    "verdicts": (
        "SELECT * EXCLUDE (signals, patterns), string_split(signals, ',') AS key_signals,"
        " string_split(patterns, ',') AS patterns FROM verdicts1"
    ),
    "disputes": f"SELECT {_select(DISPUTE)} FROM shaped WHERE {DISPUTED}",
    "parties": f"SELECT {_select(PARTY)} FROM customer WHERE {PARTY_FILTER}",
    "devices0": "SELECT c_custkey, unnest([0, 1, 2]) AS j FROM customer",
    "devices": f"SELECT {_select(DEVICE)} FROM devices0",
    "merchants": f"SELECT {_select(MERCHANT)} FROM supplier WHERE {MERCHANT_FILTER}",
    "mandates0": "SELECT *, epoch_us(o_orderdate) AS order_us FROM orders",
    "mandates": f"SELECT {_select(MANDATE)} FROM mandates0",
}


def oracle_with(body: str, **ctes: str) -> str:
    """Prefix ``body`` with the derived tables and the query's own CTEs it needs."""
    known = {**_ORACLE_TABLES, **ctes}
    import re

    needed: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", todo.pop()))
        for name in known.keys() & words - needed:
            needed.add(name)
            todo.append(known[name])
    parts = [f"{name} AS ({known[name]})" for name in known if name in needed]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
