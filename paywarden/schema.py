"""The eight payment tables, their closed vocabularies and the feature lists."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

_TYPES = {
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
    "money": MONEY,
}


def _schema(text: str) -> T.StructType:
    """``name type`` pairs, one per line; a trailing ``?`` marks a nullable field."""
    fields = []
    for line in text.split("\n"):
        if line.strip():
            name, kind = line.split()
            fields.append(T.StructField(name, _TYPES[kind.rstrip("?")], kind.endswith("?")))
    return T.StructType(fields)


TRANSACTIONS = _schema("""
txn_id string
timestamp timestamp
rail string
channel string
direction string
payer_id string
payee_id string
merchant_id string?
amount money
currency string
amount_is_round bool
mcc int?
purpose_code string?
auth_method string
auth_result string
auth_latency_ms int?
eci string?
liability_shift bool?
exemption_claimed string?
decision string
decline_reason string?
issuer_risk_score double
device_id string
device_is_known_for_payer bool
session_id string
session_duration_s int
time_on_confirm_screen_s double
beneficiary_first_time bool
beneficiary_added_ago_s long
pin_attempts int
screen_share_active bool
call_active_during_txn bool
accessibility_service_active bool
paste_used_in_amount bool
is_agent_initiated bool
agent_declared_principal string?
ip_country string
ip_asn string
ip_is_proxy bool
geo_matches_billing bool?
geo_matches_payer_home bool
tpap_app string?
linked_account_id string?
""")

PARTIES = _schema("""
party_id string
party_type string
account_age_days int
kyc_level string
kyc_completed_at timestamp?
has_salary_credit bool
organic_spend_ratio double
throughput_ratio_24h double
distinct_counterparties_30d int
home_pincode string
flagged_by_ffri bool
""")

DEVICES = _schema("""
device_id string
primary_party_id string
device_type string
os_name string
os_version string
device_model string
fingerprint_hash string
is_emulator bool
is_shared_household_device bool
first_seen_at timestamp
last_seen_at timestamp
retired_at timestamp?
replaced_device_id string?
""")

MERCHANTS = _schema("""
merchant_id string
mcc_declared int
mcc_inferred_from_basket int?
onboarded_at timestamp
kyb_level string
kyb_docs_verified_against_registry bool
days_to_first_txn int
volume_growth_curve string
chargeback_rate_30d double
refund_rate_30d double
decline_rate_30d double
settlement_account_age_days int
settlement_outflow_latency_h double
""")

MANDATES = _schema("""
mandate_id string
payer_id string
merchant_id string
max_amount money
actual_amount money
frequency string
created_at timestamp
enrolled_via string
vpa_matches_biller_directory bool
pre_debit_notification_opened bool
cancelled_at timestamp?
re_registered_from_mandate_id string?
""")

DISPUTES = _schema("""
dispute_id string
txn_id string
raised_at_offset_days int
reason_code string
claimant_prior_dispute_count int
claimant_prior_dispute_rate double
device_matched_original_txn bool
ce30_evidence_available bool
""")

GRAPH_EDGES = _schema("""
src_party_id string
dst_party_id string
window_start timestamp
window_end timestamp
edge_count int
edge_value_total money
mean_inter_arrival_s double
src_out_degree int
dst_in_degree int
is_two_hop_passthrough bool
""")

LABELS = _schema("""
txn_id string
is_fraud bool
attack_id string?
campaign_id string?
pretext string?
is_legit_lookalike bool
detectable_at string?
""")

TABLES: dict[str, T.StructType] = {
    "transactions": TRANSACTIONS,
    "labels": LABELS,
    "parties": PARTIES,
    "devices": DEVICES,
    "merchants": MERCHANTS,
    "mandates": MANDATES,
    "disputes": DISPUTES,
    "graph_edges": GRAPH_EDGES,
}

# The closed vocabularies of the payment tables.
VOCABULARIES: dict[str, tuple[str, ...]] = {
    "rail": (
        "card_cnp", "card_cp", "upi_p2p", "upi_p2m", "upi_collect_merchant",
        "upi_mandate", "upi_lite", "imps", "neft", "wallet", "bnpl",
    ),
    "channel": ("web", "app", "pos", "qr_static", "qr_dynamic", "intent_link", "agent"),
    "direction": ("push", "pull"),
    "auth_method": (
        "none", "cvv_only", "3ds_frictionless", "3ds_challenge_otp",
        "3ds_challenge_biometric", "upi_pin", "lite_none", "mandate_no_afa",
    ),
    "auth_result": ("success", "failure", "abandoned", "not_attempted"),
    "exemption_claimed": ("none", "tra", "low_value", "mit", "whitelist", "delegated"),
    "decision": ("approved", "declined", "flagged_review"),
    "party_type": ("consumer", "merchant", "mule_unknown"),
    "kyc_level": ("full", "min_kyc", "video_kyc", "none"),
    "volume_growth_curve": ("organic", "step", "spike"),
    "enrolled_via": ("app", "web", "agent", "link"),
    "detectable_at": ("pre_auth", "post_auth", "post_settlement", "only_in_hindsight"),
    "device_type": ("android", "ios", "desktop", "pos_terminal", "other"),
}

# Attack families, and the severity the risk fusion gives them
# (a family without a severity counts 0.5).
ATTACK_FAMILIES = (
    "adversarial_evasion", "agentic_injection", "balance_drain_exit", "card_testing_probe",
    "credential_takeover", "device_fan_out", "first_party_dispute", "insider_abuse",
    "mule_network", "scam_induced_push", "stealth_mandate", "subthreshold_fragmentation",
    "synthetic_identity_bustout", "synthetic_merchant", "tpap_account_switch",
    "transaction_laundering",
)
ATTACK_SEVERITY = {
    "adversarial_evasion": 0.80,
    "agentic_injection": 0.85,
    "card_testing_probe": 0.60,
    "credential_takeover": 0.95,
    "first_party_dispute": 0.40,
    "insider_abuse": 0.85,
    "mule_network": 1.00,
    "scam_induced_push": 0.90,
    "stealth_mandate": 0.70,
    "subthreshold_fragmentation": 0.75,
    "synthetic_identity_bustout": 1.00,
    "synthetic_merchant": 0.85,
    "transaction_laundering": 0.85,
}
DEFAULT_SEVERITY = 0.5

# Columns that carry ground truth and must never be features.
LABEL_ONLY_COLUMNS = frozenset(
    {"is_fraud", "attack_id", "campaign_id", "pretext", "is_legit_lookalike", "detectable_at"}
)

# The model's feature vector, by kind.
CATEGORICAL_FEATURES = (
    "currency", "rail", "channel", "direction", "auth_method", "auth_result", "eci",
    "liability_shift", "exemption_claimed", "decision", "decline_reason", "ip_country", "ip_asn",
)
NUMERICAL_FEATURES = (
    "amount", "mcc", "auth_latency_ms", "session_duration_s", "time_on_confirm_screen_s",
    "beneficiary_added_ago_s", "pin_attempts", "tx_hour", "tx_dayofweek", "account_age_days",
)
BOOLEAN_FEATURES = (
    "device_is_known_for_payer", "beneficiary_first_time", "screen_share_active",
    "call_active_during_txn", "accessibility_service_active", "paste_used_in_amount",
    "is_agent_initiated", "ip_is_proxy", "geo_matches_billing", "geo_matches_payer_home",
)
BEHAVIORAL_FEATURES = (
    "txn_count_last_1h", "txn_count_last_24h", "amount_spent_last_1h", "amount_spent_last_24h",
    "historical_average_amount", "amount_deviation", "time_since_prev_txn",
    "new_merchant_indicator", "new_device_indicator", "new_ip_indicator",
    "distinct_tpap_count_last_1h", "distinct_tpap_count_last_24h",
    "distinct_linked_account_count_last_1h", "distinct_linked_account_count_last_24h",
    "payee_distinct_payer_count_last_1h", "payee_distinct_payer_count_last_24h",
    "payee_txn_count_last_1h", "payee_txn_count_last_24h",
    "inter_txn_time_mean", "inter_txn_time_std", "inter_txn_time_min", "inter_txn_time_max",
    "txn_burstiness", "active_days_count", "active_hours_count", "txns_per_active_day",
    "amount_std", "amount_cv", "subthreshold_txn_ratio", "aggregate_to_threshold_ratio",
    "amount_concentration", "unique_payee_count", "merchant_diversity", "same_payee_ratio",
    "merchant_txn_ratio", "beneficiary_reuse_ratio", "txn_regularity", "mandate_txn_ratio",
    "mean_beneficiary_added_ago", "max_beneficiary_added_ago", "agent_txn_ratio",
    "agent_txn_burstiness", "time_since_prev_agent_txn",
)
GRAPH_FEATURES = (
    "payer_out_degree", "payee_in_degree", "edge_count", "edge_value_total",
    "is_two_hop_passthrough",
)
ALL_FEATURES = (
    CATEGORICAL_FEATURES + NUMERICAL_FEATURES + BOOLEAN_FEATURES + BEHAVIORAL_FEATURES + GRAPH_FEATURES
)
