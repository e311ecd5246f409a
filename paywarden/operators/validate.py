"""Data checks. Each returns the violating rows; an empty result means the check holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paywarden.schema import LABEL_ONLY_COLUMNS, VOCABULARIES


def _explode_rules(df: DataFrame, id_column: str, rules: Mapping[str, Column], name: str) -> DataFrame:
    """One pass over the rows; one output row per broken rule."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()]))
    return df.select(id_column, F.explode(broken).alias(name))


def vocabulary_violations(
    df: DataFrame, id_column: str, vocabularies: Mapping[str, Sequence[str]] = VOCABULARIES
) -> DataFrame:
    """Values outside their closed vocabulary, as (id, column, value)."""
    checks = [
        F.when(
            F.col(c).isNotNull() & ~F.col(c).isin(list(allowed)),
            F.struct(F.lit(c).alias("column"), F.col(c).alias("value")),
        )
        for c, allowed in vocabularies.items()
        if c in df.columns
    ]
    return df.select(id_column, F.explode(F.array_compact(F.array(*checks))).alias("_v")).select(
        id_column, "_v.*"
    )


def transaction_rules(baseline: bool = True) -> dict[str, Column]:
    """Row invariants of a payment; ``baseline`` adds those of attack-free traffic."""
    c = F.col
    declined = c("decision") == "declined"
    rules = {
        "non_positive_amount": c("amount") <= 0,
        "unexpected_currency": c("currency") != "INR",
        "p2p_with_mcc": c("merchant_id").isNull() & c("mcc").isNotNull(),
        "payee_is_not_merchant": c("merchant_id").isNotNull() & (c("payee_id") != c("merchant_id")),
        "payer_equals_payee": c("payer_id") == c("payee_id"),
        "pin_without_latency": (c("auth_method") == "upi_pin") & c("auth_latency_ms").isNull(),
        "latency_without_auth": (c("auth_method") == "none") & c("auth_latency_ms").isNotNull(),
        "failed_auth_not_declined": (c("auth_result") == "failure") & ~declined,
        "declined_without_reason": declined & c("decline_reason").isNull(),
        "reason_without_decline": ~declined & c("decline_reason").isNotNull(),
        "negative_beneficiary_age": c("beneficiary_added_ago_s") < 0,
        "non_positive_session": (c("session_duration_s") <= 0) | (c("time_on_confirm_screen_s") <= 0),
        "negative_pin_attempts": c("pin_attempts") < 0,
    }
    if baseline:
        rules["agent_traffic"] = c("is_agent_initiated") | c("agent_declared_principal").isNotNull()
    return rules


def transaction_violations(payments: DataFrame, baseline: bool = True) -> DataFrame:
    return _explode_rules(payments, "txn_id", transaction_rules(baseline), "rule")


def baseline_label_violations(labels: DataFrame) -> DataFrame:
    """Labels of attack-free data must carry no attack at all."""
    c = F.col
    return _explode_rules(
        labels,
        "txn_id",
        {
            "is_fraud": c("is_fraud"),
            "attack_metadata": c("attack_id").isNotNull() | c("campaign_id").isNotNull() | c("pretext").isNotNull(),
            "lookalike": c("is_legit_lookalike"),
            "invalid_detectable_at": c("detectable_at").isNotNull()
            & ~c("detectable_at").isin(list(VOCABULARIES["detectable_at"])),
        },
        "rule",
    )


def attack_label_violations(labels: DataFrame, attack_id: str | None = None) -> DataFrame:
    """Labels of an attack must be complete."""
    c = F.col
    rows = labels.filter(c("attack_id").isNotNull() if attack_id is None else c("attack_id") == attack_id)
    return _explode_rules(
        rows,
        "txn_id",
        {
            "not_fraud": ~c("is_fraud"),
            "campaign_missing": c("campaign_id").isNull(),
            "pretext_missing": c("pretext").isNull(),
            "lookalike": c("is_legit_lookalike"),
            "invalid_detectable_at": c("detectable_at").isNull()
            | ~c("detectable_at").isin(list(VOCABULARIES["detectable_at"])),
        },
        "rule",
    )


def edge_violations(edges: DataFrame, start_us: int, end_us: int) -> DataFrame:
    c = F.col
    named = edges.withColumn("edge", F.concat_ws("->", "src_party_id", "dst_party_id"))
    return _explode_rules(
        named,
        "edge",
        {
            "window_order": c("window_start_us") >= c("window_end_us"),
            "outside_dataset": (c("window_start_us") < start_us) | (c("window_end_us") > end_us),
            "non_positive_value": c("edge_value_total") <= 0,
        },
        "rule",
    )


def label_columns_present(df: DataFrame) -> list[str]:
    """Ground-truth columns that leaked into a feature table."""
    return sorted(set(df.columns) & LABEL_ONLY_COLUMNS)


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def with_missing_columns(df: DataFrame, wanted: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Add absent columns as nulls (of the given type, double by default)."""
    types = wanted if isinstance(wanted, Mapping) else dict.fromkeys(wanted, "double")
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def dangling_rows(
    df: DataFrame, column: str, reference: DataFrame, reference_column: str, reason: str, id_column: str = "txn_id"
) -> DataFrame:
    """Rows whose ``column`` is set but not in the reference.

    Distinct values are checked first, so a value held by many rows is shuffled
    once per task; only the bad values meet the rows again.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    known = reference.select(F.col(reference_column).alias(column))
    bad = values.join(known, column, "left_anti")
    return df.join(bad, column, "left_semi").select(id_column, F.lit(reason).alias("reason"))


def foreign_key_violations(
    payments: DataFrame, parties: DataFrame, merchants: DataFrame, devices: DataFrame
) -> DataFrame:
    """Payments whose party, merchant or device is set but unknown.

    The references of all columns are reduced to distinct values in one pass over the
    payments and checked together; a second pass finds the rows of the bad ones.
    """
    checks = {
        "payer_id": (parties, "party_id", "invalid payer reference"),
        "payee_id": (parties, "party_id", "invalid payee reference"),
        "merchant_id": (merchants, "merchant_id", "invalid merchant reference"),
        "device_id": (devices, "device_id", "invalid device reference"),
    }

    def references(df: DataFrame, *keep: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(reason).alias("reason"), F.col(c).cast("string").alias("value")) for c, (_, _, reason) in checks.items()])
        return df.select(*keep, F.explode(pairs).alias("_r")).select(*keep, "_r.*").filter(F.col("value").isNotNull())

    known = [ref.select(F.lit(reason).alias("reason"), F.col(key).cast("string").alias("value")) for ref, key, reason in checks.values()]
    bad = references(payments).distinct().join(reduce(DataFrame.unionByName, known), ["reason", "value"], "left_anti")
    return references(payments, "txn_id").join(bad, ["reason", "value"], "left_semi").select("txn_id", "reason")


def edge_endpoint_violations(edges: DataFrame, parties: DataFrame) -> DataFrame:
    named = edges.withColumn("edge", F.concat_ws("->", "src_party_id", "dst_party_id"))
    return dangling_rows(
        named, "src_party_id", parties, "party_id", "invalid source party", "edge"
    ).unionByName(dangling_rows(named, "dst_party_id", parties, "party_id", "invalid destination party", "edge"))


def key_set_difference(left: DataFrame, right: DataFrame, key: str = "txn_id") -> DataFrame:
    """Keys that only one side has."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    return (
        a.join(b, key, "full_outer")
        .filter(F.col("_l").isNull() | F.col("_r").isNull())
        .select(key, F.when(F.col("_l").isNull(), "right_only").otherwise("left_only").alias("side"))
    )


def id_difference(left: DataFrame, right: DataFrame, key: str = "txn_id") -> DataFrame:
    """Set difference both ways with set operations."""
    a, b = left.select(key), right.select(key)
    return (
        a.subtract(b)
        .withColumn("side", F.lit("left_only"))
        .unionByName(b.subtract(a).withColumn("side", F.lit("right_only")))
    )


def attack_rows(payments: DataFrame, labels: DataFrame, attack_id: str | None = None) -> DataFrame:
    """Payments that the labels call an attack."""
    wanted = labels.filter(
        F.col("attack_id").isNotNull() if attack_id is None else F.col("attack_id") == attack_id
    )
    return payments.join(wanted.select("txn_id").distinct(), "txn_id", "left_semi")


def attack_labels_without_payment(labels: DataFrame, payments: DataFrame) -> DataFrame:
    return labels.filter(F.col("attack_id").isNotNull()).join(payments.select("txn_id"), "txn_id", "left_anti")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def ids_in_several_splits(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Ids shared by two splits, with the pair of splits in name order."""
    pairs = df.filter(F.col(split).isNotNull()).select(key, split).distinct()
    per_id = pairs.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    first = per_id.select(key, "s", F.posexplode("s").alias("i", "split_a"))
    return first.select(
        key, "split_a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("split_b")
    )


def device_activity_violations(payments: DataFrame, devices: DataFrame) -> DataFrame:
    """Payments from a device that was not active, or already retired, at that time."""
    c = F.col
    spans = devices.select("device_id", "first_seen_us", "last_seen_us", "retired_us")
    joined = payments.select("txn_id", "device_id", "ts_us").join(spans, "device_id")
    return _explode_rules(
        joined,
        "txn_id",
        {
            "device_not_active": (c("ts_us") < c("first_seen_us")) | (c("ts_us") > c("last_seen_us")),
            "device_retired": c("retired_us").isNotNull() & (c("ts_us") >= c("retired_us")),
        },
        "rule",
    )


def known_device_mismatches(payments: DataFrame, devices: DataFrame) -> DataFrame:
    """Payments whose known-device flag disagrees with the payer's own devices."""
    own = devices.select(
        F.col("primary_party_id").alias("payer_id"), "device_id", F.lit(True).alias("_own")
    ).distinct()
    owned = F.coalesce("_own", F.lit(False))
    return (
        payments.select("txn_id", "payer_id", "device_id", "device_is_known_for_payer")
        .join(own, ["payer_id", "device_id"], "left")
        .filter(F.col("device_is_known_for_payer") != owned)
        .select("txn_id", "device_is_known_for_payer", owned.alias("owned"))
    )


def device_chain_violations(devices: DataFrame) -> DataFrame:
    """A replaced device must exist and retire when its replacement is first seen."""
    old = devices.select(
        F.col("device_id").alias("replaced_device_id"),
        F.col("retired_us").alias("_old_retired"),
        F.lit(True).alias("_exists"),
    )
    joined = devices.filter(F.col("replaced_device_id").isNotNull()).join(old, "replaced_device_id", "left")
    c = F.col
    return _explode_rules(
        joined,
        "device_id",
        {
            "replaced_device_missing": c("_exists").isNull(),
            "replaced_device_not_retired": c("_exists").isNotNull() & c("_old_retired").isNull(),
            "retirement_mismatch": c("_old_retired") != c("first_seen_us"),
        },
        "rule",
    )


def first_violations(
    violations: DataFrame, rule: str | Sequence[str] = "rule", id_column: str = "txn_id", n: int = 5
) -> DataFrame:
    """The first ``n`` ids per rule; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*([rule] if isinstance(rule, str) else rule)).orderBy(id_column)
    return violations.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)
