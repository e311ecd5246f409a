"""Fraud typologies as detection jobs.

Each detector returns hits: ``(detector, entity_id, txn_id, start_us, ts_us,
amount, peak)``, one row per payment that completes or belongs to the pattern.
``alerts`` folds hits into one row per entity. All widths are microseconds; the
defaults follow the published signatures, and every threshold is a parameter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paywarden.operators.scan import MAX_ROWS_PER_TASK, HotKeys, KeyCensus, Metric, find_hot_keys, key_census, prefix_scan, prefix_scans, sliding
from paywarden.session import cut_lineage

MIN_US = 60_000_000
HOUR_US = 60 * MIN_US
DAY_US = 24 * HOUR_US
ORDER = ["ts_us", "txn_id"]
HIT_COLUMNS = ("detector", "entity_id", "txn_id", "start_us", "ts_us", "amount", "peak")


def _hits(df: DataFrame, name: str, entity: str, start: Column, peak: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("detector"),
        F.col(entity).alias("entity_id"),
        "txn_id",
        start.cast("long").alias("start_us"),
        "ts_us",
        "amount",
        peak.cast("long").alias("peak"),
    )


def _hot(census: KeyCensus | None, df: DataFrame, keys: Sequence[str], order: str, max_rows: int) -> HotKeys | None:
    return find_hot_keys(df, keys, order, max_rows) if census is None else census.hot(keys)


def _trailing(
    census: KeyCensus | None, df: DataFrame, keys: Sequence[str], width: int, max_rows: int, counted: DataFrame | None = None, **kw
) -> DataFrame:
    """Trailing window including the row. ``counted`` is a cheap superset to look for hot keys in."""
    hot = _hot(census, df if counted is None else counted, keys, "ts_us", max_rows)
    return sliding(df, keys, "ts_us", "txn_id", {"w": width}, include_current=True, hot=hot, **kw)


def _scan(
    census: KeyCensus | None, df: DataFrame, keys: Sequence[str], metrics: dict[str, Metric], max_rows: int, within: Sequence[str] = (), reverse: bool = False
) -> DataFrame:
    hot = _hot(census, df, keys, "ts_us", max_rows)
    return prefix_scan(df, keys, ORDER, metrics, hot, within, reverse)


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0).cast("long")


def alerts(hits: DataFrame) -> DataFrame:
    """One row per detector and entity; evidence is JSON text."""
    return hits.groupBy("detector", "entity_id").agg(
        F.min("start_us").alias("window_start_us"),
        F.max("ts_us").alias("window_end_us"),
        F.count("*").alias("n"),
        F.sum("amount").alias("amount"),
        F.to_json(F.struct(F.max("peak").alias("peak"))).alias("evidence"),
    )


def payment_census(payments: DataFrame, max_rows: int = MAX_ROWS_PER_TASK) -> KeyCensus:
    """The hot keys of all detectors, from one count; each of them takes it as ``census``."""
    sets = [["payer_id"], ["payee_id"], ["payer_id", "payee_id"], ["merchant_id"], ["device_id"]]
    return key_census(payments, sets, max_rows, {"party": ["payer_id", "payee_id"]})


def scam_induced_push(
    payments: DataFrame, max_added_s: int = 240, width: int = 3 * HOUR_US, follow_ups: int = 2, max_rows: int = MAX_ROWS_PER_TASK, census: KeyCensus | None = None
) -> DataFrame:
    """A first payment to a fresh payee, then rising repeats under remote guidance."""
    first = F.min(F.struct("ts_us", "txn_id", "cents", "beneficiary_added_ago_s")).alias("_f")
    pair = ["payer_id", "payee_id"]
    starts = payments.groupBy(*pair).agg(first).filter(F.col("_f.beneficiary_added_ago_s") < max_added_s)
    starts = starts.select(*pair, F.col("_f.ts_us").alias("_t0"), F.col("_f.cents").alias("_c0"))
    rows = payments.join(starts, pair).filter(F.col("ts_us") <= F.col("_t0") + width)
    coerced = F.col("call_active_during_txn") | F.col("screen_share_active")
    found = (
        rows.groupBy(*pair)
        .agg(
            (F.count("*") - 1).alias("_n"),
            F.bool_or(coerced).alias("_coerced"),
            F.max_by("cents", F.struct(*ORDER)).alias("_last"),
            F.max("_c0").alias("_first"),
        )
        .filter((F.col("_n") >= follow_ups) & F.col("_coerced") & (F.col("_last") > F.col("_first")))
    )
    return _hits(rows.join(found.select(*pair, "_n"), pair), "scam_induced_push", "payer_id", F.col("_t0"), F.col("_n"))


def mule_network(
    payments: DataFrame, payers: int = 3, fan_in: int = HOUR_US, forward: int = DAY_US, share: float = 0.8, max_rows: int = MAX_ROWS_PER_TASK, census: KeyCensus | None = None
) -> DataFrame:
    """A payee with many payers in a short time that passes most of it on."""
    c = F.col
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(c("payee_id").alias("party"), c("payer_id").alias("other"), c("cents").alias("in"), zero.alias("out")),
        F.struct(c("payer_id").alias("party"), F.lit(None).cast("string").alias("other"), zero.alias("in"), c("cents").alias("out")),
    )
    timeline = (
        payments.filter(c("payer_id") != c("payee_id"))
        .select("txn_id", "ts_us", "amount", F.explode(sides).alias("_s"))
        .select("txn_id", "ts_us", "amount", "_s.*")
        .withColumn("_back_us", -c("ts_us"))
    )
    hot = _hot(census, timeline, ["party"], "ts_us", max_rows)
    out = sliding(
        timeline, ["party"], "ts_us", "txn_id", {"w": fan_in}, sums={"in": "in"}, distincts={"payers": "other"},
        count=None, include_current=True, hot=hot,
    )
    # Read backwards in time, the trailing window is the time after the payment.
    out = sliding(out, ["party"], "_back_us", "txn_id", {"next": forward}, sums={"out": "out"}, count=None, hot=hot)
    found = out.filter(c("other").isNotNull() & (c("payers_w") >= payers) & (c("out_next") >= c("in_w") * share))
    return _hits(found, "mule_network", "party", c("ts_us") - fan_in, c("payers_w"))


def card_testing_probe(
    payments: DataFrame, below: float = 15.0, width: int = 25 * MIN_US, n: int = 4, declined: int = 1, max_rows: int = MAX_ROWS_PER_TASK, census: KeyCensus | None = None
) -> DataFrame:
    """Bursts of tiny card-not-present payments, some declined."""
    rows = payments.filter((F.col("rail") == "card_cnp") & (F.col("amount") < below)).select(
        "txn_id", "payer_id", "ts_us", "amount", _flag(F.col("decision") == "declined").alias("declined")
    )
    out = _trailing(census, rows, ["payer_id"], width, max_rows, sums={"declined": "declined"})
    found = out.filter((F.col("count_w") >= n) & (F.col("declined_w") >= declined))
    return _hits(found, "card_testing_probe", "payer_id", F.col("ts_us") - width, F.col("count_w"))


def adversarial_evasion(
    payments: DataFrame,
    below: float = 10_000.0,
    gap: tuple[int, int] = (4 * HOUR_US, 20 * HOUR_US),
    width: int = 7 * DAY_US,
    n: int = 3,
    total: float = 20_000.0,
    max_rows: int = MAX_ROWS_PER_TASK, census: KeyCensus | None = None,
) -> DataFrame:
    """Low and slow: spaced payments to known payees, each small, together large."""
    rows = payments.select("txn_id", "payer_id", "payee_id", "ts_us", "amount", "cents")
    hot = _hot(census, rows, ["payer_id"], "ts_us", max_rows)
    rows = prefix_scans(
        rows, ["payer_id"], ORDER,
        [(("payee_id",), {"_known": Metric("sum", F.lit(1).cast("long"))}), ((), {"_prev": Metric("lag", F.col("ts_us"))})],
        hot,
    )
    since = F.col("ts_us") - F.col("_prev")
    slow = rows.filter((F.col("_known") > 0) & (F.col("amount") < below) & since.between(*gap)).drop("_known", "_prev")
    out = sliding(
        slow, ["payer_id"], "ts_us", "txn_id", {"w": width}, sums={"cents": "cents"}, include_current=True, hot=hot
    )
    found = out.filter((F.col("count_w") >= n) & (F.col("cents_w") > total * 100))
    return _hits(found, "adversarial_evasion", "payer_id", F.col("ts_us") - width, F.col("count_w"))


def first_party_dispute(
    payments: DataFrame, disputes: DataFrame, repeats: int = 1, prior: int = 1, max_rows: int = MAX_ROWS_PER_TASK, census: KeyCensus | None = None
) -> DataFrame:
    """Disputed card payments of repeat customers who have disputed before."""
    rows = payments.filter(F.col("rail") == "card_cnp").select("txn_id", "payer_id", "merchant_id", "ts_us", "amount")
    hot = _hot(census, rows, ["payer_id"], "ts_us", max_rows)
    rows = rows.join(disputes.select("txn_id", "dispute_id"), "txn_id", "left")
    rows = prefix_scan(rows, ["payer_id"], ORDER, {"_repeat": Metric("sum", F.lit(1).cast("long"))}, hot, ["merchant_id"])
    disputed = F.col("dispute_id").isNotNull()
    rows = prefix_scan(
        rows, ["payer_id"], ORDER, {"_prior": Metric("sum", _flag(disputed)), "_start": Metric("min", F.col("ts_us"), True)}, hot
    )
    found = rows.filter(disputed & (F.col("_repeat") >= repeats) & (F.col("_prior") >= prior))
    return _hits(found, "first_party_dispute", "payer_id", F.col("_start"), F.col("_prior"))


def stealth_mandate(payments: DataFrame, rises: int = 2, max_rows: int = MAX_ROWS_PER_TASK, census: KeyCensus | None = None) -> DataFrame:
    """Mandate charges of one payer-payee pair that keep rising."""
    rows = payments.filter(F.col("rail") == "upi_mandate").select("txn_id", "payer_id", "payee_id", "ts_us", "amount", "cents")
    hot = _hot(census, rows, ["payer_id"], "ts_us", max_rows)
    rows = prefix_scan(
        rows, ["payer_id"], ORDER,
        {"_prev": Metric("last", F.col("cents")), "_pos": Metric("sum", F.lit(1).cast("long"), True)},
        hot, ["payee_id"],
    )
    rising = F.coalesce(F.col("cents") > F.col("_prev"), F.lit(False))
    rows = prefix_scan(
        rows, ["payer_id"], ORDER,
        {"_break": Metric("max", F.when(~rising, F.struct(F.col("_pos").alias("pos"), F.col("ts_us").alias("at"))), True)},
        hot, ["payee_id"],
    )
    run = F.col("_pos") - F.col("_break.pos")
    return _hits(rows.filter(run >= rises), "stealth_mandate", "payer_id", F.col("_break.at"), run)


def mandate_anomalies(mandates: DataFrame, ratio: float = 3.0) -> DataFrame:
    """Mandates with far more room than use, or re-registered after a cancellation."""
    old = mandates.select(
        F.col("mandate_id").alias("re_registered_from_mandate_id"), F.col("cancelled_us").alias("_old_cancelled")
    )
    columns = ["mandate_id", "payer_id", "max_amount", "actual_amount", "created_us"]
    # First registrations have no earlier mandate; joined, their null keys would all meet in one task.
    anew = F.col("re_registered_from_mandate_id").isNotNull()
    joined = mandates.filter(anew).join(old, "re_registered_from_mandate_id", "left").select(*columns, "_old_cancelled")
    first = mandates.filter(~anew).select(*columns, F.lit(None).cast(old.schema["_old_cancelled"].dataType).alias("_old_cancelled"))
    rows = joined.unionByName(first)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("max_amount") >= F.col("actual_amount") * ratio, "limit_far_above_charge"),
            F.when(F.col("_old_cancelled") <= F.col("created_us"), "re_registered_after_cancel"),
        )
    )
    return rows.select("mandate_id", "payer_id", F.explode(reasons).alias("reason"))


def synthetic_merchant(
    payments: DataFrame,
    merchants: DataFrame,
    age: int = 30 * DAY_US,
    width: int = DAY_US,
    new_payers: int = 5,
    curves: Sequence[str] = ("step", "spike"),
    max_rows: int = MAX_ROWS_PER_TASK, census: KeyCensus | None = None,
) -> DataFrame:
    """A young, unverified merchant with a burst of first-time payers."""
    shady = merchants.filter(
        ~F.col("kyb_docs_verified_against_registry") & F.col("volume_growth_curve").isin(list(curves))
    ).select("merchant_id", "onboarded_us")
    rows = payments.select("txn_id", "merchant_id", "payer_id", "ts_us", "amount").join(shady, "merchant_id")
    rows = rows.filter((F.col("ts_us") >= F.col("onboarded_us")) & (F.col("ts_us") <= F.col("onboarded_us") + age))
    hot = _hot(census, payments.filter(F.col("merchant_id").isNotNull()), ["merchant_id"], "ts_us", max_rows)
    rows = prefix_scan(rows, ["merchant_id"], ORDER, {"_n": Metric("sum", F.lit(1).cast("long"))}, hot, ["payer_id"])
    rows = rows.withColumn("fresh", _flag(F.col("_n") == 0)).drop("_n")
    out = sliding(rows, ["merchant_id"], "ts_us", "txn_id", {"w": width}, sums={"fresh": "fresh"}, count=None, include_current=True, hot=hot)
    found = out.filter(F.col("fresh_w") >= new_payers)
    return _hits(found, "synthetic_merchant", "merchant_id", F.col("ts_us") - width, F.col("fresh_w"))


def transaction_laundering(payments: DataFrame, merchants: DataFrame, census: KeyCensus | None = None) -> DataFrame:
    """Declared and inferred trade differ, or the money goes to someone else."""
    trade = merchants.select("merchant_id", "mcc_declared", "mcc_inferred_from_basket")
    rows = payments.filter(F.col("merchant_id").isNotNull()).join(trade, "merchant_id", "left")
    other_trade = F.coalesce(F.col("mcc_declared") != F.col("mcc_inferred_from_basket"), F.lit(False))
    other_payee = F.col("payee_id") != F.col("merchant_id")
    found = rows.filter(other_trade | other_payee)
    return _hits(found, "transaction_laundering", "merchant_id", F.col("ts_us"), _flag(other_trade) + 2 * _flag(other_payee))


def credential_takeover(payments: DataFrame, width: int = 6 * HOUR_US, repeats: int = 1, max_rows: int = MAX_ROWS_PER_TASK, census: KeyCensus | None = None) -> DataFrame:
    """A changed device far from home pays a new payee, then again."""
    rows = payments.select("txn_id", "payer_id", "payee_id", "ts_us", "amount", "device_id", "geo_matches_payer_home")
    hot = _hot(census, rows, ["payer_id"], "ts_us", max_rows)
    rows = prefix_scans(
        rows, ["payer_id"], ORDER,
        [((), {"_device": Metric("last", F.col("device_id"))}), (("payee_id",), {"_n": Metric("sum", F.lit(1).cast("long"))})],
        hot,
    )
    start = (F.col("_device") != F.col("device_id")) & ~F.col("geo_matches_payer_home") & (F.col("_n") == 0)
    rows = prefix_scan(rows, ["payer_id"], ORDER, {"_start": Metric("min", F.when(start, F.col("ts_us")), True)}, hot, ["payee_id"])
    inside = rows.filter(F.col("ts_us") <= F.col("_start") + width)
    pairs = inside.groupBy("payer_id", "payee_id").agg((F.count("*") - 1).alias("_repeats")).filter(F.col("_repeats") >= repeats)
    return _hits(inside.join(pairs, ["payer_id", "payee_id"]), "credential_takeover", "payer_id", F.col("_start"), F.col("_repeats"))


def synthetic_identity_bustout(
    payments: DataFrame, quiet: int = 3, factor: float = 5.0, within: int = 30 * DAY_US, max_rows: int = MAX_ROWS_PER_TASK, census: KeyCensus | None = None
) -> DataFrame:
    """After a few small payments the average jumps."""
    rows = payments.select("txn_id", "payer_id", "ts_us", "amount", "cents")
    hot = _hot(census, rows, ["payer_id"], "ts_us", max_rows)
    rows = prefix_scan(
        rows, ["payer_id"], ORDER,
        {"_n": Metric("sum", F.lit(1).cast("long"), True), "_start": Metric("min", F.col("ts_us"), True),
         "_all": Metric("sum", F.col("cents"), True)},
        hot,
    )
    rows = prefix_scan(
        rows, ["payer_id"], ORDER, {"_quiet": Metric("sum", F.when(F.col("_n") <= quiet, F.col("cents")).otherwise(0), True)}, hot
    )
    later = (F.col("_all") - F.col("_quiet")) / (F.col("_n") - quiet)
    ratio = F.when((F.col("_n") > quiet) & (F.col("_quiet") > 0), later / (F.col("_quiet") / quiet))
    found = rows.withColumn("_ratio", ratio).filter((F.col("_ratio") >= factor) & (F.col("ts_us") <= F.col("_start") + within))
    return _hits(found, "synthetic_identity_bustout", "payer_id", F.col("_start"), F.floor(F.col("_ratio") + 1e-9))


def subthreshold_fragmentation(
    payments: DataFrame, below: float = 100.0, width: int = 3 * HOUR_US, n: int = 4, max_rows: int = MAX_ROWS_PER_TASK, census: KeyCensus | None = None
) -> DataFrame:
    """Many small payments to one payee in a few hours."""
    rows = payments.filter(F.col("amount") < below).select("txn_id", "payer_id", "payee_id", "ts_us", "amount")
    out = _trailing(census, rows, ["payer_id", "payee_id"], width, max_rows)
    return _hits(out.filter(F.col("count_w") >= n), "subthreshold_fragmentation", "payer_id", F.col("ts_us") - width, F.col("count_w"))


def agentic_injection(payments: DataFrame, width: int = HOUR_US, n: int = 2, max_rows: int = MAX_ROWS_PER_TASK, census: KeyCensus | None = None) -> DataFrame:
    """Agent payments in a burst to a payee the payer has only just met."""
    rows = payments.select("txn_id", "payer_id", "payee_id", "ts_us", "amount", "is_agent_initiated")
    rows = _scan(census, rows, ["payer_id"], {"_met": Metric("min", F.col("ts_us"), True)}, max_rows, ["payee_id"])
    agent = rows.filter(F.col("is_agent_initiated") & (F.col("ts_us") <= F.col("_met") + width))
    out = _trailing(census, agent, ["payer_id", "payee_id"], width, max_rows, payments.filter("is_agent_initiated"))
    return _hits(out.filter(F.col("count_w") >= n), "agentic_injection", "payer_id", F.col("_met"), F.col("count_w"))


def insider_abuse(payments: DataFrame, width: int = 5 * DAY_US, n: int = 2, max_rows: int = MAX_ROWS_PER_TASK, census: KeyCensus | None = None) -> DataFrame:
    """Repeated payments pushed through without customer authentication."""
    rows = payments.filter(
        (F.col("auth_method") == "none") & ((F.col("rail") == "neft") | (F.col("channel") == "web"))
    ).select("txn_id", "payer_id", "ts_us", "amount")
    out = _trailing(census, rows, ["payer_id"], width, max_rows)
    return _hits(out.filter(F.col("count_w") >= n), "insider_abuse", "payer_id", F.col("ts_us") - width, F.col("count_w"))


def device_fan_out(payments: DataFrame, width: int = 2 * HOUR_US, payers: int = 4, max_rows: int = MAX_ROWS_PER_TASK, census: KeyCensus | None = None) -> DataFrame:
    """One device pays for many payers in a short time."""
    rows = payments.select("txn_id", "device_id", "payer_id", "ts_us", "amount")
    out = _trailing(census, rows, ["device_id"], width, max_rows, distincts={"payers": "payer_id"}, count=None)
    return _hits(out.filter(F.col("payers_w") >= payers), "device_fan_out", "device_id", F.col("ts_us") - width, F.col("payers_w"))


def balance_drain_exit(payments: DataFrame, width: int = 5 * MIN_US, band: tuple[float, float] = (0.85, 0.95), census: KeyCensus | None = None) -> DataFrame:
    """Most of an incoming payment leaves within ``width`` to a third party not paid before.

    Every incoming payment of the window counts, the latest one inside the band
    giving the evidence. Incoming payments are joined on party, time bucket and
    amount bucket (one step of the band's ratio), so only pairs near the band form
    and a busy party is dealt out by its times and amounts.
    """
    c = F.col
    step = math.log(band[1] / band[0])
    moved = payments.filter((c("payer_id") != c("payee_id")) & (c("cents") > 0)).select(
        "txn_id", "payer_id", "payee_id", "ts_us", "amount", "cents", F.log(c("cents").cast("double")).alias("_ln"),
        F.floor(c("ts_us") / width).alias("_t"),
    )
    came = moved.select(
        c("payee_id").alias("party"), c("payer_id").alias("_from"), c("ts_us").alias("_in_ts"), c("txn_id").alias("_in_txn"),
        c("cents").alias("_in_cents"), "_t", F.floor(c("_ln") / step).alias("_a"),
    )
    first = payments.groupBy("payer_id", "payee_id").agg(F.min(F.struct("ts_us", "txn_id")).alias("_first"))
    left = moved.join(first, ["payer_id", "payee_id"]).filter(c("_first.txn_id") == c("txn_id"))
    low, high = (F.floor((c("_ln") - math.log(x)) / step + e) for x, e in ((band[1], -1e-9), (band[0], 1e-9)))
    left = left.withColumn("_t", F.explode(F.array(c("_t"), c("_t") - 1))).withColumn("_a", F.explode(F.sequence(low, high)))
    share = c("cents") / c("_in_cents")
    pairs = left.withColumnRenamed("payer_id", "party").join(came, ["party", "_t", "_a"]).filter(
        (c("_in_ts") <= c("ts_us")) & (c("ts_us") - c("_in_ts") <= width) & share.between(*band) & (c("payee_id") != c("_from"))
    )
    found = pairs.groupBy("txn_id", "party", "ts_us", "amount", "cents").agg(
        F.max(F.struct("_in_ts", "_in_txn", "_in_cents")).alias("_in")
    )
    part = c("cents") / c("_in._in_cents")
    return _hits(found, "balance_drain_exit", "party", c("_in._in_ts"), F.floor(part * 100 + 1e-9))


def tpap_account_switch(payments: DataFrame, width: int = 40 * MIN_US, n: int = 3, max_rows: int = MAX_ROWS_PER_TASK, census: KeyCensus | None = None) -> DataFrame:
    """A payer hops across apps and linked accounts."""
    handle = F.when(
        (F.col("tpap_app") != "") & (F.col("linked_account_id") != ""), F.concat_ws("/", "tpap_app", "linked_account_id")
    )
    rows = payments.select("txn_id", "payer_id", "ts_us", "amount", handle.alias("handle"))
    out = _trailing(census, rows, ["payer_id"], width, max_rows, distincts={"handles": "handle"}, count=None)
    return _hits(out.filter(F.col("handles_w") >= n), "tpap_account_switch", "payer_id", F.col("ts_us") - width, F.col("handles_w"))


def scorecard(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Per detector and detectability: hits, fraud among them, and recall of its own family."""
    level = F.coalesce("detectable_at", F.lit("none")).alias("detectable_at")
    flagged = hits.select("detector", "txn_id").distinct().join(
        labels.select("txn_id", "is_fraud", "attack_id", level), "txn_id", "left"
    )
    found = flagged.groupBy("detector", F.coalesce("detectable_at", F.lit("none")).alias("detectable_at")).agg(
        F.count("*").alias("n_hits"),
        F.count_if(F.coalesce("is_fraud", F.lit(False))).alias("n_fraud"),
        F.count_if(F.col("attack_id") == F.col("detector")).alias("n_own"),
    )
    own = labels.filter(F.col("attack_id").isNotNull()).groupBy(F.col("attack_id").alias("detector"), level).agg(
        F.count("*").alias("n_labelled")
    )
    out = found.join(own, ["detector", "detectable_at"], "full_outer").fillna(0, ["n_hits", "n_fraud", "n_own", "n_labelled"])
    return out.select(
        "*",
        F.when(F.col("n_hits") > 0, F.col("n_fraud") / F.col("n_hits")).alias("precision"),
        F.when(F.col("n_labelled") > 0, F.col("n_own") / F.col("n_labelled")).alias("recall"),
    )


def all_hits(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# -- counterparties and matched controls ---------------------------------------------------


def counterparties(payments: DataFrame) -> DataFrame:
    return payments.groupBy("payer_id", "payee_id").agg(F.count("*").alias("n"))


def top_counterparty(payments: DataFrame) -> DataFrame:
    """The payee a payer pays most often; of equal ones the largest id."""
    best = counterparties(payments).groupBy("payer_id").agg(F.max(F.struct("n", "payee_id")).alias("_b"))
    return best.select("payer_id", "_b.payee_id", "_b.n")


def prior_merchants(payments: DataFrame, merchants: DataFrame) -> DataFrame:
    """Distinct merchants each payer has paid."""
    known = merchants.select(F.col("merchant_id").alias("payee_id"))
    return payments.select("payer_id", "payee_id").distinct().join(known, "payee_id", "left_semi")


def _nearest_control(rows: DataFrame, keys: list[str], band: tuple[float, float], hot: HotKeys | None, other_payee: bool = True) -> DataFrame:
    """Adds ``m``, the legitimate row of the key with another payee whose amount is in the band and nearest.

    Rows are put in amount order and each reads the last legitimate row before and
    after it, and the last that pays someone else than that one; of equally near
    rows the lower one counts. Where a key has one payee, ``other_payee`` is false and
    nobody else is looked for. Legitimate rows that no fraud amount of their key can
    reach are left out before the rows are ordered.
    """
    c = F.col
    order = ["cents", "txn_id"]
    # One row a key with fraud; keys without any drop out.
    reach = rows.filter("is_fraud").groupBy(*keys).agg(
        (F.min("cents") * band[0]).alias("_from"), (F.max("cents") * band[1]).alias("_to")
    )
    rows = rows.join(reach, keys).filter(c("is_fraud") | c("cents").between(c("_from"), c("_to"))).drop("_from", "_to")
    legit = ~c("is_fraud")
    me = F.struct("cents", "txn_id", "payee_id")
    for side, reverse in (("lo", False), ("hi", True)):
        rows = prefix_scan(rows, keys, order, {f"_{side}": Metric("last", F.when(legit, me))}, hot, reverse=reverse)
        if other_payee:
            # Follows on the order of the scan before it, so nothing is exchanged or sorted again.
            other = F.when(legit & (c(f"_{side}.payee_id") != c("payee_id")), c(f"_{side}"))
            rows = prefix_scan(rows, keys, order, {f"_{side}_other": Metric("last", other)}, hot, reverse=reverse)

    def inside(side: str) -> Column:
        near = F.when(c(f"_{side}.payee_id") != c("not_payee"), c(f"_{side}"))
        if other_payee:
            near = near.otherwise(c(f"_{side}_other"))
        return F.when(near["cents"].between(c("cents") * band[0], c("cents") * band[1]), near)

    found = rows.filter("is_fraud").select("*", inside("lo").alias("lo"), inside("hi").alias("hi"))
    nearer_low = c("hi").isNull() | (c("cents") - c("lo.cents") <= c("hi.cents") - c("cents"))
    picked = F.when(c("lo").isNotNull() & nearer_low, c("lo")).otherwise(c("hi"))
    return found.select("txn_id", "campaign_id", "rail", "channel", "mcc", "not_payee", "cents", picked.alias("m")).filter("m IS NOT NULL")


def matched_controls(
    payments: DataFrame,
    labels: DataFrame,
    band: tuple[float, float] = (0.55, 1.15),
    payees_per_campaign: int = 3,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """A legitimate look-alike for each fraud payment, from at most a few payees per campaign.

    The control has the same rail, channel and trade, another payee, an amount
    inside ``band`` and, among those, the nearest one (the lower of two equally
    near). A campaign keeps the payees that most of its nearest controls pay; a
    fraud payment whose nearest control pays another one takes the nearest of the
    kept payees, if one is inside the band. No candidate pairs are formed.
    """
    c = F.col
    rows = payments.select("txn_id", "rail", "channel", F.coalesce("mcc", F.lit(-1)).alias("mcc"), "payee_id", "cents").join(
        labels.select("txn_id", "is_fraud", "campaign_id"), "txn_id"
    )
    keys = ["rail", "channel", "mcc"]
    rows = rows.filter(~c("is_fraud") | c("campaign_id").isNotNull()).withColumn("not_payee", c("payee_id"))
    hot = find_hot_keys(rows, keys, "cents", max_rows)
    # Read four times below, and no more than one row per fraud payment.
    picked = cut_lineage(_nearest_control(rows, keys, band, hot))
    w = Window.partitionBy("campaign_id").orderBy(c("_n").desc(), "payee_id")
    kept = (
        picked.groupBy("campaign_id", c("m.payee_id").alias("payee_id")).agg(F.count("*").alias("_n"))
        .withColumn("_i", F.row_number().over(w)).filter(c("_i") <= payees_per_campaign).select("campaign_id", "payee_id")
    )
    asked = picked.drop("m", "payee_id").join(kept, "campaign_id").filter(c("payee_id") != c("not_payee"))
    allowed = rows.filter(~c("is_fraud")).join(kept.select("payee_id").distinct(), "payee_id", "left_semi")
    both = allowed.unionByName(asked.withColumn("is_fraud", F.lit(True)))
    # Inside the key of a payee every control pays that payee, so no other one is looked for.
    hot_payee = find_hot_keys(allowed, [*keys, "payee_id"], "cents", max_rows)
    again = _nearest_control(both, [*keys, "payee_id"], band, hot_payee, other_payee=False)
    best = F.min(F.struct(F.abs(c("m.cents") - c("cents")).alias("far"), (c("m.cents") > c("cents")).alias("above"), "m"))
    return again.groupBy("txn_id", "campaign_id").agg(best.alias("_b")).select(
        "txn_id", "campaign_id", c("_b.m.txn_id").alias("control_txn_id"), c("_b.m.payee_id").alias("control_payee_id")
    )
