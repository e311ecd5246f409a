"""Point-in-time behavioural and graph features of each payment.

Rows are ordered by ``(ts_us, txn_id)`` within a payer or payee. Trailing-window
features leave the row itself out and include earlier rows at the same instant;
history features either stop before the row or include it, as each one says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.operators.graph import forwarding_times, graph_edges
from paywarden.operators.scan import MAX_ROWS_PER_TASK, HotKeys, Metric, count_keys, in_lanes, prefix_scan, prefix_scans, sliding, spread_tasks

HOUR_US = 3_600_000_000
WINDOWS = {"last_1h": HOUR_US, "last_24h": 24 * HOUR_US}
# Stand-ins for "never before", and the two amount thresholds.
NEVER_S = 999_999.0
SUBTHRESHOLD = 100.0
AGGREGATE_THRESHOLD = 10_000.0
# A payment's features pass seven sorts of wide rows in one task, some 3.4 kB a row in all.
MAX_FEATURE_ROWS_PER_TASK = 600_000


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def _spread(df: DataFrame, key: str, tasks: int, hot: HotKeys | None) -> DataFrame:
    """One exchange on the key that all later windows of the key can use; hot keys are dealt by their scans."""
    return df if hot else df.repartition(tasks, key)


def calendar_features(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """Hour of day and day of week (Monday is 0) on the wall clock of ``tz``."""
    local = F.from_utc_timestamp(F.timestamp_micros("ts_us"), tz)
    return df.withColumns({"tx_hour": F.hour(local), "tx_dayofweek": F.weekday(local)})


def payer_velocity(
    df: DataFrame, max_rows: int = MAX_FEATURE_ROWS_PER_TASK, counted: DataFrame | None = None
) -> DataFrame:
    """Counts, spend and distinct apps / accounts of the payer in the last 1 h and 24 h.

    ``counted`` is where hot keys are looked for; give the source rows when ``df``
    is costly to derive.
    """
    tasks, hot = count_keys(df if counted is None else counted, ["payer_id"], "ts_us", max_rows)
    return in_lanes(_spread(df, "payer_id", tasks, hot), hot, _payer_velocity)


def _payer_velocity(df: DataFrame, hot: HotKeys | None) -> DataFrame:
    out = sliding(
        df,
        ["payer_id"],
        "ts_us",
        "txn_id",
        WINDOWS,
        sums={"amount_spent": "cents"},
        distincts={
            "distinct_tpap_count": "tpap_app",
            "distinct_linked_account_count": "linked_account_id",
        },
        count="txn_count",
        hot=hot,
    )
    casts = {f"amount_spent_{w}": F.col(f"amount_spent_{w}") / 100.0 for w in WINDOWS}
    for name in ("txn_count", "distinct_tpap_count", "distinct_linked_account_count"):
        casts.update({f"{name}_{w}": F.col(f"{name}_{w}").cast("double") for w in WINDOWS})
    return out.withColumns(casts)


def payee_velocity(df: DataFrame, max_rows: int = MAX_FEATURE_ROWS_PER_TASK) -> DataFrame:
    """Payments and distinct payers of the payee in the last 1 h and 24 h; blank payee gives 0."""
    # Blank payees do not form one group: each gets a key of its own.
    key = F.when(_filled("payee_id"), F.col("payee_id")).otherwise(F.concat(F.lit("\0"), "txn_id"))
    keyed = df.withColumn("_payee", key)
    tasks, hot = count_keys(keyed, ["_payee"], "ts_us", max_rows)
    out = sliding(
        _spread(keyed, "_payee", tasks, hot),
        ["_payee"],
        "ts_us",
        "txn_id",
        WINDOWS,
        distincts={"payee_distinct_payer_count": "payer_id"},
        count="payee_txn_count",
        hot=hot,
    )
    names = [f"{n}_{w}" for n in ("payee_distinct_payer_count", "payee_txn_count") for w in WINDOWS]
    return out.withColumns({n: F.col(n).cast("double") for n in names}).drop("_payee")


def payer_history(
    df: DataFrame,
    tz: str = "UTC",
    merchant_column: str = "payee_id",
    max_rows: int = MAX_FEATURE_ROWS_PER_TASK,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Lifetime features of the payer, up to and where stated including the row.

    ``merchant_column`` decides which payments count for ``merchant_txn_ratio``:
    the published feature reads the payee and is therefore 1 whenever a payee is
    set; ``merchant_id`` gives the share of merchant payments.
    """
    tasks, hot = count_keys(df if counted is None else counted, ["payer_id"], "ts_us", max_rows)
    return in_lanes(_spread(df, "payer_id", tasks, hot), hot, lambda rows, h: _payer_history(rows, tz, merchant_column, h))


def _payer_history(df: DataFrame, tz: str, merchant_column: str, hot: HotKeys | None) -> DataFrame:
    keys, order = ["payer_id"], ["ts_us", "txn_id"]
    out = df.withColumn(
        "_payee_name", F.when(_filled("payee_id"), F.col("payee_id")).otherwise("unknown")
    )
    one = F.lit(1).cast("long")
    seen = (("_payee_name", "_seen_payee"), ("device_id", "_seen_device"), ("ip_asn", "_seen_ip"))
    out = prefix_scans(out, keys, order, [((column,), {name: Metric("sum", one)}) for column, name in seen], hot)

    def total(sql: str) -> Metric:
        return Metric("sum", F.expr(sql), True)

    def flag(condition: str) -> Metric:
        return total(f"CASE WHEN {condition} THEN 1L ELSE 0L END")

    out = prefix_scan(
        out,
        keys,
        order,
        {
            "_prior_n": Metric("sum", one),
            "_prior_cents": Metric("sum", F.col("cents")),
            "_prev_us": Metric("lag", F.col("ts_us")),
            "_prev_agent_us": Metric("max", F.expr("CASE WHEN is_agent_initiated THEN ts_us END")),
            "_hours": Metric("bit_or", F.expr(f"shiftleft(1, hour(from_utc_timestamp(timestamp_micros(ts_us), '{tz}')))"), True),
            "_amount": Metric("moments", F.expr("cast(amount as double)"), True),
            "_sum": total("cents"),
            "_squares": total("cast(amount as double) * cast(amount as double)"),
            "_small": flag(f"cast(amount as double) < {SUBTHRESHOLD}D"),
            "_payees": flag("_seen_payee = 0"),
            "_top_payee": Metric("max", F.expr("_seen_payee + 1"), True),
            "_merchant": flag(f"{merchant_column} IS NOT NULL AND cast({merchant_column} as string) <> ''"),
            "_reuse": flag("NOT beneficiary_first_time"),
            "_mandate": flag("rail = 'upi_mandate'"),
            "_added": total("beneficiary_added_ago_s"),
            "_added_max": Metric("max", F.col("beneficiary_added_ago_s"), True),
            "_agent": flag("is_agent_initiated"),
        },
        hot,
    )

    def wall(us: str) -> str:
        return f"from_utc_timestamp(timestamp_micros({us}), '{tz}')"

    new_day = f"_prev_us IS NULL OR to_date({wall('_prev_us')}) <> to_date({wall('ts_us')})"
    gap = "(ts_us - _prev_us) / 1e6D"
    out = prefix_scan(
        out,
        keys,
        order,
        {
            "_gap": Metric("moments", F.expr(gap), True),
            "_gap_min": Metric("min", F.expr(gap), True),
            "_gap_max": Metric("max", F.expr(gap), True),
            "_days": Metric("sum", F.expr(f"CASE WHEN {new_day} THEN 1L ELSE 0L END"), True),
            "_agap": Metric("moments", F.expr("CASE WHEN is_agent_initiated THEN (ts_us - _prev_agent_us) / 1e6D END"), True),
        },
        hot,
    )
    never = f"{NEVER_S}D"
    gap_mean = f"CASE WHEN _gap_n > 0 THEN _gap_mean ELSE {never} END"
    gap_std = "CASE WHEN _gap_n > 0 THEN sqrt(_gap_var) ELSE 0D END"
    average = "CASE WHEN _prior_n = 0 THEN 0D ELSE _prior_cents / 100D / _prior_n END"

    def filled(c: str) -> str:
        return f"{c} IS NOT NULL AND cast({c} as string) <> ''"

    def burst(std: str, mean: str) -> str:
        return f"CASE WHEN ({std}) + ({mean}) > 0 THEN (({std}) - ({mean})) / (({std}) + ({mean})) ELSE 0D END"

    def share(count: str) -> str:
        return f"cast({count} as double) / (_prior_n + 1)"

    def first_seen(column: str, seen: str) -> str:
        return f"CASE WHEN {filled(column)} AND {seen} = 0 THEN 1D ELSE 0D END"

    features = {
        "historical_average_amount": average,
        "amount_deviation": f"CASE WHEN _prior_n = 0 THEN 0D ELSE abs(cast(amount as double) - ({average})) END",
        "time_since_prev_txn": f"coalesce({gap}, {never})",
        "new_merchant_indicator": first_seen("payee_id", "_seen_payee"),
        "new_device_indicator": first_seen("device_id", "_seen_device"),
        "new_ip_indicator": first_seen("ip_asn", "_seen_ip"),
        "inter_txn_time_mean": gap_mean,
        "inter_txn_time_std": gap_std,
        "inter_txn_time_min": f"coalesce(_gap_min, {never})",
        "inter_txn_time_max": f"coalesce(_gap_max, {never})",
        "txn_burstiness": burst(gap_std, gap_mean),
        "active_days_count": "cast(_days as double)",
        "active_hours_count": "cast(bit_count(_hours) as double)",
        "txns_per_active_day": "cast(_prior_n + 1 as double) / _days",
        "amount_std": "sqrt(_amount_var)",
        "amount_cv": "CASE WHEN _amount_mean > 0 THEN sqrt(_amount_var) / _amount_mean ELSE 0D END",
        "subthreshold_txn_ratio": share("_small"),
        "aggregate_to_threshold_ratio": f"_sum / 100D / {AGGREGATE_THRESHOLD}D",
        "amount_concentration": "CASE WHEN _sum > 0 THEN _squares / ((_sum / 100D) * (_sum / 100D)) ELSE 1D END",
        "unique_payee_count": "cast(_payees as double)",
        "merchant_diversity": share("_payees"),
        "same_payee_ratio": share("_top_payee"),
        "merchant_txn_ratio": share("_merchant"),
        "beneficiary_reuse_ratio": share("_reuse"),
        "txn_regularity": f"CASE WHEN ({gap_mean}) > 0 THEN ({gap_std}) / ({gap_mean}) ELSE 0D END",
        "mandate_txn_ratio": share("_mandate"),
        "mean_beneficiary_added_ago": share("_added"),
        "max_beneficiary_added_ago": "cast(_added_max as double)",
        "agent_txn_ratio": share("_agent"),
        "agent_txn_burstiness": f"CASE WHEN _agap_n > 0 THEN {burst('sqrt(_agap_var)', '_agap_mean')} ELSE 0D END",
        "time_since_prev_agent_txn": f"coalesce((ts_us - _prev_agent_us) / 1e6D, {never})",
    }
    return out.selectExpr(*[f"`{c}`" for c in df.columns], *[f"{sql} AS {name}" for name, sql in features.items()])


HISTORY_INPUT = (
    "txn_id", "payer_id", "payee_id", "merchant_id", "ts_us", "amount", "cents", "device_id", "ip_asn",
    "rail", "is_agent_initiated", "beneficiary_first_time", "beneficiary_added_ago_s",
)
VELOCITY_INPUT = ("txn_id", "payer_id", "ts_us", "cents", "tpap_app", "linked_account_id")


def behavioural_features(
    payments: DataFrame,
    tz: str = "UTC",
    merchant_column: str = "payee_id",
    max_rows: int = MAX_FEATURE_ROWS_PER_TASK,
) -> DataFrame:
    """All 43 behavioural features next to the payment's own columns.

    Two exchanges of the rows, one on the payee and one on the payer.
    """
    out = payee_velocity(payments, max_rows)
    tasks, hot = count_keys(payments, ["payer_id"], "ts_us", max_rows)
    out = _spread(out, "payer_id", tasks, hot)
    return in_lanes(out, hot, lambda rows, h: _payer_history(_payer_velocity(rows, h), tz, merchant_column, h))


def with_account_age(df: DataFrame, parties: DataFrame) -> DataFrame:
    """Account age of the payer; unknown payers keep null."""
    ages = parties.select(F.col("party_id").alias("payer_id"), "account_age_days")
    return df.join(ages, "payer_id", "left")


def with_graph_features(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Whole-window graph lookups. They see later payments: offline use only."""
    out_degree = edges.groupBy(F.col("src_party_id").alias("payer_id")).agg(
        F.max("src_out_degree").cast("double").alias("payer_out_degree")
    )
    in_degree = edges.groupBy(F.col("dst_party_id").alias("payee_id")).agg(
        F.max("dst_in_degree").cast("double").alias("payee_in_degree")
    )
    pair = edges.select(
        F.col("src_party_id").alias("payer_id"),
        F.col("dst_party_id").alias("payee_id"),
        F.col("edge_count").cast("double").alias("edge_count"),
        F.col("edge_value_total").cast("double").alias("edge_value_total"),
        F.col("is_two_hop_passthrough").cast("double").alias("is_two_hop_passthrough"),
    )
    names = ["payer_out_degree", "payee_in_degree", "edge_count", "edge_value_total", "is_two_hop_passthrough"]
    return (
        df.join(pair, ["payer_id", "payee_id"], "left")
        .join(out_degree, "payer_id", "left")
        .join(in_degree, "payee_id", "left")
        .fillna(0.0, names)
    )


def asof_graph_features(
    df: DataFrame, passthrough_us: int = 24 * HOUR_US, max_rows: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """The five graph features from the history before each payment only."""
    order = ["ts_us", "txn_id"]
    one = F.lit(1).cast("long")
    first = F.when(F.col("_n") == 0, 1).otherwise(0).cast("long")

    def of_payee(rows: DataFrame, hot: HotKeys | None) -> DataFrame:
        out = prefix_scan(rows, ["payee_id"], order, {"_n": Metric("sum", one)}, hot, within=["payer_id"])
        return prefix_scan(out, ["payee_id"], order, {"_in": Metric("sum", first)}, hot)

    def of_payer(rows: DataFrame, hot: HotKeys | None) -> DataFrame:
        out = prefix_scan(rows, ["payer_id"], order, {"_value": Metric("sum", F.col("cents"))}, hot, within=["payee_id"])
        return prefix_scan(out, ["payer_id"], order, {"_out": Metric("sum", first)}, hot)

    tasks, hot = count_keys(df, ["payee_id"], "ts_us", max_rows)
    out = in_lanes(_spread(df, "payee_id", tasks, hot), hot, of_payee)
    tasks, hot = count_keys(df, ["payer_id"], "ts_us", max_rows)
    out = in_lanes(_spread(out, "payer_id", tasks, hot), hot, of_payer)
    known = (
        forwarding_times(df, passthrough_us, max_rows=max_rows)
        .groupBy("payer_id", "payee_id")
        .agg(F.min("forwarded_us").alias("_known_us"))
        .filter(F.col("_known_us").isNotNull())
    )
    out = out.join(known, ["payer_id", "payee_id"], "left")
    return out.select(
        *df.columns,
        F.col("_out").cast("double").alias("payer_out_degree"),
        F.col("_in").cast("double").alias("payee_in_degree"),
        F.col("_n").cast("double").alias("edge_count"),
        (F.col("_value") / 100.0).alias("edge_value_total"),
        F.coalesce((F.col("_known_us") < F.col("ts_us")).cast("double"), F.lit(0.0)).alias(
            "is_two_hop_passthrough"
        ),
    )


def with_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach ground truth; a payment without a label is not fraud."""
    return df.join(labels, "txn_id", "left").fillna(False, ["is_fraud", "is_legit_lookalike"])


def feature_frame(
    payments: DataFrame,
    parties: DataFrame,
    labels: DataFrame,
    edges: DataFrame | None = None,
    tz: str = "UTC",
    max_rows: int = MAX_FEATURE_ROWS_PER_TASK,
) -> DataFrame:
    """The full training frame: the 81 features plus labels.

    Graph features come from history unless whole-window ``edges`` are given.
    """
    # Behaviour first: hot keys are then looked for in the source rows.
    out = behavioural_features(payments, tz, max_rows=max_rows)
    if edges is not None:
        return with_labels(with_account_age(calendar_features(with_graph_features(out, edges), tz), parties), labels)
    graph = asof_graph_features(payments.select("txn_id", "payer_id", "payee_id", "ts_us", "amount", "cents"), max_rows=max_rows)
    graph = graph.drop("payer_id", "payee_id", "ts_us", "amount", "cents")
    columns = [*(c for c in out.columns if c not in ("txn_id", "payer_id")), *(c for c in graph.columns if c != "txn_id")]
    # The age is joined while the rows lie by payer, so that the wide rows are exchanged once, for the joins on txn_id.
    aged = with_account_age(out, parties)
    tasks = spread_tasks(payments.sparkSession, payments.count())
    joined = aged.repartition(tasks, "txn_id").join(graph.repartition(tasks, "txn_id"), "txn_id")
    joined = calendar_features(joined, tz).select(*dict.fromkeys(["txn_id", "payer_id", *columns, "tx_hour", "tx_dayofweek", "account_age_days"]))
    return with_labels(joined, labels)


__all__ = [
    "asof_graph_features", "behavioural_features", "calendar_features", "feature_frame", "graph_edges",
    "payee_velocity", "payer_history", "payer_velocity", "with_account_age", "with_graph_features",
    "with_labels",
]
