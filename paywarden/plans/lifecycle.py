"""The four jobs of the library, composed from its operators.

``build_graph_dataset`` -> ``training_rows`` / ``train_and_evaluate`` ->
``score_requests`` -> ``retrain_with_feedback``. Each returns lazy DataFrames, apart
from the writes and model fits it is named for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden.operators import feedback, metrics, ml, profile, sampling, validate
from paywarden.operators.features import feature_frame
from paywarden.operators.graph import graph_edges
from paywarden.operators.scoring import assess, narrate
from paywarden.operators.splits import assign_split, hold_out_family, split_windows
from paywarden.schema import CATEGORICAL_FEATURES
from paywarden.session import cut_lineage
from paywarden.sources.dataset import load_dataset, manifest, with_event_time, write_report, write_table

HELD_OUT_FAMILY = "synthetic_identity_bustout"


def _edge_table(edges: DataFrame) -> DataFrame:
    return edges.withColumns(
        {"window_start": F.timestamp_micros("window_start_us"), "window_end": F.timestamp_micros("window_end_us")}
    )


def with_window_us(edges: DataFrame) -> DataFrame:
    return edges.withColumns(
        {"window_start_us": F.unix_micros("window_start"), "window_end_us": F.unix_micros("window_end")}
    )


def leakage_checks(
    tables: dict[str, DataFrame], start_us: int, end_us: int, baseline: bool = True, examples: int = 5
) -> DataFrame:
    """All data set checks as (check, rule, n, examples); only broken rules give rows."""
    payments = with_event_time(tables["transactions"])
    labels, edges = tables["labels"], with_window_us(tables["graph_edges"])
    windows = split_windows(start_us, end_us)
    devices = tables["devices"].withColumns(
        {c.replace("_at", "_us"): F.unix_micros(c) for c in ("first_seen_at", "last_seen_at", "retired_at")}
    )

    def named(check: str, df: DataFrame, rule, key: str) -> DataFrame:
        rule = F.col(rule) if isinstance(rule, str) else rule
        return df.select(F.lit(check).alias("check"), rule.alias("rule"), F.col(key).cast("string").alias("id"))

    def constant(text: str):
        return F.lit(text)

    leaked = validate.label_columns_present(tables["transactions"])
    parts = [
        named("transactions", validate.transaction_violations(payments, baseline), "rule", "txn_id"),
        named("vocabulary", validate.vocabulary_violations(payments, "txn_id"), "column", "txn_id"),
        named(
            "labels",
            validate.baseline_label_violations(labels) if baseline else validate.attack_label_violations(labels),
            "rule",
            "txn_id",
        ),
        named(
            "references",
            validate.foreign_key_violations(payments, tables["parties"], tables["merchants"], tables["devices"]),
            "reason",
            "txn_id",
        ),
        named("edges", validate.edge_violations(edges, start_us, end_us), "rule", "edge"),
        named("edges", validate.edge_endpoint_violations(edges, tables["parties"]), "reason", "edge"),
        named("keys", validate.duplicate_keys(payments, "txn_id"), constant("duplicate transactions"), "txn_id"),
        named("keys", validate.duplicate_keys(labels, "txn_id"), constant("duplicate labels"), "txn_id"),
        named("keys", validate.key_set_difference(payments, labels), "side", "txn_id"),
        named("devices", validate.device_activity_violations(payments, devices), "rule", "txn_id"),
        named(
            "splits",
            payments.filter(assign_split("ts_us", windows).isNull()),
            constant("outside every split window"),
            "txn_id",
        ),
        named(
            "splits",
            validate.ids_in_several_splits(payments.select("txn_id", assign_split("ts_us", windows).alias("split")), "txn_id"),
            constant("shared by two splits"),
            "txn_id",
        ),
    ]
    if leaked:
        spark = payments.sparkSession
        parts.append(spark.createDataFrame([("features", "label-only fields", c) for c in leaked], "check string, rule string, id string"))
    # Read twice below: the checks behind it run once.
    broken = cut_lineage(reduce(DataFrame.unionByName, parts))
    firsts = validate.first_violations(broken, ["check", "rule"], "id", examples).groupBy("check", "rule").agg(
        F.sort_array(F.collect_list("id")).alias("examples")
    )
    return broken.groupBy("check", "rule").agg(F.count("*").alias("n")).join(firsts, ["check", "rule"], "left")


def build_graph_dataset(
    spark: SparkSession, source: str, target: str, start_us: int, end_us: int, version: str = "v1", baseline: bool = True
) -> DataFrame:
    """Load the tables, derive the edges, write the data set with its reports, return the checks."""
    tables = load_dataset(spark, source)
    edges = graph_edges(with_event_time(tables["transactions"]), start_us, end_us)
    tables["graph_edges"] = _edge_table(edges)
    for name, df in tables.items():
        write_table(df, name, target)
    written = load_dataset(spark, target)
    write_report(spark, manifest(written, version), f"{target}/manifest")
    checks = leakage_checks(written, start_us, end_us, baseline)
    write_report(spark, checks.agg(F.collect_list(F.struct("*")).alias("checks")), f"{target}/validation")
    return checks


def split_graph_counts(payments: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Edges per split, each split's graph built from its own window only."""
    rows = payments.withColumn("split", assign_split("ts_us", split_windows(start_us, end_us)))
    return graph_edges(rows.filter(F.col("split").isNotNull()), by=["split"]).groupBy("split").agg(F.count("*").alias("n_edges"))


def training_rows(
    tables: dict[str, DataFrame], start_us: int, end_us: int, held_out: str | None = HELD_OUT_FAMILY, tz: str = "Asia/Kolkata"
) -> DataFrame:
    """The feature frame with labels and temporal splits; graph features look back only."""
    payments = with_event_time(tables["transactions"])
    out = feature_frame(payments, tables["parties"], tables["labels"], tz=tz)
    split = assign_split("ts_us", split_windows(start_us, end_us), outside="test")
    if held_out is not None:
        split = hold_out_family(split, F.col("attack_id"), held_out)
    return out.withColumns({"y": F.col("is_fraud").cast("int"), "split": split, "family": F.coalesce("attack_id", F.lit("__legit__"))})


def train_and_evaluate(
    rows: DataFrame, categorical=CATEGORICAL_FEATURES, numeric=ml.NUMERIC, models=None, held_out: str | None = HELD_OUT_FAMILY
) -> tuple[ml.FraudModel, DataFrame, DataFrame]:
    """Model, validation comparison and the evaluation bundle on test."""
    model, comparison, test = ml.train_fraud_model(rows, categorical, numeric, models)
    return model, comparison, ml.evaluation_bundle(test, model.threshold, held_out)


def score_requests(requests: DataFrame, model: ml.FraudModel | None = None) -> DataFrame:
    """Model probability, risk fusion and narrative for each request."""
    scored = model.score(requests, "probability") if model is not None else requests
    return narrate(assess(scored))


def retrain_with_feedback(
    rows: DataFrame,
    verdicts: DataFrame,
    payments: DataFrame,
    retained: DataFrame | None,
    deployed: DataFrame | None,
    categorical=CATEGORICAL_FEATURES,
    numeric=ml.NUMERIC,
    models=None,
    tolerance: float = 0.02,
) -> dict[str, object]:
    """Fold verdicts and retained attacks into the training rows, retrain, gate.

    Verdicts on unknown payments are returned as quarantine. Verdicts stay in the
    store when the gate rejects, so the next run can use them.
    """
    confirmed = verdicts.filter(F.col("analyst_verdict") == "FRAUD").count()
    if retained is not None:
        rows = sampling.cap_retained(rows, retained.withColumn("split", F.lit("train")), "txn_id", confirmed)
    updated = feedback.apply_verdicts(rows, verdicts)
    model, comparison, test = ml.train_fraud_model(updated, categorical, numeric, models)
    areas = metrics.area_metrics(test)
    return {
        "model": model,
        "comparison": comparison,
        "test": test,
        "quarantine": feedback.unknown_verdicts(verdicts, payments),
        "gate": metrics.promotion_gate(areas, deployed, tolerance),
    }


def data_summary(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The report tables of a data set."""
    payments = with_event_time(tables["transactions"])
    return {
        "counts": profile.count_by(payments, ["rail", "channel", "auth_method", "decision"]),
        "quantiles": profile.volume_quantiles(payments),
        "rates": profile.rates(payments),
        "labels": profile.label_distribution(tables["labels"]),
        "entities": profile.entity_counts(tables["parties"], tables["merchants"], tables["devices"]),
    }
