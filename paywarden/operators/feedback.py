"""Analyst feedback: verdict summaries, label overrides, quarantine, usage budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.operators.sampling import hash_split, take_by_hash

# Verdicts needed before a retrain, and the daily analysis budget.
RETRAIN_AFTER = 5
DAILY_LIMIT_USD = 1.0
MAX_RUNS_PER_DAY = 20
ESTIMATED_COST_USD = 0.005


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict per payment, the latest; equal times by verdict."""
    pick = F.max_by(
        F.struct("analyst_verdict", "analyst_confidence", "ts_us"), F.struct("ts_us", "analyst_verdict")
    )
    return verdicts.groupBy("transaction_id").agg(pick.alias("_v")).select("transaction_id", "_v.*")


def _usable(verdicts: DataFrame) -> DataFrame:
    usable = verdicts.filter(F.col("analyst_verdict").isin("FRAUD", "LEGITIMATE"))
    return latest_verdicts(usable).select(
        F.col("transaction_id").alias("txn_id"),
        F.when(F.col("analyst_verdict") == "FRAUD", 1).otherwise(0).alias("_verdict"),
    )


def apply_verdicts(rows: DataFrame, verdicts: DataFrame, label: str = "y", split: str = "split") -> DataFrame:
    """Reviewed rows take the analyst's label and move to the training split."""
    joined = rows.join(_usable(verdicts), "txn_id", "left")
    return joined.withColumns(
        {
            label: F.coalesce("_verdict", F.col(label)),
            split: F.when(F.col("_verdict").isNotNull(), "train").otherwise(F.col(split)),
        }
    ).drop("_verdict")


def unknown_verdicts(verdicts: DataFrame, payments: DataFrame) -> DataFrame:
    """Verdicts on payments the data set does not hold: kept aside, never trained on."""
    known = payments.select(F.col("txn_id").alias("transaction_id"))
    return latest_verdicts(verdicts).join(known, "transaction_id", "left_anti")


def feedback_summary(verdicts: DataFrame, enough: int = RETRAIN_AFTER) -> DataFrame:
    v = F.col("analyst_verdict")
    out = verdicts.agg(
        F.count("*").alias("total_feedback"),
        F.count_if(v == "FRAUD").alias("fraud_confirmed"),
        F.count_if(v == "LEGITIMATE").alias("legitimate_confirmed"),
        F.count_if(v == "UNSURE").alias("unsure"),
        F.coalesce(F.avg(F.when(v == "FRAUD", F.col("analyst_confidence"))), F.lit(0.0)).alias("fraud_confidence"),
        F.max("ts_us").alias("last_updated_us"),
    )
    fraud, total = F.col("fraud_confirmed"), F.col("total_feedback")
    reason = (
        F.when(fraud >= enough, F.format_string("Enough fraud feedback (%d confirmed)", fraud))
        .when(total >= enough, F.format_string("Enough total feedback (%d verdicts)", total))
        .otherwise(F.format_string(f"Not enough feedback yet (%d/{enough}, %d/{enough} fraud)", total, fraud))
    )
    return out.withColumns({"should_retrain": (fraud >= enough) | (total >= enough), "reason": reason})


def signal_counts(verdicts: DataFrame, column: str = "key_signals") -> DataFrame:
    """How often each entry of an array column occurs, by verdict."""
    return (
        verdicts.select("analyst_verdict", F.explode(column).alias("entry"))
        .groupBy("entry", "analyst_verdict")
        .agg(F.count("*").alias("n"))
    )


def agreement_rate(verdicts: DataFrame, risk: str = "risk_score", bound: float = 60.0) -> DataFrame:
    """Share of verdicts that agree with the score, and per verdict."""
    agree = (F.col(risk) >= bound) == (F.col("analyst_verdict") == "FRAUD")
    return verdicts.agg(F.count("*").alias("n"), F.avg(agree.cast("int")).alias("agreement"))


def parse_usage(lines: DataFrame, line: str = "line") -> DataFrame:
    """``timestamp|cost`` lines to columns; lines that do not parse are dropped."""
    parts = F.split(F.col(line), "\\|")
    out = lines.filter(F.size(parts) >= 2).select(
        F.try_to_timestamp(F.get(parts, 0)).alias("used_at"), F.expr(f"try_cast(get(split({line}, '\\\\|'), 1) AS double)").alias("cost_usd")
    )
    return out.filter(F.col("used_at").isNotNull() & F.col("cost_usd").isNotNull())


def daily_usage(
    usage: DataFrame,
    limit_usd: float = DAILY_LIMIT_USD,
    max_runs: int = MAX_RUNS_PER_DAY,
    next_cost: float = ESTIMATED_COST_USD,
) -> DataFrame:
    """Cost and runs per day, what is left and whether one more run fits."""
    out = usage.groupBy(F.to_date("used_at").alias("day")).agg(
        F.sum("cost_usd").alias("spent_usd"), F.count("*").alias("request_count")
    )
    return out.withColumns(
        {
            "remaining_usd": limit_usd - F.col("spent_usd"),
            "can_proceed": (F.col("request_count") < max_runs) & (F.col("spent_usd") + next_cost <= limit_usd),
        }
    )


def curriculum_level(
    attacks: DataFrame, cap: int, id_column: str = "txn_id", hash_column: Column | None = None, train_share: float = 0.8
) -> DataFrame:
    """One curriculum level: a seeded sample of its attacks, cut into train and test."""
    h = F.pmod(F.xxhash64(F.lit(7), F.col(id_column)), F.lit(1 << 31)) if hash_column is None else hash_column
    kept = take_by_hash(attacks, cap, id_column, hash_column=hash_column)
    return hash_split(kept, F.floor(h / 7), train_share, "train", "test")


def assemble_training(original: DataFrame, feedback: DataFrame | None, levels: list[DataFrame], retained: DataFrame | None) -> DataFrame:
    """Original train and validation rows, feedback, the levels' train rows and retained attacks."""
    parts = [original.filter(F.col("split").isin("train", "validation"))]
    if feedback is not None:
        parts.append(feedback.withColumn("split", F.lit("train")))
    parts += [lvl.filter(F.col("split") == "train") for lvl in levels]
    if retained is not None:
        parts.append(retained.withColumn("split", F.lit("train")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
