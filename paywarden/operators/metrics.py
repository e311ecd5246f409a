"""Detector evaluation: confusion counts, curves, operating points, guards.

Curves group equal scores first and then scan the distinct scores, so an
evaluation over any number of rows shuffles one row per distinct score and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paywarden.operators.quantiles import bracketed_quantiles
from paywarden.operators.scan import MAX_ROWS_PER_TASK, Metric, find_hot_keys, prefix_scan
from paywarden.session import cut_lineage

# Sweep thresholds 0.10 .. 0.90, evasion targets per generation.
SWEEP = tuple(0.1 + 0.05 * i for i in range(17))
EVASION_TARGETS = {"gen1": 0.01, "gen2": 0.00, "gen3": 0.05, "gen4": 0.15, "gen5": 0.30}
DEFAULT_EVASION_TARGET = 0.05
EVASION_THRESHOLD = 0.45
FPR_TARGETS = (0.001, 0.01)


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1, false-positive rate and alerts per 1000; 0 where undefined."""
    precision, recall = _div(tp, tp + fp), _div(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": _div(2 * tp, 2 * tp + fp + fn),
        "fpr": _div(fp, fp + tn),
        "alerts_per_1000": _div((tp + fp) * 1000.0, tp + fp + fn + tn),
    }


def confusion(
    scored: DataFrame, threshold: float | Column, score: str = "score", label: str = "y", by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and rates at ``score >= threshold``."""
    alert, fraud = F.col(score) >= threshold, F.col(label) == 1
    counts = scored.groupBy(*by).agg(
        F.count_if(alert & fraud).alias("tp"),
        F.count_if(alert & ~fraud).alias("fp"),
        F.count_if(~alert & fraud).alias("fn"),
        F.count_if(~alert & ~fraud).alias("tn"),
    )
    return counts.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def threshold_sweep(
    scored: DataFrame, thresholds: Sequence[float] = SWEEP, score: str = "score", label: str = "y"
) -> DataFrame:
    """Confusion and rates at each threshold.

    Rows are counted by how many thresholds they reach; the per-threshold numbers
    are sums over those few counts, so no row is repeated per threshold.
    """
    reached = F.lit(0)
    for th in thresholds:
        reached = reached + F.when(F.col(score) >= float(th), 1).otherwise(0)
    binned = scored.groupBy(reached.alias("reached")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    points = [F.struct(F.lit(i + 1).alias("i"), F.lit(float(th)).alias("threshold")) for i, th in enumerate(thresholds)]
    per = binned.select("*", F.explode(F.array(*points)).alias("_p")).select("*", "_p.*")
    alert = F.col("reached") >= F.col("i")
    counts = per.groupBy("threshold").agg(
        F.sum(F.when(alert, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(alert, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~alert, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~alert, F.col("neg")).otherwise(0)).alias("tn"),
    )
    return counts.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the best F1; 0.5 when no threshold finds anything."""
    best = F.max(F.struct("f1", -F.col("threshold"))).alias("_b")
    f1, th = F.col("_b.f1"), -F.col("_b.col2")
    return sweep.agg(best).select(
        F.when(f1 > 0, th).otherwise(0.5).alias("threshold"), f1.alias("f1")
    )


def curve(
    scored: DataFrame,
    score: str = "score",
    label: str = "y",
    by: Sequence[str] = (),
    weight: Column | None = None,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """One row per distinct score: own and cumulative positives and negatives from the top."""
    w = F.lit(1) if weight is None else weight
    points = scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) != 1, w).otherwise(0)).alias("neg"),
    )
    hot = find_hot_keys(scored.select(*by, F.col(score).alias("score")), by, "score", max_rows)
    scanned = prefix_scan(
        points, by, ["score"], {"tp": Metric("sum", F.col("pos"), True), "fp": Metric("sum", F.col("neg"), True)},
        hot, reverse=True,
    )
    totals = points.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return scanned.join(totals, list(by)) if by else scanned.crossJoin(F.broadcast(totals))


def operating_points(
    scored: DataFrame,
    targets: Sequence[float] = FPR_TARGETS,
    score: str = "score",
    label: str = "y",
    by: Sequence[str] = (),
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Highest-recall threshold whose false-positive rate stays within each target.

    Every distinct score is a candidate. When none fits the threshold is infinite.
    """
    points = curve(scored, score, label, by, max_rows=max_rows)
    spec = F.array(*[F.lit(float(t)) for t in targets])
    long = points.select("*", F.explode(spec).alias("target_fpr"))
    fits = _div(F.col("fp"), F.col("n_neg")) <= F.col("target_fpr")
    out = long.groupBy(*by, "target_fpr").agg(
        F.min(F.when(fits, F.col("score"))).alias("_th"),
        F.coalesce(F.max(F.when(fits, F.col("tp"))), F.lit(0)).alias("tp"),
        F.coalesce(F.max(F.when(fits, F.col("fp"))), F.lit(0)).alias("fp"),
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
    )
    return out.select(
        *by,
        "target_fpr",
        F.coalesce("_th", F.lit(float("inf"))).alias("threshold"),
        _div(F.col("fp"), F.col("n_neg")).alias("achieved_fpr"),
        _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _div(F.col("tp"), F.col("n_pos")).alias("recall"),
    )


def area_metrics(
    scored: DataFrame,
    score: str = "score",
    label: str = "y",
    by: Sequence[str] = (),
    weight: Column | None = None,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """PR-AUC (trapezoids from recall 0, precision 1) and ROC-AUC (average ranks)."""
    c = F.col
    points = curve(scored, score, label, by, weight, max_rows)
    tp0, fp0 = c("tp") - c("pos"), c("fp") - c("neg")
    precision = c("tp") / (c("tp") + c("fp"))
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)
    pr = F.sum(c("pos") * (precision + before) / 2)
    below = c("n_neg") - c("fp")
    roc = F.sum(c("pos") * (below + c("neg") / 2))
    return points.groupBy(*by).agg(
        F.when(F.max("n_pos") > 0, pr / F.max("n_pos")).alias("pr_auc"),
        F.when((F.max("n_pos") > 0) & (F.max("n_neg") > 0), roc / (F.max("n_pos") * F.max("n_neg"))).alias("roc_auc"),
    )


def brier(scored: DataFrame, score: str = "score", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(F.avg((F.col(score) - F.col(label)) ** 2).alias("brier_score"))


def bootstrap_recall(
    scored: DataFrame,
    threshold: float,
    id_column: str = "txn_id",
    score: str = "score",
    label: str = "y",
    resamples: int = 100,
    ci: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Seeded bootstrap interval of recall over the fraud rows.

    A resample gives each row a Poisson(1) weight from a hash of row and resample;
    the repeated rows combine in each task before the shuffle.
    """
    fraud = scored.filter(F.col(label) == 1).select(id_column, (F.col(score) >= threshold).alias("caught"))
    drawn = fraud.select("*", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "resample", id_column), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # Cumulative probabilities of Poisson(1) for 0, 1, 2, ...
    weight, cdf, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(9):
        cdf += term
        weight = weight + F.when(u > cdf, 1).otherwise(0)
        term /= k + 1
    recalls = (
        drawn.groupBy("resample")
        .agg(F.sum(weight).alias("w"), F.sum(F.when(F.col("caught"), weight).otherwise(0)).alias("hit"))
        .select("resample", _div(F.col("hit"), F.col("w")).alias("recall"))
    )
    a = (1 - ci) / 2
    return recalls.agg(
        F.percentile("recall", a).alias("ci_lower"),
        F.percentile("recall", 1 - a).alias("ci_upper"),
        F.avg("recall").alias("point_estimate"),
        F.count("*").alias("resamples"),
    )


def held_out_recall(
    scored: DataFrame, points: DataFrame, family: str, score: str = "score", label: str = "y"
) -> DataFrame:
    """Recall of one attack family at each operating point."""
    rows = scored.filter((F.col("family") == family) & (F.col(label) == 1)).select(score)
    # One row per target, so the points are what is broadcast.
    points = points.select("target_fpr", "threshold")
    caught = F.col(score) >= F.col("threshold")
    hits = rows.crossJoin(F.broadcast(points)).groupBy("target_fpr").agg(
        F.count("*").alias("held_out_fraud_total"),
        F.count_if(caught).alias("held_out_fraud_caught"),
        F.avg(caught.cast("int")).alias("held_out_recall"),
    )
    return points.join(hits, "target_fpr", "left").fillna(0, ["held_out_fraud_total", "held_out_fraud_caught"])


def evasion(scored: DataFrame, threshold: float = EVASION_THRESHOLD, score: str = "score", by: str = "generation") -> DataFrame:
    """Share of attacks that slip through; caught means strictly above the threshold."""
    targets = F.create_map(*[F.lit(x) for kv in EVASION_TARGETS.items() for x in kv])
    out = scored.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(F.col(score) > threshold).alias("caught")
    )
    margin = (F.col("total") - F.col("caught")) / F.col("total")
    out = out.withColumns(
        {
            "slipped": F.col("total") - F.col("caught"),
            "evasion_margin": margin,
            "target": F.coalesce(F.try_element_at(targets, F.col(by)), F.lit(DEFAULT_EVASION_TARGET)),
        }
    )
    return out.withColumns(
        {
            "status": F.when(F.col("evasion_margin") <= F.col("target"), "PASS").otherwise("FAIL"),
            "margin_to_target": F.col("evasion_margin") - F.col("target"),
        }
    )


def compare_generations(margins: DataFrame, by: str = "generation") -> DataFrame:
    """Best and worst generation, whether later ones are harder, whether all pass."""
    # A handful of generations: gathering them in order is the point of the report.
    listed = margins.agg(
        F.sort_array(F.collect_list(F.struct(by, "evasion_margin"))).alias("g"),
        F.min_by(by, F.struct("evasion_margin", by)).alias("best_gen"),
        F.max_by(by, F.struct(F.col("evasion_margin"), F.col(by))).alias("worst_gen"),
        F.bool_and(F.col("status") == "PASS").alias("all_pass"),
    )
    m = F.transform("g", lambda e: e["evasion_margin"])
    rising = F.forall(
        F.zip_with(F.slice(m, 1, F.size(m) - 1), F.slice(m, 2, F.size(m) - 1), lambda a, b: a <= b), lambda ok: ok
    )
    trend = (
        F.when(F.size(m) < 2, "unknown (single generation)")
        .when(rising, "degrading (expected)")
        .otherwise("improving (unexpected)")
    )
    return listed.select("best_gen", "worst_gen", trend.alias("trend"), "all_pass")


def family_battery(
    scored: DataFrame, thresholds: dict[str, float], intensities: Sequence[str] = ("LOW", "MEDIUM", "HIGH"), score: str = "score"
) -> DataFrame:
    """Alert share per family at each threshold, and per intensity at the first one.

    For the legitimate row the share is the false-positive rate.
    """
    first = next(iter(thresholds.values()))
    shares = [F.avg((F.col(score) >= th).cast("int")).alias(f"alert_share_{n}") for n, th in thresholds.items()]
    cells = [
        F.avg(F.when(F.col("intensity") == lvl, (F.col(score) >= first).cast("int"))).alias(f"alert_share_{lvl.lower()}")
        for lvl in intensities
    ]
    return scored.groupBy("family").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), *shares, *cells)


def family_intensity_totals(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Alert share per family and per family x intensity, from one pass over grouping sets."""
    fam, lvl = F.col("family"), F.col("intensity")
    return scored.groupingSets([[fam], [fam, lvl]], fam, lvl).agg(
        F.count("*").alias("n"), F.avg((F.col(score) >= threshold).cast("int")).alias("alert_share")
    )


def checkpoint_battery(scored: DataFrame, target_fpr: float = 0.01, score: str = "score", label: str = "y", max_rows: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """Recall per checkpoint and family, each checkpoint at its own threshold."""
    points = operating_points(scored, [target_fpr], score, label, ["checkpoint"], max_rows)
    joined = scored.filter(F.col(label) == 1).join(points.select("checkpoint", "threshold"), "checkpoint")
    return joined.groupBy("checkpoint", "family").agg(
        F.count("*").alias("n"),
        F.first("threshold").alias("threshold"),
        F.avg((F.col(score) >= F.col("threshold")).cast("int")).alias("recall"),
    )


def missingness_guard(df: DataFrame, features: Sequence[str], label: str = "y", limit: float = 0.90) -> DataFrame:
    """Features whose absence alone tells fraud from legitimate rows."""
    fraud = F.col(label) == 1
    aggs = []
    for f in features:
        missing = F.col(f).isNull().cast("int")
        aggs.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.avg(F.when(fraud, missing)).alias("fraud_missing"),
                F.avg(F.when(~fraud, missing)).alias("legit_missing"),
            )
        )
    out = df.agg(F.array(*aggs).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    gap = F.abs(F.col("fraud_missing") - F.col("legit_missing"))
    return out.withColumn("leaky", F.coalesce(gap >= limit, F.lit(False)))


def disjoint_range_guard(
    df: DataFrame, features: Sequence[str], label: str = "y", min_rows: int = 10, max_rows: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """Features whose 5-95 % ranges in the two classes do not meet."""
    q = bracketed_quantiles(df, [label], features, {"lo": 0.05, "hi": 0.95}, max_rows=max_rows)
    c = F.col
    per = q.groupBy("feature").agg(
        *[F.max(F.when(c(label) == cls, c(x))).alias(f"{name}_{x}") for cls, name in ((1, "fraud"), (0, "legit")) for x in ("lo", "hi", "n_values")]
    )
    enough = (c("fraud_n_values") >= min_rows) & (c("legit_n_values") >= min_rows)
    apart = (c("fraud_hi") < c("legit_lo")) | (c("legit_hi") < c("fraud_lo"))
    return per.select(
        "feature", "fraud_lo", "fraud_hi", "legit_lo", "legit_hi", F.coalesce(enough & apart, F.lit(False)).alias("disjoint")
    )


def lookalike_fidelity(df: DataFrame, features: Sequence[str], group: str = "population") -> DataFrame:
    """Do lookalikes sit nearer to fraud than to legitimate rows?

    ``group`` holds fraud, lookalike or legit. Distances are between class means,
    each feature scaled by its overall deviation; all rows count, none is sampled.
    """
    c = F.col
    filled = df.select(group, *[F.coalesce(c(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    structs = []
    for f in features:
        parts = [F.lit(f).alias("feature"), F.stddev_pop(f).alias("std")]
        for g in ("fraud", "lookalike", "legit"):
            v = F.when(c(group) == g, c(f))
            parts += [F.avg(v).alias(f"{g}_mean"), F.stddev_pop(v).alias(f"{g}_std")]
        structs.append(F.struct(*parts))
    per = filled.agg(F.array(*structs).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    std = F.when(c("std") > 0, c("std")).otherwise(1.0)

    def dist(a: str, b: str) -> Column:
        return F.sqrt(F.sum(((c(f"{a}_mean") - c(f"{b}_mean")) / std) ** 2))

    fs, ls = c("fraud_std") + 1e-6, c("lookalike_std") + 1e-6
    apart = (c("fraud_mean") + fs < c("lookalike_mean") - ls) | (c("lookalike_mean") + ls < c("fraud_mean") - fs)
    out = per.agg(
        dist("fraud", "lookalike").alias("fraud_to_lookalike"),
        dist("fraud", "legit").alias("fraud_to_legit"),
        dist("lookalike", "legit").alias("lookalike_to_legit"),
        (F.avg((~apart).cast("int")) * 100).alias("feature_overlap_pct"),
    )
    ratio = c("fraud_to_lookalike") / (c("lookalike_to_legit") + 1e-6)
    out = out.withColumn("separation_ratio", ratio)
    verdict = (
        F.when((c("separation_ratio") > 1.5) | (c("feature_overlap_pct") < 30), "FAIL")
        .when((c("separation_ratio") > 1.0) | (c("feature_overlap_pct") < 50), "BORDERLINE")
        .otherwise("PASS")
    )
    return out.withColumn("status", verdict)


def family_diversity(df: DataFrame, features: Sequence[str], family: str = "attack_id") -> DataFrame:
    """How far apart attack families are, against their own spread.

    Root-mean-square pair distances on standardised features. The mean squared
    distance of all pairs follows from each family's counts, means and variances,
    so every row counts and no pair is formed.
    """
    c = F.col
    filled = df.select(family, *[F.coalesce(c(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    scale = filled.agg(*[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    stats = filled.groupBy(family).agg(
        F.count("*").alias("n"), *[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}"))]
    )
    stats = stats.crossJoin(F.broadcast(scale))

    def s2(f: str) -> Column:
        return F.when(c(f"s_{f}") > 0, c(f"s_{f}") ** 2).otherwise(1.0)

    vectors = stats.select(
        c(family).alias("family"),
        "n",
        F.array(*[c(f"m_{f}") / F.sqrt(s2(f)) for f in features]).alias("m"),
        sum((c(f"v_{f}") / s2(f) for f in features), F.lit(0.0)).alias("v"),
    ).filter(c("n") >= 2)
    intra = vectors.agg(
        F.avg(F.sqrt(2 * c("v") * c("n") / (c("n") - 1))).alias("avg_intra"), F.count("*").alias("n_families")
    )
    # One row per family: pairs of families, not of payments.
    a, b = vectors.alias("a"), vectors.alias("b")
    gap = F.aggregate(
        F.zip_with("a.m", "b.m", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, d: acc + d
    )
    inter = a.join(b, c("a.family") < c("b.family")).agg(F.avg(F.sqrt(c("a.v") + c("b.v") + gap)).alias("avg_inter"))
    return intra.crossJoin(inter).select(
        "n_families", "avg_intra", "avg_inter", _div(c("avg_inter"), c("avg_intra")).alias("separation_ratio")
    )


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Balanced weight n / (k * n_c) per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    return counts.crossJoin(F.broadcast(totals)).select(label, "n", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))


def positive_weight(df: DataFrame, label: str = "y") -> DataFrame:
    """Negatives per positive; 1 without positives."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) != 1)
    return df.agg(F.when(pos > 0, neg / pos).otherwise(1.0).alias("scale_pos_weight"))


def at_prevalence(
    scored: DataFrame, prevalence: float = 0.035, threshold: float = 0.5, score: str = "score", label: str = "y",
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Metrics with fraud rows reweighted to a given prevalence."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) != 1)
    w = scored.agg((prevalence / (1 - prevalence) * neg / pos).alias("w"))
    rows = scored.select(score, label).crossJoin(F.broadcast(w))
    weight = F.when(F.col(label) == 1, F.col("w")).otherwise(1.0)
    alert = F.col(score) >= threshold
    base = rows.agg(
        F.sum(F.when(alert & (F.col(label) == 1), weight).otherwise(0.0)).alias("tp"),
        F.sum(F.when(alert & (F.col(label) != 1), weight).otherwise(0.0)).alias("fp"),
        F.sum(F.when(~alert & (F.col(label) == 1), weight).otherwise(0.0)).alias("fn"),
        F.sum(F.when(~alert & (F.col(label) != 1), weight).otherwise(0.0)).alias("tn"),
    ).withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))
    areas = area_metrics(rows, score, label, weight=weight, max_rows=max_rows)
    return base.drop("tp", "fp", "fn", "tn").crossJoin(areas)


def class_report(df: DataFrame, actual: str = "family", predicted: str = "pred_family") -> DataFrame:
    """Precision, recall, F1 and support per class."""
    pairs = df.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    hit = F.col(actual) == F.col(predicted)
    support = pairs.groupBy(F.col(actual).alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp")
    )
    called = pairs.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("called"))
    joined = support.join(called, "class", "full_outer").fillna(0, ["support", "tp", "called"])
    return joined.select(
        "class",
        "support",
        _div(F.col("tp"), F.col("called")).alias("precision"),
        _div(F.col("tp"), F.col("support")).alias("recall"),
        _div(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"),
        "tp",
    )


def class_summary(report: DataFrame) -> DataFrame:
    n = F.sum("support")
    return report.agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
    )


def promotion_gate(candidate: DataFrame, deployed: DataFrame | None, tolerance: float = 0.02) -> DataFrame:
    """Accept a model unless its PR-AUC falls more than ``tolerance`` below the deployed one's."""
    new = candidate.select(F.col("pr_auc").alias("new_pr_auc"))
    if deployed is None:
        out = new.withColumn("old_pr_auc", F.lit(None).cast("double"))
    else:
        out = new.join(deployed.select(F.col("pr_auc").alias("old_pr_auc")), how="left")
    drop = F.col("old_pr_auc") - F.col("new_pr_auc")
    decision = (
        F.when(F.col("old_pr_auc").isNull() | F.col("new_pr_auc").isNull(), "skipped")
        .when(drop > tolerance, "rejected")
        .otherwise("passed")
    )
    return out.select("new_pr_auc", "old_pr_auc", drop.alias("regression"), decision.alias("decision"))


def mean_pair_distance(
    df: DataFrame,
    features: Sequence[str],
    family: str = "attack_id",
    id_column: str = "txn_id",
    partners: int = 8,
    order: Column | None = None,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Mean distance of pairs inside a family and between families, with standard errors.

    Rows are numbered per family in hash order. A row meets the ``partners`` rows that
    follow it in its family, going round at the end, and as many rows of other families,
    which it takes in turn. Under a random order each such pair is a fair draw of all pairs,
    so the means are unbiased, whatever the sizes; inside a family of at most
    ``partners + 1`` rows they are exact. The work is ``2 * partners`` distances a row.
    Families of one row are left out; nulls count as 0; every family weighs the same.
    """
    c = F.col
    h = F.xxhash64(F.lit(42), c(id_column)) if order is None else order
    filled = df.filter(c(family).isNotNull()).select(
        c(family).alias("family"), c(id_column).alias("_id"), h.alias("_h"),
        *[F.coalesce(c(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
    )
    scale = filled.agg(*[F.stddev_pop(f).alias(f"s_{f}") for f in features])  # one row
    vector = F.array(*[c(f) / F.when(c(f"s_{f}") > 0, c(f"s_{f}")).otherwise(1.0) for f in features])
    rows = filled.crossJoin(F.broadcast(scale)).select("family", "_id", "_h", vector.alias("_v"))
    hot = find_hot_keys(rows, ["family"], "_h", max_rows)
    # Read three times below.
    rows = cut_lineage(prefix_scan(rows, ["family"], ["_h", "_id"], {"_i": Metric("sum", F.lit(1).cast("long"))}, hot))
    sizes = rows.groupBy("family").agg(F.count("*").alias("_n")).filter(c("_n") >= 2)
    # One row per family from here to the next join.
    sizes = sizes.withColumn("_k", F.row_number().over(Window.orderBy("family")) - 1)
    sizes = cut_lineage(sizes.withColumn("_families", F.count("*").over(Window.partitionBy())))
    asked = rows.join(sizes, "family").withColumn("_s", F.explode(F.sequence(F.lit(1), F.lit(partners))))
    inside = asked.filter(c("_s") < c("_n")).select(
        "family", c("family").alias("other"), "_v", F.pmod(c("_i") + c("_s"), c("_n")).alias("_i")
    )
    step = F.pmod(c("_i") + c("_s"), F.greatest(c("_families") - 1, F.lit(1)))
    across = asked.filter(c("_families") > 1).select(
        "family", "_v", (c("_i") + c("_s")).alias("_at"), F.pmod(c("_k") + 1 + step, c("_families")).alias("_k")
    )
    across = across.join(sizes.select(c("family").alias("other"), c("_n").alias("_m"), "_k"), "_k").select(
        "family", "other", "_v", F.pmod(c("_at"), c("_m")).alias("_i")
    )
    met = inside.unionByName(across).join(
        rows.select(c("family").alias("other"), "_i", c("_v").alias("_w")), ["other", "_i"]
    )
    far = F.sqrt(F.aggregate(F.zip_with("_v", "_w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, d: acc + d))
    pairs = met.groupBy(F.least("family", "other").alias("_a"), F.greatest("family", "other").alias("_b")).agg(
        F.avg(far).alias("_mean"), (F.var_samp(far) / F.count("*")).alias("_var")
    )
    same = c("_a") == c("_b")

    def summary(name: str, which: Column) -> list[Column]:
        n = F.count_if(which)
        error = F.sqrt(F.sum(F.when(which, F.coalesce("_var", F.lit(0.0))))) / F.when(n > 0, n)
        return [F.avg(F.when(which, c("_mean"))).alias(f"avg_{name}"), error.alias(f"{name}_error")]

    out = pairs.agg(F.count_if(same).alias("n_families"), *summary("intra", same), *summary("inter", ~same))
    return out.withColumn("separation_ratio", _div(c("avg_inter"), c("avg_intra")))
