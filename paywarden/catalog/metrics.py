"""Evaluation, guard and model-comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paywarden.catalog.features import SPLIT_CASE
from paywarden.catalog.registry import query, r, sr
from paywarden.operators import metrics as m
from paywarden.operators import sampling
from paywarden.operators.splits import assign_split, split_windows
from paywarden.sources.adapter import END_US, START_US

CONF = "sum(CASE WHEN {s} AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN {s} AND y = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT ({s}) AND y = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN NOT ({s}) AND y = 0 THEN 1 ELSE 0 END) AS tn"
RATE_SQL = {
    "precision": "CASE WHEN tp + fp > 0 THEN tp / cast(tp + fp as double) ELSE 0 END",
    "recall": "CASE WHEN tp + fn > 0 THEN tp / cast(tp + fn as double) ELSE 0 END",
    "f1": "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / cast(2 * tp + fp + fn as double) ELSE 0 END",
    "fpr": "CASE WHEN fp + tn > 0 THEN fp / cast(fp + tn as double) ELSE 0 END",
    "alerts_per_1000": "(tp + fp) * 1000e0 / (tp + fp + fn + tn)",
}
RATES = ", ".join(f"{sr(v)} AS {k}" for k, v in RATE_SQL.items())
COUNTS = "cast(tp as bigint) AS tp, cast(fp as bigint) AS fp, cast(fn as bigint) AS fn, cast(tn as bigint) AS tn"


def rounded(df, keep, cols):
    return df.select(*keep, *[r(c).alias(c) for c in cols])


@query(
    "confusion_by_generation",
    "D-12",
    f"SELECT generation, {COUNTS}, {RATES} FROM (SELECT generation, {CONF.format(s='score >= 0.35e0')} FROM scored GROUP BY generation)",
)
def _confusion(t):
    return rounded(m.confusion(t.scored, 0.35, by=["generation"]), ["generation", "tp", "fp", "fn", "tn"], RATE_SQL)


SWEPT = f"SELECT threshold, {CONF.format(s='score >= threshold')} FROM scored, th GROUP BY threshold"
TH = "SELECT unnest([" + ", ".join(f"{x!r}e0" for x in m.SWEEP) + "]) AS threshold"


@query("threshold_sweep", "D-13", f"SELECT {sr('threshold')} AS threshold, {COUNTS}, {RATES} FROM swept", th=TH, swept=SWEPT)
def _sweep(t):
    return rounded(m.threshold_sweep(t.scored), ["tp", "fp", "fn", "tn"], ["threshold", *RATE_SQL])


@query(
    "best_threshold",
    "D-13",
    f"SELECT {sr('threshold')} AS threshold, {sr(RATE_SQL['f1'])} AS f1 FROM swept ORDER BY {RATE_SQL['f1']} DESC, swept.threshold LIMIT 1",
    th=TH,
    swept=SWEPT,
)
def _best(t):
    return rounded(m.best_threshold(m.threshold_sweep(t.scored)), [], ["threshold", "f1"])


def _curve(by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    key = f"{by}," if by else ""
    return f"""SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(neg) OVER ({part} ORDER BY score DESC) AS fp,
 sum(pos) OVER ({part}) AS n_pos, sum(neg) OVER ({part}) AS n_neg FROM (SELECT {key} score,
 sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY {key} score)"""


POINTS_SQL = """SELECT {key} target_fpr, coalesce(min(CASE WHEN fp / cast(n_neg as double) <= target_fpr THEN score END), 'inf'::double) AS threshold,
 {a} AS achieved_fpr, {p} AS precision, {rec} AS recall FROM curve, (SELECT unnest([{targets}]) AS target_fpr) GROUP BY {key} target_fpr"""
_MTP = "coalesce(max(CASE WHEN fp / cast(n_neg as double) <= target_fpr THEN tp END), 0)"
_MFP = "coalesce(max(CASE WHEN fp / cast(n_neg as double) <= target_fpr THEN fp END), 0)"


def _points(by: str = "", targets: str = "0.001e0, 0.01e0, 0.1e0") -> str:
    return POINTS_SQL.format(
        key=f"{by}," if by else "",
        targets=targets,
        a=sr(f"{_MFP} / cast(max(n_neg) as double)"),
        p=sr(f"CASE WHEN {_MTP} + {_MFP} > 0 THEN {_MTP} / cast({_MTP} + {_MFP} as double) ELSE 0 END"),
        rec=sr(f"{_MTP} / cast(max(n_pos) as double)"),
    )


_POINT_COLUMNS = ["achieved_fpr", "precision", "recall"]


@query("roc_operating_points", "D-14", _points(), curve=_curve())
def _operating(t):
    return rounded(m.operating_points(t.scored, (0.001, 0.01, 0.1)), ["target_fpr", "threshold"], _POINT_COLUMNS)


@query("operating_points_per_checkpoint", "J-10", _points("checkpoint", "0.01e0"), curve=_curve("checkpoint"))
def _per_checkpoint(t):
    out = m.operating_points(t.scored, (0.01,), by=["checkpoint"])
    return rounded(out, ["checkpoint", "target_fpr", "threshold"], _POINT_COLUMNS)


PR_SQL = """sum(pos * (tp / cast(tp + fp as double) + CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / cast(tp - pos + fp - neg as double) ELSE 1 END) / 2) / max(n_pos)"""
ROC_SQL = "sum(pos * (n_neg - fp + neg / 2e0)) / (max(n_pos) * cast(max(n_neg) as double))"


@query("pr_roc_auc", "D-15 D-16", f"SELECT generation, {sr(PR_SQL)} AS pr_auc, {sr(ROC_SQL)} AS roc_auc FROM curve GROUP BY generation", curve=_curve("generation"))
def _areas(t):
    return rounded(m.area_metrics(t.scored, by=["generation"]), ["generation"], ["pr_auc", "roc_auc"])


@query("pr_roc_auc_overall", "D-15 D-16", f"SELECT {sr(PR_SQL)} AS pr_auc, {sr(ROC_SQL)} AS roc_auc FROM curve", curve=_curve())
def _areas_all(t):
    return rounded(m.area_metrics(t.scored), [], ["pr_auc", "roc_auc"])


@query("brier_score", "D-17", f"SELECT generation, {sr('avg((score - y) * (score - y))')} AS brier_score FROM scored GROUP BY generation")
def _brier(t):
    return rounded(m.brier(t.scored, by=["generation"]), ["generation"], ["brier_score"])


@query("bootstrap_recall", "D-18")
def _bootstrap(t):
    return m.bootstrap_recall(t.scored, 0.5)


@query(
    "held_out_recall",
    "D-19",
    f"""SELECT target_fpr, threshold, count(s.score) AS held_out_fraud_total, count(*) FILTER (s.score >= threshold) AS held_out_fraud_caught,
    {sr('avg(CASE WHEN s.score >= threshold THEN 1e0 ELSE 0e0 END)')} AS held_out_recall FROM points, scored s
    WHERE s.family = 'synthetic_identity_bustout' AND s.y = 1 GROUP BY target_fpr, threshold""",
    curve=_curve(),
    points=_points(targets="0.001e0, 0.01e0"),
)
def _held_out(t):
    out = m.held_out_recall(t.scored, m.operating_points(t.scored), "synthetic_identity_bustout")
    return rounded(out, ["target_fpr", "threshold", "held_out_fraud_total", "held_out_fraud_caught"], ["held_out_recall"])


EVASION = """SELECT generation, count(*) AS total, count(*) FILTER (score > 0.45e0) AS caught, count(*) - count(*) FILTER (score > 0.45e0) AS slipped,
 (count(*) - count(*) FILTER (score > 0.45e0)) / cast(count(*) as double) AS evasion_margin,
 CASE generation WHEN 'gen1' THEN 0.01e0 WHEN 'gen2' THEN 0e0 WHEN 'gen4' THEN 0.15e0 WHEN 'gen5' THEN 0.3e0 ELSE 0.05e0 END AS target
 FROM scored WHERE y = 1 GROUP BY generation"""


@query(
    "evasion_margin",
    "D-20",
    f"""SELECT generation, total, caught, slipped, {sr('evasion_margin')} AS evasion_margin, target,
    CASE WHEN evasion_margin <= target THEN 'PASS' ELSE 'FAIL' END AS status, {sr('evasion_margin - target')} AS margin_to_target FROM evasion""",
    evasion=EVASION,
)
def _evasion(t):
    out = m.evasion(t.scored.filter("y = 1"))
    return rounded(out, ["generation", "total", "caught", "slipped", "target", "status"], ["evasion_margin", "margin_to_target"])


@query(
    "generation_comparison",
    "D-21",
    """SELECT arg_min(generation, evasion_margin) AS best_gen, arg_max(generation, evasion_margin) AS worst_gen,
    CASE WHEN bool_and(step >= 0) THEN 'degrading (expected)' ELSE 'improving (unexpected)' END AS trend,
    bool_and(evasion_margin <= target) AS all_pass FROM (SELECT *, evasion_margin - lag(evasion_margin) OVER (ORDER BY generation) AS step FROM evasion)""",
    evasion=EVASION,
)
def _compare(t):
    return m.compare_generations(m.evasion(t.scored.filter("y = 1")))


_BATTERY = {"fpr01": 0.9, "fpr1": 0.6, "selected": 0.35}


@query(
    "family_battery",
    "D-22",
    "SELECT family, count(*) AS n, "
    + sr("avg(score)")
    + " AS mean_score, "
    + ", ".join(f"{sr(f'avg(CASE WHEN score >= {v}e0 THEN 1e0 ELSE 0e0 END)')} AS alert_share_{k}" for k, v in _BATTERY.items())
    + ", "
    + ", ".join(
        sr(f"avg(CASE WHEN intensity = '{x}' THEN CASE WHEN score >= 0.9e0 THEN 1e0 ELSE 0e0 END END)") + f" AS alert_share_{x.lower()}"
        for x in ("LOW", "MEDIUM", "HIGH")
    )
    + " FROM scored GROUP BY family",
)
def _battery(t):
    out = m.family_battery(t.scored, _BATTERY)
    return rounded(out, ["family", "n"], [c for c in out.columns if c not in ("family", "n")])


@query(
    "family_intensity_totals",
    "D-22",
    f"""SELECT family, intensity, count(*) AS n, {sr('avg(CASE WHEN score >= 0.6e0 THEN 1e0 ELSE 0e0 END)')} AS alert_share
    FROM scored GROUP BY GROUPING SETS ((family), (family, intensity))""",
)
def _totals(t):
    return rounded(m.family_intensity_totals(t.scored, 0.6), ["family", "intensity", "n"], ["alert_share"])


@query(
    "checkpoint_battery",
    "D-23",
    f"""SELECT s.checkpoint, family, count(*) AS n, any_value(threshold) AS threshold,
    {sr('avg(CASE WHEN score >= threshold THEN 1e0 ELSE 0e0 END)')} AS recall
    FROM scored s JOIN points p ON p.checkpoint = s.checkpoint WHERE y = 1 GROUP BY s.checkpoint, family""",
    curve=_curve("checkpoint"),
    points=_points("checkpoint", "0.01e0"),
)
def _checkpoints(t):
    return rounded(m.checkpoint_battery(t.scored), ["checkpoint", "family", "n", "threshold"], ["recall"])


GUARDED = ["amount", "mcc", "auth_latency_ms", "session_duration_s", "beneficiary_added_ago_s", "marker", "shifted"]
GUARD_ROWS = """SELECT p.txn_id, y, family, cast(amount as double) AS amount, cast(mcc as double) AS mcc, cast(auth_latency_ms as double) AS auth_latency_ms,
 cast(session_duration_s as double) AS session_duration_s, cast(beneficiary_added_ago_s as double) AS beneficiary_added_ago_s,
 CASE WHEN y = 1 THEN 1e0 END AS marker, y * 1000e0 + cast(amount as double) / 1000 AS shifted, cast(is_legit_lookalike as int) AS lookalike
 FROM payments p JOIN scored s ON p.txn_id = s.txn_id LEFT JOIN labelrows l ON l.txn_id = p.txn_id"""


def _guard_rows(t):
    rows = t.payments.join(t.scored.select("txn_id", "y", "family"), "txn_id").join(
        t.labels.select("txn_id", "is_legit_lookalike"), "txn_id", "left"
    )
    return rows.withColumns(
        {
            "marker": F.when(F.col("y") == 1, 1.0),
            "shifted": F.col("y") * 1000.0 + F.col("amount").cast("double") / 1000,
            "population": F.when(F.col("y") == 1, "fraud").when(F.col("is_legit_lookalike"), "lookalike").otherwise("legit"),
        }
    )


@query(
    "missingness_guard",
    "D-24",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, {sr(f'avg(CASE WHEN {f} IS NULL THEN 1e0 ELSE 0e0 END) FILTER (y = 1)')} AS fraud_missing,
        {sr(f'avg(CASE WHEN {f} IS NULL THEN 1e0 ELSE 0e0 END) FILTER (y = 0)')} AS legit_missing,
        abs(avg(CASE WHEN {f} IS NULL THEN 1e0 ELSE 0e0 END) FILTER (y = 1) - avg(CASE WHEN {f} IS NULL THEN 1e0 ELSE 0e0 END) FILTER (y = 0)) >= 0.9e0 AS leaky FROM guarded"""
        for f in GUARDED
    ),
    guarded=GUARD_ROWS,
)
def _missing(t):
    return rounded(m.missingness_guard(_guard_rows(t), GUARDED), ["feature", "leaky"], ["fraud_missing", "legit_missing"])


@query(
    "disjoint_range_guard",
    "D-25",
    f"""SELECT feature, {sr('flo', 4)} AS fraud_lo, {sr('fhi', 4)} AS fraud_hi, {sr('llo', 4)} AS legit_lo, {sr('lhi', 4)} AS legit_hi,
    coalesce(nf >= 10 AND nl >= 10 AND (fhi < llo OR lhi < flo), false) AS disjoint FROM ("""
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, quantile_cont({f}, 0.05) FILTER (y = 1) AS flo, quantile_cont({f}, 0.95) FILTER (y = 1) AS fhi,
        quantile_cont({f}, 0.05) FILTER (y = 0) AS llo, quantile_cont({f}, 0.95) FILTER (y = 0) AS lhi,
        count({f}) FILTER (y = 1) AS nf, count({f}) FILTER (y = 0) AS nl FROM guarded"""
        for f in GUARDED
    )
    + ")",
    guarded=GUARD_ROWS,
)
def _disjoint(t):
    out = m.disjoint_range_guard(_guard_rows(t), GUARDED)
    return out.select("feature", "disjoint", *[r(c, 4).alias(c) for c in ("fraud_lo", "fraud_hi", "legit_lo", "legit_hi")])


FID = ["amount", "auth_latency_ms", "session_duration_s", "beneficiary_added_ago_s"]


def _fid_sql() -> str:
    cols = []
    for f in FID:
        v = f"coalesce({f}, 0)"
        cols.append(f"coalesce(nullif(stddev_pop({v}), 0), 1) AS s_{f}")
        for g, cond in (("f", "y = 1"), ("k", "y = 0 AND lookalike = 1"), ("l", "y = 0 AND coalesce(lookalike, 0) = 0")):
            cols.append(f"avg({v}) FILTER ({cond}) AS {g}m_{f}, stddev_pop({v}) FILTER ({cond}) AS {g}s_{f}")
    return "SELECT " + ", ".join(cols) + " FROM guarded"


def _dist(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"power(({a}m_{f} - {b}m_{f}) / s_{f}, 2)" for f in FID) + ")"


_OVERLAP = (
    "("
    + " + ".join(
        f"CASE WHEN fm_{f} + fs_{f} + 1e-6 < km_{f} - ks_{f} - 1e-6 OR km_{f} + ks_{f} + 1e-6 < fm_{f} - fs_{f} - 1e-6 THEN 0 ELSE 1 END"
        for f in FID
    )
    + f") * 100e0 / {len(FID)}"
)


@query(
    "lookalike_fidelity",
    "D-26 D-27",
    f"""SELECT {sr('fk')} AS fraud_to_lookalike, {sr('fl')} AS fraud_to_legit, {sr('kl')} AS lookalike_to_legit, {sr('ov')} AS feature_overlap_pct,
    {sr('ratio', 4)} AS separation_ratio, CASE WHEN ratio > 1.5 OR ov < 30 THEN 'FAIL' WHEN ratio > 1 OR ov < 50 THEN 'BORDERLINE' ELSE 'PASS' END AS status
    FROM (SELECT *, fk / (kl + 1e-6) AS ratio FROM (SELECT {_dist('f', 'k')} AS fk, {_dist('f', 'l')} AS fl, {_dist('k', 'l')} AS kl, {_OVERLAP} AS ov FROM fid))""",
    guarded=GUARD_ROWS,
    fid=_fid_sql(),
)
def _fidelity(t):
    out = m.lookalike_fidelity(_guard_rows(t), FID)
    return rounded(out, ["status", r("separation_ratio", 4).alias("separation_ratio")],
                   ["fraud_to_lookalike", "fraud_to_legit", "lookalike_to_legit", "feature_overlap_pct"])


_DIV = " + ".join(f"power((coalesce(a.{f}, 0) - coalesce(b.{f}, 0)) / s_{f}, 2)" for f in FID)


@query(
    "family_diversity",
    "D-28",
    f"""SELECT count(*) FILTER (fa = fb) AS n_families, {sr('avg(rms) FILTER (fa = fb)')} AS avg_intra, {sr('avg(rms) FILTER (fa < fb)')} AS avg_inter,
    {sr('avg(rms) FILTER (fa < fb) / avg(rms) FILTER (fa = fb)')} AS separation_ratio FROM (
    SELECT a.family AS fa, b.family AS fb, sqrt(avg({_DIV})) AS rms FROM fraud a JOIN fraud b ON a.family <= b.family AND a.txn_id <> b.txn_id, scales
    GROUP BY a.family, b.family)""",
    guarded=GUARD_ROWS,
    fraud="SELECT * FROM guarded WHERE y = 1",
    scales="SELECT " + ", ".join(f"coalesce(nullif(stddev_pop(coalesce({f}, 0)), 0), 1) AS s_{f}" for f in FID) + " FROM fraud",
)
def _diversity(t):
    rows = _guard_rows(t).filter("y = 1")
    return rounded(m.family_diversity(rows, FID, "family"), ["n_families"], ["avg_intra", "avg_inter", "separation_ratio"])


_NUMBER = "(cast(substr(txn_id, 2) as bigint) * 2654435761 % 1048573)"
_PAIR = "SELECT least(a.family, b.family) AS fa, greatest(a.family, b.family) AS fb, sqrt(" + _DIV + ") AS far"
_MEANS = ", ".join(
    f"avg(m) FILTER ({w}) AS avg_{n}, sqrt(sum(v) FILTER ({w})) / count(*) FILTER ({w}) AS {n}_error" for n, w in (("intra", "fa = fb"), ("inter", "fa < fb"))
)


@query(
    "mean_pair_distance",
    "D-28",
    f"""SELECT n_families, {', '.join(sr(x) + ' AS ' + x for x in ('avg_intra', 'intra_error', 'avg_inter', 'inter_error'))}, {sr('avg_inter / avg_intra')} AS separation_ratio FROM (
    SELECT count(*) FILTER (fa = fb) AS n_families, {_MEANS} FROM (SELECT fa, fb, avg(far) AS m, coalesce(var_samp(far) / count(*), 0) AS v FROM (
    {_PAIR} FROM asked a JOIN asked b ON a.family = b.family AND b.s = 1 AND a.s < a.n AND b.i = (a.i + a.s) % a.n, scales
    UNION ALL {_PAIR} FROM asked a JOIN asked b ON b.s = 1 AND b.k = (a.k + 1 + (a.i + a.s) % (a.f - 1)) % a.f AND b.i = (a.i + a.s) % b.n, scales) GROUP BY fa, fb))""",
    guarded=GUARD_ROWS,
    fraud="SELECT * FROM guarded WHERE y = 1",
    placed=f"SELECT *, row_number() OVER (PARTITION BY family ORDER BY {_NUMBER}, txn_id) - 1 AS i, count(*) OVER (PARTITION BY family) AS n FROM fraud",
    asked="SELECT *, dense_rank() OVER (ORDER BY family) - 1 AS k, (SELECT count(DISTINCT family) FROM placed WHERE n > 1) AS f, unnest(range(1, 9)) AS s FROM placed WHERE n > 1",
    scales="SELECT " + ", ".join(f"coalesce(nullif(stddev_pop(coalesce({f}, 0)), 0), 1) AS s_{f}" for f in FID) + " FROM fraud",
)
def _pair_distance(t):
    rows = _guard_rows(t).filter("y = 1")
    out = m.mean_pair_distance(rows, FID, "family", order=F.expr(_NUMBER))
    return rounded(out, ["n_families"], ["avg_intra", "intra_error", "avg_inter", "inter_error", "separation_ratio"])


@query(
    "class_weights",
    "D-33",
    f"SELECT family, n, {sr('sum(n) OVER () / (count(*) OVER () * cast(n as double))')} AS weight FROM (SELECT family, count(*) AS n FROM scored GROUP BY family)",
)
def _weights(t):
    return rounded(m.class_weights(t.scored, "family"), ["family", "n"], ["weight"])


@query("positive_weight", "D-33", f"SELECT {sr('sum(1 - y) / cast(sum(y) as double)')} AS scale_pos_weight FROM scored")
def _pos_weight(t):
    return rounded(m.positive_weight(t.scored), [], ["scale_pos_weight"])


@query(
    "prevalence_adjusted",
    "D-40",
    f"SELECT {RATES.replace('as double', 'as double')}, pr_auc, roc_auc FROM conf, (SELECT {sr(PR_SQL)} AS pr_auc, {sr(ROC_SQL)} AS roc_auc FROM wcurve)",
    w="SELECT 0.035e0 / (1 - 0.035e0) * sum(1 - y) / sum(y) AS w FROM scored",
    conf="""SELECT sum(CASE WHEN score >= 0.5e0 AND y = 1 THEN w ELSE 0 END) AS tp, sum(CASE WHEN score >= 0.5e0 AND y = 0 THEN 1e0 ELSE 0 END) AS fp,
    sum(CASE WHEN score < 0.5e0 AND y = 1 THEN w ELSE 0 END) AS fn, sum(CASE WHEN score < 0.5e0 AND y = 0 THEN 1e0 ELSE 0 END) AS tn FROM scored, w""",
    wcurve="""SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS n_pos,
    sum(neg) OVER () AS n_neg FROM (SELECT score, sum(y * w) AS pos, sum(1 - y) AS neg FROM scored, w GROUP BY score)""",
)
def _prevalence(t):
    return rounded(m.at_prevalence(t.scored), [], [*RATE_SQL, "pr_auc", "roc_auc"])


REPORT = """SELECT coalesce(a.class, b.class) AS class, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(called, 0) AS called FROM
 (SELECT family AS class, count(*) AS support, count(*) FILTER (family = pred_family) AS tp FROM attacks GROUP BY 1) a FULL JOIN
 (SELECT pred_family AS class, count(*) AS called FROM attacks GROUP BY 1) b ON a.class = b.class"""
_F1 = "CASE WHEN called + support > 0 THEN 2 * tp / cast(called + support as double) ELSE 0 END"


@query(
    "class_report",
    "J-6",
    f"""SELECT class, support, tp, {sr('CASE WHEN called > 0 THEN tp / cast(called as double) ELSE 0 END')} AS precision,
    {sr('CASE WHEN support > 0 THEN tp / cast(support as double) ELSE 0 END')} AS recall, {sr(_F1)} AS f1 FROM report""",
    attacks="SELECT * FROM scored WHERE y = 1",
    report=REPORT,
)
def _report(t):
    return rounded(m.class_report(t.scored.filter("y = 1")), ["class", "support", "tp"], ["precision", "recall", "f1"])


@query(
    "class_summary",
    "J-6",
    f"SELECT {sr('sum(tp) / cast(sum(support) as double)')} AS accuracy, {sr(f'avg({_F1})')} AS macro_f1, {sr(f'sum({_F1} * support) / sum(support)')} AS weighted_f1 FROM report",
    attacks="SELECT * FROM scored WHERE y = 1",
    report=REPORT,
)
def _summary(t):
    return rounded(m.class_summary(m.class_report(t.scored.filter("y = 1"))), [], ["accuracy", "macro_f1", "weighted_f1"])


@query(
    "promotion_gate",
    "J-8",
    f"""SELECT {sr('a.pr')} AS new_pr_auc, {sr('b.pr')} AS old_pr_auc, {sr('b.pr - a.pr')} AS regression,
    CASE WHEN b.pr - a.pr > 0.02e0 THEN 'rejected' ELSE 'passed' END AS decision
    FROM (SELECT {PR_SQL} AS pr FROM curve WHERE generation = 'gen5') a, (SELECT {PR_SQL} AS pr FROM curve WHERE generation = 'gen3') b""",
    curve=_curve("generation"),
)
def _gate(t):
    areas = m.area_metrics(t.scored, by=["generation"])
    out = m.promotion_gate(areas.filter("generation = 'gen5'"), areas.filter("generation = 'gen3'"))
    return rounded(out, ["decision"], ["new_pr_auc", "old_pr_auc", "regression"])


@query(
    "validation_carve_out",
    "J-3",
    f"""SELECT txn_id, CASE WHEN split = 'train' AND h < 1500 THEN 'validation' ELSE split END AS split FROM (
    SELECT txn_id, CASE {SPLIT_CASE} WHEN 'test' THEN 'test' ELSE 'train' END AS split, cast(substr(txn_id, 2) as bigint) * 48271 % 2147483647 % 10000 AS h FROM payments)""",
)
def _carve(t):
    split = assign_split("ts_us", split_windows(START_US, END_US))
    rows = t.payments.select("txn_id", F.when(split == "test", "test").otherwise("train").alias("split"))
    number = F.substring("txn_id", 2, 12).cast("long")
    return sampling.carve_validation(rows, number * 48271 % 2147483647, 0.15).select("txn_id", "split")
