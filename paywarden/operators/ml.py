"""Training, evaluation and stress tests of the fraud model with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    OneVsRest,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paywarden.operators import metrics
from paywarden.operators.quantiles import value_counts
from paywarden.operators.sampling import ensure_evaluation_splits
from paywarden.operators.scan import MAX_ROWS_PER_TASK, Metric, find_hot_keys, prefix_scan
from paywarden.schema import (
    ALL_FEATURES,
    BEHAVIORAL_FEATURES,
    BOOLEAN_FEATURES,
    CATEGORICAL_FEATURES,
    GRAPH_FEATURES,
    NUMERICAL_FEATURES,
)
from paywarden.session import cut_lineage

NUMERIC = NUMERICAL_FEATURES + BOOLEAN_FEATURES + BEHAVIORAL_FEATURES + GRAPH_FEATURES
# A pass of a fit over fewer rows costs more to schedule than to run.
ROWS_PER_FIT_TASK = 16_384
# Fits have hundreds of passes: more tasks than fill the cores twice only cost, unless one would hold too many rows.
MAX_ROWS_PER_FIT_TASK = 250_000


def fit_tasks(rows: int, cores: int) -> int:
    """Tasks of a pass over so many rows."""
    return max(1, min(math.ceil(rows / ROWS_PER_FIT_TASK), 2 * cores), math.ceil(rows / MAX_ROWS_PER_FIT_TASK))


def to_iterate(df: DataFrame) -> DataFrame:
    """Rows for a fit of many passes: written once, so that no pass ships their plan, in no more tasks than they fill, and kept."""
    rows = cut_lineage(df)
    return rows.coalesce(fit_tasks(rows.count(), df.sparkSession.sparkContext.defaultParallelism)).persist()


def prepare(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Model inputs as text (missing value spelled out) and doubles; absent columns become missing."""

    def source(c: str) -> Column:
        return F.col(c) if c in df.columns else F.lit(None)

    text = {c: F.coalesce(source(c).cast("string"), F.lit("missing")) for c in categorical}
    numbers = {c: source(c).cast("double") for c in numeric}
    return df.withColumns({**text, **numbers})


def preprocessing(categorical: Sequence[str], numeric: Sequence[str]) -> list:
    """One-hot categories (unknown ones kept apart), median-filled and scaled numbers."""
    stages = []
    if categorical:
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep"),
            OneHotEncoder(
                inputCols=[f"{c}_ix" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], handleInvalid="keep"
            ),
        ]
    return stages + [
        Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}_fill" for c in numeric]),
        VectorAssembler(inputCols=[f"{c}_fill" for c in numeric], outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["scaled", *[f"{c}_hot" for c in categorical]], outputCol="features"),
    ]


def usable_features(train: DataFrame, candidates: Sequence[str], ranged: Sequence[str], label: str = "y") -> list[str]:
    """Candidates that neither absence nor range alone gives away."""
    present = [c for c in candidates if c in train.columns]
    bad = {r["feature"] for r in metrics.missingness_guard(train, present, label).filter("leaky").collect()}
    numbers = [c for c in ranged if c in present and c not in bad]
    if numbers:
        bad |= {r["feature"] for r in metrics.disjoint_range_guard(train, numbers, label).filter("disjoint").collect()}
    return [c for c in present if c not in bad]


def balanced_weight(df: DataFrame, label: str = "y", out: str = "weight") -> DataFrame:
    """Weight each class by n / (k * n_c)."""
    weights = metrics.class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(weights), label)


@dataclass
class FraudModel:
    """A fitted preprocessing and classifier with its chosen threshold."""

    preprocessor: PipelineModel
    classifier: object
    categorical: list[str]
    numeric: list[str]
    threshold: float = 0.5

    def save(self, path: str, version: int = 1) -> None:
        """Write the fitted stages and what ``load`` needs besides, below ``path``; an older model there is replaced."""
        spark = SparkSession.getActiveSession()
        self.preprocessor.write().overwrite().save(f"{path}/preprocessor")
        self.classifier.write().overwrite().save(f"{path}/classifier")
        about = (type(self.classifier).__name__, list(self.categorical), list(self.numeric), self.threshold, version)
        schema = "classifier string, categorical array<string>, numeric array<string>, threshold double, version int"
        spark.createDataFrame([about], schema).coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FraudModel:
        (about,) = spark.read.json(f"{path}/about").collect()
        kinds = {c.__name__: c for c in (LogisticRegressionModel, RandomForestClassificationModel, GBTClassificationModel)}
        row = about.asDict()
        return FraudModel(
            PipelineModel.load(f"{path}/preprocessor"), kinds[row["classifier"]].load(f"{path}/classifier"),
            list(row.get("categorical") or []), list(row.get("numeric") or []), row["threshold"],
        )

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Fraud probability of each row; works on streams too."""
        ready = self.preprocessor.transform(prepare(df.select("*"), self.categorical, self.numeric))
        scored = self.classifier.transform(ready).withColumn(out, vector_to_array("probability")[1])
        keep = [F.col(c) for c in df.columns if c not in self.categorical and c not in self.numeric]
        return scored.select(*keep, *[c for c in (*self.categorical, *self.numeric) if c in df.columns], out)


def classifiers(trees: int = 100, rounds: int = 150, depth: int = 6, seed: int = 42) -> dict[str, object]:
    common = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}
    return {
        "logistic_regression": LogisticRegression(maxIter=100, **common),
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **common),
        "boosted_trees": GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed, **common),
    }


def train_fraud_model(
    df: DataFrame,
    categorical: Sequence[str] = CATEGORICAL_FEATURES,
    numeric: Sequence[str] = NUMERIC,
    models: Mapping[str, object] | None = None,
    guard: bool = True,
) -> tuple[FraudModel, DataFrame, DataFrame]:
    """Fit all candidates, keep the boosted trees, tune the threshold on validation.

    ``df`` has ``split`` (train / validation / test), ``y`` and ``txn_id``. Without
    validation rows 15 % of the training rows, chosen by hash, become them; without
    test rows validation stands in. Returns the model, the validation comparison and
    the scored test rows.
    """
    df = ensure_evaluation_splits(df, F.pmod(F.xxhash64("txn_id"), F.lit(10_000)))
    train = df.filter("split = 'train'")
    kinds = train.select("y").distinct().limit(2).count()
    if kinds < 2:
        raise ValueError("training needs rows of both classes in the split 'train'")
    keep = usable_features(train, [*categorical, *numeric], numeric) if guard else [*categorical, *numeric]
    cats, nums = [c for c in categorical if c in keep], [c for c in numeric if c in keep]
    prepared = prepare(df, cats, nums).select("txn_id", "y", "split", *cats, *nums)
    train = balanced_weight(prepared.filter("split = 'train'"))
    pre = Pipeline(stages=preprocessing(cats, nums)).fit(train)
    ready = to_iterate(pre.transform(train).select("y", "weight", "features"))
    validation = to_iterate(pre.transform(prepared.filter("split = 'validation'")).select("txn_id", "y", "features"))
    rows, fitted = [], {}
    for name, estimator in (models or classifiers()).items():
        fitted[name] = estimator.fit(ready)
        scored = fitted[name].transform(validation).select("y", vector_to_array("probability")[1].alias("score"))
        rows.append(metrics.area_metrics(scored).withColumn("model", F.lit(name)))
    comparison = reduce(DataFrame.unionByName, rows)
    chosen = fitted.get("boosted_trees") or next(iter(fitted.values()))
    scored = chosen.transform(validation).select("y", vector_to_array("probability")[1].alias("score"))
    best = metrics.best_threshold(metrics.threshold_sweep(scored)).first()
    model = FraudModel(pre, chosen, cats, nums, float(best["threshold"]))
    comparison = df.sparkSession.createDataFrame(comparison.collect(), comparison.schema)  # one row per model
    ready.unpersist()
    validation.unpersist()
    extra = [c for c in ("attack_id", "family", "campaign_id") if c in df.columns]
    test = model.score(df.filter("split = 'test'")).select("txn_id", "y", "score", *extra)
    return model, comparison, test


def evaluation_bundle(scored: DataFrame, threshold: float, held_out: str | None = None) -> DataFrame:
    """One nested row: areas, Brier, operating points, held-out recall, confusion at the threshold."""
    points = metrics.operating_points(scored)
    parts = [
        metrics.area_metrics(scored),
        metrics.brier(scored),
        points.agg(F.sort_array(F.collect_list(F.struct("target_fpr", "threshold", "achieved_fpr", "precision", "recall"))).alias("fixed_fpr")),
        metrics.confusion(scored, threshold).select(F.struct("*").alias("at_threshold")),
    ]
    if held_out is not None:
        recall = metrics.held_out_recall(scored, points, held_out)
        parts.append(recall.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("held_out")))
    return reduce(lambda a, b: a.crossJoin(b), parts)


def feature_importances(model: FraudModel, k: int = 10, at_least: float | None = None) -> DataFrame:
    """The most important features; one-hot columns add up to their category."""
    weights = model.classifier.featureImportances.toArray()
    names = list(model.numeric)
    indexer = next((s for s in model.preprocessor.stages if hasattr(s, "labelsArray")), None)
    for c, labels in zip(model.categorical, indexer.labelsArray if indexer else [], strict=False):
        # The one-hot vector has a slot per label and one for unknown values.
        names += [c] * (len(labels) + 1)
    rows = [(n, float(w)) for n, w in zip(names, weights, strict=False)]
    out = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    out = out.groupBy("feature").agg(F.sum("importance").alias("importance"))
    if at_least is not None:
        out = out.filter(F.col("importance") >= at_least)
    return out.orderBy(F.col("importance").desc(), "feature").limit(k)


def train_attack_classifier(
    df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], label: str = "family", trees: int = 100, rounds: int = 20, depth: int = 6
) -> tuple[str, DataFrame, DataFrame]:
    """Random forest against one-vs-rest boosted trees; the better macro F1 on test wins.

    ``df`` holds fraud rows with ``split``. Returns the winner's name, the
    comparison, and the winner's predictions on test as (family, pred_family).
    """
    train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
    indexer = StringIndexer(inputCol=label, outputCol="class_ix", handleInvalid="skip").fit(train)
    labels = F.array(*[F.lit(x) for x in indexer.labels])
    pre = Pipeline(stages=preprocessing(categorical, numeric)).fit(prepare(train, categorical, numeric))

    def ready(rows: DataFrame) -> DataFrame:
        return pre.transform(prepare(rows, categorical, numeric))

    fit_on = to_iterate(balanced_weight(indexer.transform(ready(train)), "class_ix").select("class_ix", "weight", "features"))
    on_test = to_iterate(ready(test).select("txn_id", F.col(label).alias("family"), "features"))
    candidates = {
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42, labelCol="class_ix", weightCol="weight"),
        "boosted_trees": OneVsRest(
            classifier=GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=42), labelCol="class_ix", weightCol="weight", parallelism=4
        ),
    }
    predictions, rows = {}, []
    for name, estimator in candidates.items():
        predicted = estimator.fit(fit_on).transform(on_test)
        predictions[name] = predicted.select("txn_id", "family", labels[F.col("prediction").cast("int")].alias("pred_family"))
        summary = metrics.class_summary(metrics.class_report(predictions[name])).withColumn("model", F.lit(name))
        rows.append(summary)
    comparison = reduce(DataFrame.unionByName, rows)
    collected = comparison.collect()  # one row per model
    scores = {r["model"]: r["macro_f1"] or 0.0 for r in collected}
    winner = "boosted_trees" if scores["boosted_trees"] > scores["random_forest"] else "random_forest"
    return winner, df.sparkSession.createDataFrame(collected, comparison.schema), predictions[winner]


def occlusion_attribution(model: FraudModel, rows: DataFrame, features: Sequence[str], id_column: str = "txn_id") -> DataFrame:
    """Change of the score when one numeric feature is set to its median.

    Each row is repeated once per feature and scored in the same pass.
    """
    medians = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), 0.5).alias(f) for f in features]).first()
    names = F.array(F.lit(""), *[F.lit(f) for f in features])
    repeated = rows.select("*", F.explode(names).alias("_masked"))
    replaced = {
        f: F.when(F.col("_masked") == f, F.lit(medians[f])).otherwise(F.col(f).cast("double")) for f in features
    }
    scored = model.score(repeated.withColumns(replaced)).select(id_column, "_masked", "score")
    return scored.groupBy(id_column).agg(
        F.max(F.when(F.col("_masked") == "", F.col("score"))).alias("score"),
        F.collect_list(F.when(F.col("_masked") != "", F.struct("_masked", F.col("score").alias("s")))).alias("_m"),
    ).select(
        id_column,
        "score",
        F.transform(
            "_m", lambda e: F.struct(e["_masked"].alias("name"), (F.col("score") - e["s"]).alias("contribution"))
        ).alias("contributions"),
    )


def uniform(id_column: str, name: str, lo: float = 0.0, hi: float = 1.0, seed: int = 42) -> Column:
    """A repeatable draw per row and name."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col(id_column)), F.lit(1 << 30)) / float(1 << 30)
    return lo + (hi - lo) * u


def draw_from(
    rows: DataFrame,
    pool: DataFrame,
    features: Sequence[str],
    id_column: str = "txn_id",
    seed: int = 42,
    unit: Callable[[str], Column] | None = None,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Add ``_drawn_<feature>``, a value of the pool's column at a random place of its order.

    The distinct values of a column are counted once and put in order; a row picks a
    place in [0, n) and reads the value that covers it from a scan over values and
    picks, so neither the pool is ordered nor are pairs formed. ``unit`` gives the draw
    in [0, 1) for a feature. A feature without values in the pool draws null.
    """
    c = F.col
    unit = unit or (lambda f: uniform(id_column, f"pick {f}", seed=seed))
    sizes = pool.agg(*[F.count(f).alias(f) for f in features]).first() if features else None
    for f in features:
        n, kind = sizes[f], pool.schema[f].dataType
        if not n:
            rows = rows.withColumn(f"_drawn_{f}", F.lit(None).cast(kind))
            continue
        values = value_counts(pool, [], f, max_rows).select(
            c("_below").alias("_at"), F.lit(0).alias("_kind"), F.lit("").alias("_id"), c(f).alias("_value")
        )
        picks = rows.select(
            F.floor(unit(f) * F.lit(n)).cast("long").alias("_at"), F.lit(1).alias("_kind"), c(id_column).cast("string").alias("_id"),
            F.lit(None).cast(kind).alias("_value"), F.struct(*[c(x) for x in rows.columns]).alias("_row"),
        )
        events = picks.unionByName(values, allowMissingColumns=True)
        # Both parts are counted, as either may be too large for one task.
        hot = find_hot_keys(events, [], "_at", max_rows)
        found = prefix_scan(events, [], ["_at", "_kind", "_id"], {"_last": Metric("last", c("_value"))}, hot)
        rows = found.filter("_kind = 1").select("_row.*", c("_last").alias(f"_drawn_{f}"))
    return rows


def with_drawn(drawn: DataFrame, features: Sequence[str]) -> DataFrame:
    """Put the drawn values of these features in place and drop all draws; null draws change nothing."""
    out = drawn.withColumns({f: F.coalesce(f"_drawn_{f}", f) for f in features})
    return out.drop(*[x for x in drawn.columns if x.startswith("_drawn_")])


def mask_features(
    fraud: DataFrame, legit: DataFrame, features: Sequence[str], id_column: str = "txn_id", seed: int = 42
) -> DataFrame:
    """Replace features of fraud rows by values drawn from the legitimate column."""
    return with_drawn(draw_from(fraud, legit, features, id_column, seed), features)


# How many of the top features each stress level hides.
MASK_LEVELS = {"level_1_easy": 1, "level_2_medium": 2, "level_3_hard": 3, "level_4_extreme": 5}

# Column overrides of the stress matrix. A number sets the column, a
# pair draws between the two ends, ("scale", lo, hi) multiplies the column, ("one of", ...)
# draws a member, ("days", lo, hi) draws
# whole days in seconds, ("times", column, k) takes a multiple of another column, and PARAMETER is
# the value given with the name, at most the number beside it.
PARAMETER = "parameter"
OVERRIDES = {
    "use_single_top_counterparty": {"edge_count": 2, "payer_out_degree": 2, "is_two_hop_passthrough": 0},
    "increase_velocity": {"txn_count_last_1h": 5, "txn_count_last_24h": 12},
    "use_existing_payee_pool": {"beneficiary_added_ago_s": 7_776_000},
    "vary_amounts_significantly": {"amount": ("scale", 0.5, 2.0), "amount_deviation": (1.5, 3.0)},
    "change_timing_pattern": {"time_since_prev_txn": (60, 3600), "tx_hour": (0, 24)},
    "use_known_device": {"device_is_known_for_payer": 1},
    "use_proxy_ip": {"ip_is_proxy": 1, "new_ip_indicator": 1},
    "mix_small_and_large": {"subthreshold_txn_ratio": (0.2, 0.4), "txn_count_last_24h": (8, 15)},
    "distribute_across_payees": {"payer_out_degree": (5, 10), "edge_count": (4, 8)},
    "concentrate_in_largest_transaction": {"amount": ("scale", 3.0, 3.0)},
    "slow_transaction_rate": {"txn_count_last_1h": 1, "txn_count_last_24h": 2},
    "high_friction_indicators": {"time_on_confirm_screen_s": (30, 120), "pin_attempts": (2, 4)},
    # Those of attacks that mix families.
    "rapid_txn_sequence": {"txn_count_last_1h": 4, "txn_count_last_24h": 8},
    "small_amounts": {"amount": (0.99, 9.99), "amount_spent_last_1h": ("times", "amount", 3.0)},
    "use_old_created_account": {"new_account_age_s": 5_184_000},
    "feature_spoofing_enabled": {"address_change_recent": 0},
    "gradual_velocity_increase": {"txn_count_last_7d": (15, 25), "txn_count_last_24h": (5, 10)},
    "final_large_txn": {"amount": ("scale", 5.0, 5.0)},
    "ip_change_subtle": {"new_ip_indicator": 1, "ip_is_proxy": 0},
    "establish_mule_chain": {"payer_out_degree": (4, 8), "edge_count": (3, 7)},
    "timing_mimics_user": {"time_since_prev_txn": (120, 1200), "tx_hour": ("one of", 9, 10, 14, 15, 20, 21)},
    "use_multiple_mules": {"unique_beneficiaries_last_7d": (6, 12)},
    "initial_probe_phase": {"txn_count_last_1h": 5},
    "transition_to_large": {"amount": (100.0, 500.0)},
    "spoof_multiple_features": {"beneficiary_added_ago_s": ("days", 30, 365)},
    "add_friction_indicators": {"pin_attempts": (2, 4), "time_on_confirm_screen_s": (30, 120)},
    "obscure_final_destination": {"unique_beneficiaries_last_7d": (8, 15)},
    "amount_range": {"amount": (PARAMETER,)},
    "probe_count": {"txn_count_last_24h": (PARAMETER,)},
    "final_amount_multiplier": {"amount": (PARAMETER, "scale")},
    "num_mule_hops": {"edge_count": (PARAMETER, 10)},
}


def apply_overrides(
    rows: DataFrame, names: Sequence[str | tuple[str, object]], id_column: str = "txn_id", seed: int = 42
) -> DataFrame:
    """Apply the named overrides in order; a feature that the rows lack is an error.

    Columns that are no features of the models, such as ``txn_count_last_7d``, are added. A name that needs a value comes as ``(name, value)``; ``amount_range`` takes a pair.
    Later columns of an override read the earlier ones as already changed.
    """
    for entry in names:
        name, value = entry if isinstance(entry, tuple) else (entry, None)
        for column, spec in OVERRIDES[name].items():
            if column not in rows.columns and column in ALL_FEATURES:
                raise ValueError(f"override {name} needs the column {column}")
            if isinstance(spec, tuple) and spec[0] == PARAMETER:
                if value is None:
                    raise ValueError(f"override {name} needs a value")
                if spec[1:] == ("scale",):
                    spec = ("scale", float(value), float(value))
                elif isinstance(value, (tuple, list)):
                    spec = (float(value[0]), float(value[1]))
                else:
                    spec = min(value, *spec[1:]) if spec[1:] else value
            if not isinstance(spec, tuple):
                change = F.lit(float(spec))
            elif spec[0] == "scale":
                change = F.col(column).cast("double") * uniform(id_column, f"{name} {column}", spec[1], spec[2], seed)
            elif spec[0] == "times":
                change = F.col(spec[1]).cast("double") * spec[2]
            elif spec[0] == "days":
                change = F.floor(uniform(id_column, f"{name} {column}", spec[1], spec[2], seed)).cast("double") * 86_400
            elif spec[0] == "one of":
                place = F.floor(uniform(id_column, f"{name} {column}", 0, len(spec) - 1, seed)).cast("int")
                change = F.array(*[F.lit(float(x)) for x in spec[1:]])[place]
            else:
                draw = uniform(id_column, f"{name} {column}", spec[0], spec[1], seed)
                whole = isinstance(spec[0], int) and isinstance(spec[1], int)
                change = F.floor(draw).cast("double") if whole else draw
            rows = rows.withColumn(column, change)
    return rows


def vary_features(
    rows: DataFrame, features: Sequence[str], share: float = 0.08, band: tuple[float, float] = (0.85, 1.15), id_column: str = "txn_id", seed: int = 42
) -> DataFrame:
    """Scale a share of the floating-point values of each row, chosen and drawn by hash."""
    floats = [f for f in features if rows.schema[f].dataType.typeName() in ("double", "float")]
    return rows.withColumns({
        f: F.when(uniform(id_column, f"vary {f}", seed=seed) < share, F.col(f) * uniform(id_column, f"by {f}", *band, seed)).otherwise(F.col(f))
        for f in floats
    })


def stress_matrix(model: FraudModel, variants: Mapping[str, DataFrame], threshold: float = metrics.EVASION_THRESHOLD) -> DataFrame:
    """Evasion of each variant of the fraud rows; all of them are scored in one pass."""
    inputs = [*model.categorical, *model.numeric]
    rows = [prepare(df, model.categorical, model.numeric).select(*inputs, F.lit(name).alias("generation")) for name, df in variants.items()]
    # The model would be planned once per variant if its columns moved below the union; an observed plan is not crossed.
    together = reduce(DataFrame.unionByName, rows).observe(Observation(), F.count("*").alias("n"))
    return metrics.evasion(model.score(together).select("score", "generation"), threshold)


def cluster_families(rows: DataFrame, numeric: Sequence[str], k_max: int = 6, seed: int = 42) -> DataFrame:
    """Silhouette and cost of k-means for each k, and the variance two components explain."""
    pre = Pipeline(stages=preprocessing([], numeric))
    # The stages that are fitted read the rows once each; what they come from is run once.
    base = prepare(rows, [], numeric).select(*numeric).persist()
    ready = pre.fit(base).transform(base).select("features").persist()
    spark = rows.sparkSession
    found = []
    for k in range(2, k_max + 1):
        model = KMeans(k=k, seed=seed, featuresCol="features").fit(ready)
        score = ClusteringEvaluator(featuresCol="features").evaluate(model.transform(ready))
        found.append((k, float(score), float(model.summary.trainingCost)))
    explained = PCA(k=2, inputCol="features", outputCol="pc").fit(ready).explainedVariance.toArray()
    ready.unpersist()
    base.unpersist()
    best = max(found, key=lambda x: (x[1], -x[0]))[0]
    table = [(k, s, c, k == best, float(explained[0]), float(explained[1])) for k, s, c in found]
    return spark.createDataFrame(
        table, "k int, silhouette double, cost double, best boolean, pc1_variance double, pc2_variance double"
    )
