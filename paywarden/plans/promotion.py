"""Promotion of a retrained model as one commit.

A store is a folder with ``versions/version=N`` (the fitted stages),
``used_verdicts/version=N`` (the verdicts that trained it) and ``commits/commit=N``
(one JSON row that names a version and its metrics). The commit is written last and
nothing is ever moved: readers see the version of the latest commit, so a run that
ends early leaves the live model and the pending verdicts as they were, and running
it again writes the same folders anew. One promotion runs at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden.operators.ml import FraudModel
from paywarden.sources.dataset import _read_if_there

COMMIT_SCHEMA = (
    "version INT, model_name STRING, committed_at STRING, split_methodology STRING, held_out STRING, threshold DOUBLE,"
    " pr_auc DOUBLE, decision STRING"
)
VERDICT_KEY = ["transaction_id", "ts_us", "analyst_verdict"]


@dataclass(frozen=True)
class ModelStore:
    """The versions of a model below ``folder``."""

    folder: str

    def history(self, spark: SparkSession) -> DataFrame:
        """All commits, one row each."""
        schema = f"{COMMIT_SCHEMA}, commit INT"
        if _read_if_there(spark, f"{self.folder}/commits", "text") is None:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).json(f"{self.folder}/commits")

    def live(self, spark: SparkSession) -> dict | None:
        """The latest commit; None before the first one."""
        row = self.history(spark).orderBy(F.col("commit").desc()).first()
        return row.asDict() if row else None

    def load(self, spark: SparkSession) -> FraudModel:
        live = self.live(spark)
        if live is None:
            raise FileNotFoundError(f"no model has been promoted in {self.folder}")
        return FraudModel.load(spark, self._version(live["version"]))

    def deployed(self, spark: SparkSession) -> DataFrame | None:
        """The live model's areas for the promotion gate."""
        live = self.live(spark)
        return None if live is None else spark.createDataFrame([(live["pr_auc"],)], "pr_auc double")

    def pending(self, verdicts: DataFrame) -> DataFrame:
        """Verdicts that no promoted version was trained on."""
        spark = verdicts.sparkSession
        used = _read_if_there(spark, f"{self.folder}/used_verdicts")
        if used is None:
            return verdicts
        used = used.join(self.history(spark).select("version").distinct(), "version", "left_semi")
        used = used.select(*[F.col(k).alias(f"_u_{k}") for k in VERDICT_KEY]).distinct()
        on = [verdicts[k].eqNullSafe(used[f"_u_{k}"]) for k in VERDICT_KEY]
        return verdicts.join(used, on, "left_anti")

    def promote(
        self, model: FraudModel, gate: DataFrame, verdicts: DataFrame, held_out: str | None = None, name: str = "fraud_model"
    ) -> int | None:
        """Make the model the live one unless its gate rejects it; returns its version.

        ``gate`` is the row of ``promotion_gate``. A rejected model writes nothing, so
        its verdicts stay pending.
        """
        spark = verdicts.sparkSession
        passed = gate.first()
        if passed["decision"] == "rejected":
            return None
        last = self.history(spark).agg(F.max("version"), F.max("commit")).first()
        version = (last[0] or 0) + 1
        model.save(self._version(version), version)
        keys = verdicts.select(*VERDICT_KEY)
        keys.write.mode("overwrite").parquet(f"{self.folder}/used_verdicts/version={version}")
        self._commit(
            spark, (last[1] or 0) + 1,
            (version, name, datetime.now(UTC).isoformat(), "temporal + analyst verdicts", held_out, model.threshold,
             passed["new_pr_auc"], passed["decision"]),
        )
        return version

    def roll_back(self, spark: SparkSession, version: int) -> None:
        """Make an earlier version the live one, by a commit of its own."""
        old = self.history(spark).filter(F.col("version") == version).orderBy("commit").first()
        if old is None:
            raise ValueError(f"version {version} was never promoted")
        commit = self.live(spark)["commit"] + 1
        row = {**old.asDict(), "committed_at": datetime.now(UTC).isoformat(), "decision": "rolled back"}
        row.pop("commit")
        self._commit(spark, commit, tuple(row.values()))

    def _version(self, version: int) -> str:
        return f"{self.folder}/versions/version={version}"

    def _commit(self, spark: SparkSession, commit: int, row: tuple) -> None:
        spark.createDataFrame([row], COMMIT_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{self.folder}/commits/commit={commit}")
