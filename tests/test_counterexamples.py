"""Cases that earlier versions of an operator got wrong."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from paywarden.operators import detectors as d
from paywarden.operators import ml
from paywarden.operators.sampling import ensure_evaluation_splits
from paywarden.operators.sessions import session_links
from paywarden.session import scratch_folder
from paywarden.sources import dataset as ds
from paywarden.streaming.links import link_sessions
from tests.helpers import START, dataset, frame, label, txn


def payments(spark, rows):
    return ds.with_event_time(frame(spark, "transactions", rows))


def at(minutes):
    return START + timedelta(minutes=minutes)


def drained(spark, rows):
    hits = d.balance_drain_exit(payments(spark, rows)).collect()
    return [(r["entity_id"], r["txn_id"], r["peak"]) for r in hits]


def test_a_small_decoy_does_not_hide_a_drain(spark):
    rows = [txn(1, "x", "m", "1000", at(0)), txn(2, "y", "m", "1", at(1)), txn(3, "m", "z", "900", at(2))]
    assert drained(spark, rows) == [("m", "t3", 90)]
    assert drained(spark, rows[:1] + rows[2:]) == [("m", "t3", 90)]
    # Back to the sender, too late, out of the band, or to a payee paid before: no hit.
    assert drained(spark, [rows[0], txn(3, "m", "x", "900", at(2))]) == []
    assert drained(spark, [rows[0], txn(3, "m", "z", "900", at(6))]) == []
    assert drained(spark, [rows[0], txn(3, "m", "z", "800", at(2))]) == []
    assert drained(spark, [txn(0, "m", "z", "5", at(-9)), rows[0], rows[2]]) == []
    # The ends of the band and of the window belong to it, across buckets.
    assert drained(spark, [rows[0], txn(3, "m", "z", "950", at(5)), txn(4, "m", "w", "850", at(5))]) == [("m", "t3", 95), ("m", "t4", 85)]
    # Of several senders the latest gives the evidence.
    assert drained(spark, [rows[0], txn(2, "y", "m", "960", at(1)), rows[2]]) == [("m", "t3", 93)]


def controls(spark, rows, fraud, **kw):
    labels = frame(spark, "labels", [label(r["txn_id"], is_fraud=r["txn_id"] in fraud, campaign_id=fraud.get(r["txn_id"])) for r in rows])
    return {r["txn_id"]: r["control_txn_id"] for r in d.matched_controls(payments(spark, rows), labels, **kw).collect()}


def test_the_nearest_control_is_looked_for_inside_the_band(spark):
    rows = [txn(1, "a", "p", "100", at(0)), txn(2, "b", "q", "70", at(1)), txn(3, "c", "r", "120", at(2)), txn(4, "e", "p", "101", at(3))]
    assert controls(spark, rows, {"t1": "k"}) == {"t1": "t2"}
    assert controls(spark, rows[:1] + rows[2:], {"t1": "k"}) == {}


def test_a_kept_payee_stands_in_for_one_over_the_limit(spark):
    rows = [txn(k, "a", "p", "100", at(k)) for k in (1, 2, 3)] + [
        txn(4, "b", "q", "100", at(4)), txn(5, "c", "r", "60", at(5)), txn(6, "a", "p", "62", at(6)), txn(7, "a", "p", "200", at(7)), txn(8, "b", "s", "200", at(8)),
    ]
    fraud = {"t1": "k", "t2": "k", "t3": "k", "t6": "k", "t7": "k"}
    assert controls(spark, rows, fraud, payees_per_campaign=3) == {"t1": "t4", "t2": "t4", "t3": "t4", "t6": "t5", "t7": "t8"}
    # Only q is kept: 100 lies in the band of 100, not in those of 62 and 200.
    assert controls(spark, rows, fraud, payees_per_campaign=1) == {"t1": "t4", "t2": "t4", "t3": "t4"}
    near = rows + [txn(9, "b", "q", "195", at(9))]
    assert controls(spark, near, fraud, payees_per_campaign=1)["t7"] == "t9"


def long_session(n):
    return [txn(k, "a", "p", "100", at(k), session_id="long", call_active_during_txn=True) for k in range(n)]


def test_a_payment_links_to_the_fifty_before_it(spark):
    df = payments(spark, long_session(200))
    got = {(int(r["source_txn"][1:]), int(r["target_txn"][1:])) for r in session_links(df).collect()}
    assert got == {(a, b) for b in range(200) for a in range(max(0, b - 50), b)}
    assert {(int(r["source_txn"][1:]), int(r["target_txn"][1:])) for r in session_links(df, max_rows=30).collect()} == got


@pytest.mark.parametrize("files", [1, 3, 8])
def test_links_do_not_depend_on_the_batches(spark, tmp_path, files):
    rows = long_session(120)
    for k in range(files):
        part = payments(spark, rows[k * 120 // files : (k + 1) * 120 // files])
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(payments(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = link_sessions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50 * 49 // 2 + 50 * 70


def test_reading_what_cannot_be_read_is_an_error(spark, tmp_path):
    folder = str(tmp_path / "data")
    for name, df in dataset(spark).items():
        ds.write_table(df, name, folder)
    assert ds.read_existing(spark, [f"{folder}/none.parquet"]) is None
    (tmp_path / "bad.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        ds.read_existing(spark, [f"{folder}/parties.parquet", str(tmp_path / "bad.parquet")]).count()
    spark.read.parquet(f"{folder}/parties.parquet").drop("kyc_level").write.parquet(str(tmp_path / "cut"))
    (tmp_path / "data" / "parties.parquet").rename(tmp_path / "kept")
    (tmp_path / "cut").rename(tmp_path / "data" / "parties.parquet")
    with pytest.raises(ValueError, match="kyc_level"):
        ds.load_dataset(spark, folder)


def test_splits_are_found_among_many_names(spark):
    df = spark.range(100).select(F.when(F.col("id") < 40, "train").when(F.col("id") < 98, F.concat(F.lit("s"), "id")).when(F.col("id") == 98, "validation").otherwise("test").alias("split"), "id")
    assert ensure_evaluation_splits(df, F.col("id")).filter("split = 'train'").count() == 40


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_folder(Session(), "x-")


def test_a_saved_model_scores_alike(spark, tmp_path):
    rows = spark.range(600).select(
        F.concat(F.lit("t"), "id").alias("txn_id"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit("train").alias("split"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"), (F.col("id") % 7 + F.col("id") % 3).cast("double").alias("x"),
    )
    models = {k: v for k, v in ml.classifiers(trees=3, rounds=2, depth=2).items() if k in ("logistic_regression", "boosted_trees")}
    model, comparison, test = ml.train_fraud_model(rows, ["kind"], ["x"], models, guard=False)
    # No validation rows were given: a share of the training rows was carved out, and stands in for the test rows.
    assert 30 < test.count() < 200 and comparison.filter("pr_auc IS NULL").count() == 0
    model.save(str(tmp_path / "model"), version=2)
    model.save(str(tmp_path / "model"), version=3)
    again = ml.FraudModel.load(spark, str(tmp_path / "model"))
    assert (again.threshold, again.categorical, again.numeric) == (model.threshold, model.categorical, model.numeric)
    assert sorted(map(tuple, again.score(rows).select("txn_id", "score").collect())) == sorted(map(tuple, model.score(rows).select("txn_id", "score").collect()))
    with pytest.raises(ValueError, match="both classes"):
        ml.train_fraud_model(rows.filter("y = 0"), ["kind"], ["x"], models)
