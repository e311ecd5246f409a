import zlib

import numpy as np

from paywarden.llm.common import table
from paywarden.llm.quality_trees import STATISTICS, fit_trees, keep_quality, quality_scores, score_quality, statistics, train_quality
from tests.llm.helpers import ODD_TEXTS, documents, empty


def test_statistics_of_odd_texts():
    x = statistics([t or "" for t in ODD_TEXTS])
    assert x.shape == (len(ODD_TEXTS), len(STATISTICS)) and np.isfinite(x).all()
    assert not x[0].any() and statistics([]).shape[1] == len(STATISTICS)
    one = dict(zip(STATISTICS, statistics(["Ab cd!! é"])[0]))
    assert one["share_upper"] == 1 / 9 and one["share_bang"] == 2 / 9 and one["share_lead"] == 1 / 9
    assert one["capital_starts"] == 1 / 3 and one["bang_ends"] == 1 / 3 and one["two_symbols"] == 1 / 3
    # What other texts share a batch does not matter.
    assert np.array_equal(statistics(["Ab cd!! é", "x", "", "Y\n"])[0], statistics(["Ab cd!! é"])[0])


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = fit_trees(x, y, rounds=20, depth=3)
    for row, got in zip(x[:50], t.score(x[:50])):
        total = t.base
        for f, cut, leaf in zip(t.feature, t.threshold, t.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > cut[at])
            total += leaf[at - len(f)]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((t.score(x) > 0.5) == y).mean() > 0.95


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()}
    labels = [r for r in table(spark, sf, "labels").collect() if got[r["doc_id"]]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in labels]) >= 0.97
    assert all((r["score"] >= 0.7) == bool(r["predicted"]) for r in got.values())


def test_held_out_labels_are_not_seen(spark):
    docs = documents(spark, ["Good words here. " * 9, "BAD!! " * 9] * 20)
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(40)], "doc_id long, quality int")
    lies = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end quality")
    a, b = (sorted(quality_scores(docs, x).select("doc_id", "score").collect()) for x in (labels, lies))
    assert a == b


def test_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (7, 0), (None, 1), (10, None), (999, 1)], "doc_id long, quality int")
    trees = train_quality(documents(spark), labels)
    assert score_quality(documents(spark), trees).count() == len(ODD_TEXTS)
    assert keep_quality(documents(spark), trees, 0.0).columns == documents(spark).columns
    assert quality_scores(empty(spark), labels).count() == 0
    none = train_quality(documents(spark), labels.limit(0))
    assert {r["score"] for r in score_quality(documents(spark), none).collect()} == {0.5}
