from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paywarden.llm.length_buckets import best_buckets, histogram, length_bin, pack_by_length, word_count
from tests.llm.helpers import ODD_TEXTS, documents, empty


def brute(bins, k):
    n = len(bins)
    cost = lambda i, j: bins[j - 1][0] * sum(b[1] for b in bins[i:j]) - sum(b[2] for b in bins[i:j])
    return min(
        sum(cost(a, b) for a, b in zip((0, *cuts), (*cuts, n))) for m in range(min(k, n)) for cuts in combinations(range(1, n), m)
    )


@given(st.lists(st.integers(0, 40), min_size=1, max_size=40), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_least_padding_of_all_cuts(lengths, k):
    bins = [(n, c, n * c) for n, c in sorted(Counter(lengths).items())]
    plan = best_buckets(bins, k)
    assert plan.padding == brute(bins, k) and len(plan.bounds) <= k
    assert sum(plan.docs) == len(lengths) and plan.bounds[-1] == max(lengths)


def test_bins(spark):
    values = [0, 1, 255, 256, 257, 511, 512, 1000, 123_456, 2**40 + 5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "n long").select(length_bin("n")).collect()]
    shift = [max(v.bit_length() - 8, 0) for v in values]
    assert got == [v >> s << s for v, s in zip(values, shift)]
    assert histogram(spark.createDataFrame([(3,), (3,), (300,), (301,)], "n long")) == [(3, 2, 6), (301, 2, 601)]


def test_batches(spark):
    docs = documents(spark, [("w " * n).strip() for n in [*range(1, 60), *[7] * 200, 900, 5000]])
    rows = pack_by_length(docs, buckets=4, token_budget=600).collect()
    assert len(rows) == 261 and all(r["n_tokens"] <= r["bucket_length"] for r in rows)
    by_batch = Counter((r["bucket"], r["batch"]) for r in rows)
    length = {r["bucket"]: r["bucket_length"] for r in rows}
    for b in length:
        room = max(1, 600 // length[b])
        sizes = [by_batch[x] for x in sorted(by_batch) if x[0] == b]
        assert all(s == room for s in sizes[:-1]) and 0 < sizes[-1] <= room
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in rows}) == 261
    assert sum(r["bucket_length"] - r["n_tokens"] for r in rows) == best_buckets(
        [(n, c, n * c) for n, c in sorted(Counter(r["n_tokens"] for r in rows).items())], 4
    ).padding


def test_odd_rows(spark):
    rows = {r["doc_id"]: r["n_tokens"] for r in pack_by_length(documents(spark)).collect()}
    assert rows == {k: len((t or "").encode().split()) for k, t in enumerate(ODD_TEXTS)}
    assert pack_by_length(empty(spark)).count() == 0
    twice = documents(spark, ["a b"]).select("doc_id", "text")
    assert pack_by_length(twice.union(twice)).count() == 2
    assert documents(spark, ["a\x0bb\xa0c"]).select(word_count()).first()[0] == 2
    assert pack_by_length(documents(spark, ["a b c"]), length=F.length("text")).first()["n_tokens"] == 5


def test_query_counts_the_ids_of_a_tokenizer(spark, tmp_path):
    import public_tokenizers

    from paywarden.llm.piece_merge import encode_pieces
    from paywarden.llm.queries import QUERIES

    docs = documents(spark, [*ODD_TEXTS, "unsplit" * 3_000, "Vorstandsvorsitzender 漢字漢字 \u2581x", None])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {r["doc_id"]: len(r["ids"]) for r in encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    rows = QUERIES["op3_length_buckets"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want and len(rows) == len(want)
    assert want[len(ODD_TEXTS)] > 3_000  # one word, many ids
    of_batch = Counter((r["bucket"], r["batch"], r["bucket_length"]) for r in rows)
    assert all(n == 1 or n * length <= 65_536 for (_, _, length), n in of_batch.items())


def test_repeated_ids_fill_batches(spark):
    docs = spark.range(0, 5000).selectExpr("if(id % 3 = 0, null, 7L) doc_id", "'a b' text")
    rows = pack_by_length(docs, token_budget=200).collect()
    assert Counter(Counter(r["batch"] for r in rows).values()) == {100: 50} and len({(r["batch"], r["slot"]) for r in rows}) == 5000
