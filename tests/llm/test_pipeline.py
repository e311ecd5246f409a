"""The pipeline against brute force, stage by stage, and its registration."""

import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from paywarden.llm.common import table
from paywarden.llm.exact_dedup import exact_duplicates
from paywarden.llm.quality_trees import score_quality, train_quality
from tests.llm.helpers import ODD_TEXTS, SF, documents, empty
from tests.llm.test_order_filters import brute


def test_stages_on_the_smallest_tables(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "ngram_jaccard", "packing"]
    kept = stages["quality"](spark, docs, SF)
    trees = train_quality(docs, table(spark, SF, "labels"))
    good = {r["doc_id"] for r in score_quality(docs, trees).collect() if r["score"] >= 0.7}
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(texts) == good and kept.schema == docs.schema and 0 < len(good) < docs.count()
    groups = {}
    for i, t in texts.items():
        groups.setdefault(re.sub(r"[ \t-\r]", "", t), []).append((-len(t), i))
    exact = {min(g)[1] for g in groups.values()}
    once = stages["exact_dedup"](spark, kept, SF)
    assert {r["doc_id"] for r in once.collect()} == exact and once.columns == docs.columns
    ids = sorted(exact)
    near = {ids[k] for k, (_, root) in brute([texts[i] for i in ids]).items() if root == k}
    left = stages["ngram_jaccard"](spark, once, SF)
    assert {r["doc_id"] for r in left.collect()} == near and len(near) < len(exact)
    packed = {r["doc_id"]: r["n_tokens"] for r in stages["packing"](spark, left, SF).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert packed == {i: len(model.encode(texts[i])) for i in near}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()} == packed


def test_stages_take_odd_documents(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, empty(spark)):
            out = stage(spark, given, SF)
            assert name == "packing" or out.columns == docs.columns, name
            assert out.count() <= given.count() and (name == "quality" or given is not docs or out.count() > 0), name
    packed = corpus_pipeline.packing(spark, docs.union(docs), SF).collect()
    assert len(packed) == 2 * len(ODD_TEXTS) and len({(r["bucket"], r["batch"], r["slot"]) for r in packed}) == len(packed)


def test_exact_stage_decides_on_rows(spark):
    texts = ["a b", "ab", "a b", None, "", "c", "c "]
    docs = documents(spark, texts)
    no_id = docs.where("doc_id IN (0, 6)").selectExpr("cast(null as long) doc_id", "* except (doc_id)")
    again = docs.where("doc_id = 5").selectExpr("doc_id", "concat(text, '  ') text", "* except (doc_id, text)")
    rows = corpus_pipeline.exact(spark, docs.union(docs).union(no_id).union(again), SF).select("doc_id", "text").collect()
    # Of "a b" the null id is the smallest; "c" as row 5 spells it with two blanks is the longest.
    assert sorted(map(tuple, rows), key=repr) == sorted([(None, "a b"), (3, None), (5, "c  ")], key=repr)
    assert corpus_pipeline.exact(spark, docs, SF).columns == docs.columns


def test_index_path_with_a_quote(spark, tmp_path):
    path = f"{tmp_path}/it's"
    assert {r["kept"] for r in exact_duplicates(documents(spark, ["a", "b"]), path).collect()} == {True}
    assert {r["keep_id"] for r in exact_duplicates(documents(spark, ["a", "b"], 5), path).collect()} == {0, 1}
