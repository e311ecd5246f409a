import hashlib
import re
import tempfile

from paywarden.llm.exact_dedup import DigestIndex, exact_duplicates
from tests.llm.helpers import ODD_TEXTS, documents, empty


def expected(texts):
    groups = {}
    for k, t in enumerate(texts):
        t = t or ""
        groups.setdefault(re.sub(r"[ \t-\r]", "", t), []).append((-len(t), k))
    return {
        k: (min(g)[1], len(g), hashlib.sha256(key.encode()).hexdigest()) for key, g in groups.items() for _, k in g
    }


def test_every_odd_text(spark):
    got = exact_duplicates(documents(spark)).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == expected(ODD_TEXTS)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_empty_table_and_null_id(spark):
    assert exact_duplicates(empty(spark)).count() == 0
    docs = documents(spark, ["same", "same"]).selectExpr("nullif(doc_id, 1) doc_id", "text")
    assert [r["keep_id"] for r in exact_duplicates(docs).collect()] == [None, None]


def test_index_persists_and_a_repeated_batch_changes_nothing(spark):
    path = tempfile.mkdtemp() + "/index"
    index = DigestIndex(spark, path, buckets=4)
    index.add(documents(spark, ["a", "b", "b "]))
    index.close()
    index = DigestIndex(spark, path, buckets=4)
    assert index.rows().count() == 2
    second = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.add(documents(spark, ["b", "c", "a  "], first=10)).collect()}
    assert second == {10: (2, False), 11: (11, True), 12: (0, False)}
    again = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.add(documents(spark, ["b", "c", "a  "], first=10)).collect()}
    assert again == second and index.rows().count() == 3
    plan = index.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan or "bucket" in plan.lower()
    index.close()


def test_hot_text(spark):
    got = exact_duplicates(documents(spark, ["copy"] * 3000 + [f"own {k}" for k in range(100)])).collect()
    assert sum(r["kept"] for r in got) == 101
    assert {r["group_size"] for r in got} == {1, 3000}
