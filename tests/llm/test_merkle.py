"""The manifest against trees built one node at a time."""

import hashlib
import zlib

import duckdb
import pytest

from paywarden.llm.common import shared_folder, table
from paywarden.llm.merkle import FIELDS, FOLD, ORACLE, manifest_proofs, prove, write_manifest
from tests.llm.helpers import ODD_TEXTS, SF, documents, empty


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: dict, more: int = 0) -> str:
    values = [row[c] + more if c == "n_chars" and row[c] is not None else row[c] for c in FIELDS]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str | None, bool]]]]:
    """Top, and per node its siblings upwards with their side; None where a run holds one node."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for w, i in zip(ways, at):
            j = i ^ 1
            w.append((nodes[j] if j < len(nodes) else None, i % 2 == 1))
        nodes = [digest(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], ways


def fold(node: str, way) -> str:
    for sibling, left in way:
        node = digest(sibling, node) if left else digest(node, sibling or "")
    return node


def brute(rows: list[dict]) -> list[tuple]:
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = [sorted((r for r in rows if r["lang"] == v), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for v in langs]
    below = [tree([leaf(r) for r in g]) for g in groups]
    root, above = tree([top for top, _ in below])
    out = []
    for g, (top, ways), up in zip(groups, below, above):
        for r, way in zip(g, ways):
            way = way + up
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = fold(leaf(r, int(hit)), way)
            out.append((r["doc_id"], leaf(r), top, root, digest(*(s for s, _ in way if s)), folded, folded == root))
    return out


def ordered(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=repr)


def got(spark, docs, height: int = 2) -> list[tuple]:
    return ordered(manifest_proofs(docs, shared_folder(spark), height).collect())


@pytest.mark.parametrize("height", [2, 8])
def test_given_documents(spark, height):
    docs = table(spark, SF, "documents")
    found = got(spark, docs, height)
    assert found == ordered(brute([r.asDict() for r in docs.collect()]))
    # What is not tampered with verifies; a row with a count of characters does not once it is.
    assert all(r[-1] == bool(zlib.crc32(str(r[0]).encode()) % 7) for r in found)


def test_oracle(spark):
    docs = table(spark, SF, "documents")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert ordered(con.sql(ORACLE).fetchall()) == got(spark, docs, 8)


@pytest.mark.parametrize("n", [1, 2, 9, 18])
def test_sizes_and_languages(spark, n):
    rows = [(k, "s" if k % 3 else None, (None, "é", "en", "")[k * k % 4], k * 1000 if k % 4 else None, "t" * k) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(spark, docs) == ordered(brute([dict(zip(FIELDS, r)) for r in rows]))


def test_one_language(spark):
    docs = spark.createDataFrame([(k, "s", "en", k, "t") for k in range(21)], "doc_id long, source string, lang string, n_chars long, text string")
    found = got(spark, docs)
    assert found == ordered(brute([r.asDict() for r in docs.collect()])) and all(r[2] == r[3] for r in found)


def test_odd_rows(spark):
    docs = documents(spark)
    docs = docs.union(docs.where("doc_id < 3")).union(documents(spark, ["no id"]).selectExpr("cast(null as long) doc_id", "* except (doc_id)"))
    docs = docs.union(documents(spark, ["edge"], 7).selectExpr("* except (n_chars)", "9223372036854775807 n_chars").select(docs.columns))
    docs = docs.union(documents(spark, ["same"] * 40).selectExpr("7L doc_id", "* except (doc_id)"))
    rows = [{c: r[c] for c in FIELDS} for r in docs.collect()]
    assert len(rows) == len(ODD_TEXTS) + 45 and got(spark, docs) == ordered(brute(rows))
    assert got(spark, empty(spark)) == []


def test_chosen_requests(spark):
    docs, folder = table(spark, SF, "documents"), shared_folder(spark)
    root = write_manifest(docs, folder, 3)
    asked = docs.where("doc_id IN (3, 4, 77)").select("doc_id")
    found = prove(spark, folder, root, asked.union(asked), 3)
    roots = found.selectExpr("doc_id", FOLD.format(path="path", leaf="leaf") + " AS folded").collect()
    assert {r["doc_id"] for r in roots} == {3, 4, 77} and {r["folded"] for r in roots} == {root}
    # Another row's leaf does not fold to the root on this path.
    other = found.selectExpr(FOLD.format(path="path", leaf="sha2(leaf, 256)") + " AS folded").collect()
    assert root not in {r["folded"] for r in other}
