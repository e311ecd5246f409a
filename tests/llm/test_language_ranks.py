"""Rank-order profiles against counting with dictionaries, and held-out accuracy."""

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from paywarden.llm.common import table
from paywarden.llm.language_ranks import BITS, BLANK, Profiles, predicted_languages, top_grams, train_profiles
from tests.llm.helpers import ODD_TEXTS, documents, empty


def code(gram: str) -> int:
    out = 0
    for ch in gram:
        out = out << BITS | (BLANK if ch == " " else ord(ch))
    return out


def count(text: str | None) -> Counter:
    low = unicodedata.normalize("NFC", text or "").lower()
    words = "".join(ch if ch.isalpha() else " " for ch in low).split()
    out = Counter()
    for w in words:
        w = f" {w} "
        out.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1))
    # A blank alone is no gram, and two words share the blank between them.
    del out[" "]
    return Counter({code(g): n for g, n in out.items()})


def ranked(counts: Counter, length: int) -> list[int]:
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:length]]


def brute(rows, length):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    totals = {}
    for i, text, lang in rows:
        if lang is not None and not held(i):
            totals.setdefault(lang, Counter()).update(count(text))
    profiles = {s: {g: k for k, g in enumerate(ranked(c, length))} for s, c in totals.items() if c}
    out = []
    for i, text, _ in rows:
        own = ranked(count(text), length)
        far = {s: sum(abs(k - p[g]) if g in p else length for k, g in enumerate(own)) for s, p in profiles.items()}
        best = min(far, key=lambda s: (far[s], s.encode())) if own and far else "und"
        out.append((i, held(i), best, 1 - far[best] / (len(own) * length) if best != "und" else 0.0))
    return sorted(out, key=repr)


def got(docs, length=300):
    return sorted(map(tuple, predicted_languages(docs, length).collect()), key=repr)


@pytest.mark.parametrize("length", [300, 20])
def test_given_documents(spark, length):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = got(docs, length)
    assert found == brute([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], length)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    if length == 300:
        assert np.mean([p == lang[i] for i, held, p, _ in found if held]) >= 0.98


def test_chunks_and_neighbours_do_not_matter():
    texts = [t or "" for t in ODD_TEXTS] + ["É", "straße Straße", "٣ أهلا", "中文 中", "áb", "İi"]
    whole, sizes = top_grams(texts, 50)
    assert sizes.tolist() == [min(50, len(count(t))) for t in texts]
    for t, part in zip(texts, np.split(whole, np.cumsum(sizes)[:-1])):
        assert part.tolist() == ranked(count(t), 50) == top_grams([t], 50)[0].tolist()
    assert top_grams([], 5)[0].tolist() == []


def test_odd_rows(spark):
    docs = documents(spark)
    docs = docs.union(docs).union(documents(spark, ["die der das", None, "the of and", "1 2 3"], 50).selectExpr("cast(null as long) doc_id", "text", "'de' lang", "* except (doc_id, text, lang)"))
    docs = docs.union(documents(spark, ["los las", "..."], 70).selectExpr("doc_id", "text", "cast(null as string) lang", "* except (doc_id, text, lang)"))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    found = got(docs)
    assert found == brute(rows, 300) and {p for *_, p, _ in found} == {"en", "de", "und"}
    assert got(empty(spark)) == []
    # Nothing to learn from: every text is undetermined.
    assert {(p, s) for *_, p, s in got(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))} == {("und", 0.0)}


def test_languages_of_held_out_rows_are_not_seen(spark):
    docs = documents(spark, ["the of and with", "der die das mit"] * 20).selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'en', 'de') lang")
    lies = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'xx', lang) lang")
    assert got(docs) == got(lies)


def test_many_values_are_refused(spark):
    docs = spark.range(0, 40).selectExpr("id doc_id", "'word' text", "string(id) lang")
    with pytest.raises(ValueError, match="languages"):
        train_profiles(docs, 4, 10)
    assert isinstance(train_profiles(docs, 4), Profiles)
