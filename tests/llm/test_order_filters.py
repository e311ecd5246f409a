import random

from paywarden.llm.order_filters import jaccard_components
from paywarden.llm.shingles import shingle_sets
from tests.llm.helpers import ODD_TEXTS, documents, empty, smallest


def brute(texts):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = [shingles(t) for t in texts]
    links = [
        (a, b)
        for b, y in enumerate(sets) if y
        for a, x in enumerate(sets[:b]) if x and 100 * len(x & y) >= 75 * len(x | y)
    ]
    root = smallest(range(len(sets)), links)
    return {k: (len(s), root[k]) for k, s in enumerate(sets)}


def run(spark, texts):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(documents(spark, texts)).collect()}


def test_shingles_follow_ascii_rules():
    sizes = [len(s) for s in shingle_sets([t or "" for t in ODD_TEXTS])]
    assert sizes == [n for n, _ in (brute(ODD_TEXTS)[k] for k in range(len(ODD_TEXTS)))]
    a, b, c = shingle_sets(["A b C d E", "a B c\td\x0be", "à b c d e"])
    assert a.tolist() == b.tolist() != c.tolist()


def test_odd_texts(spark):
    assert run(spark, ODD_TEXTS) == brute(ODD_TEXTS)
    assert jaccard_components(empty(spark)).count() == 0
    nulls = documents(spark, [None, ""])
    assert {r["component_id"] for r in jaccard_components(nulls).collect()} == {0, 1}


def test_families_of_near_copies(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    common = [word() for _ in range(60)]
    texts = []
    for family in range(14):
        base = [word() for _ in range(rng.choice([5, 8, 30, 120, 300]))] + (common if family % 3 == 0 else [])
        for _ in range(rng.choice([2, 9, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    rng.shuffle(texts)
    want = brute(texts)
    assert run(spark, texts) == want
    assert 20 < len({c for _, c in want.values()}) < len(texts) - 40


def test_exactly_at_the_threshold(spark):
    # 7 shared of 9 links, and so do 3 of 4; 5 of 7 does not.
    texts = ["a b c d e f g h i j k l", "a b c d e f g h i j k x", "p q r s t u v", "p q r s t u v w", "1 2 3 4 5 6 7 8 9 0", "1 2 3 4 5 6 7 8 9 y"]
    assert run(spark, texts) == brute(texts)


def test_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ["a b c d e f g", "a b c d e f g h", "other words are in this one here"])
    twice = docs.union(docs).union(docs.selectExpr("cast(null as bigint) doc_id", *docs.columns[1:]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(twice).collect()}
    assert got == {0: (3, 0), 1: (4, 0), 2: (3, 2)}
