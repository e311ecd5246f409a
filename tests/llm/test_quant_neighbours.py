import math

import numpy as np

from paywarden.llm.quant_neighbours import Quantiser, neighbour_components
from tests.llm.helpers import smallest


def brute(rows):
    fine = {i: np.array(v, float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in fine.items()}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.9]
    root = smallest([i for i, _ in rows], links)
    n = {i: sum(i in x for x in links) for i, _ in rows}
    return {i: (n[i], root[i], root[i] == i) for i, _ in rows}


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, links string")
    got = neighbour_components(df, **more).collect()
    assert len(got) == len(rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}


def clusters(seed=3, dim=16, centres=12, each=25):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(centres):
        c = rng.normal(size=dim)
        out += [c + rng.normal(size=dim) * rng.choice([0.0, 0.15, 0.3, 0.45]) for _ in range(each)]
    out += list(rng.normal(size=(200, dim)))
    order = rng.permutation(len(out))
    return [(int(i), np.float32(out[k]).astype(float).tolist()) for i, k in enumerate(order)]


def test_recall_and_no_false_link(spark):
    rows = clusters()
    want, got = brute(rows), run(spark, rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(w[0] for w in want.values())


def test_blocks_give_the_same(spark):
    rows = clusters(4)
    assert run(spark, rows, block=40) == run(spark, rows)


def test_odd_vectors(spark):
    rows = [
        (0, None), (1, []), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, [float("inf"), 1.0, 0.0]),
        (6, [1.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [2.0, 0.0, 0.0]), (9, [0.0, 1.0, -0.0]), (10, [0.0, 3.0, 0.0]), (11, [-1.0, 0.0, 0.0]),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(1, None), (2, [])]) == {1: (0, 1, True), 2: (0, 2, True)}
    assert run(spark, []) == {}


def test_many_copies(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(500)] + [(500, [1.0, 2.0, 3.1]), (501, [-1.0, 2.0, 0.0])]
    got = run(spark, rows)
    assert got[0] == (500, 0, True) and got[499] == (500, 0, False) and got[500] == (500, 0, False) and got[501] == (0, 501, True)


def test_least_product_bounds_every_link():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(3000, 32))
    y /= np.linalg.norm(y, axis=1)[:, None]
    q = Quantiser.fit(y[:800], 20)
    home, codes, least, _ = q.encode(y)
    built = q.centroids[home].copy()
    for m, (a, b) in enumerate(zip(q.cuts, q.cuts[1:])):
        built[:, a:b] += q.books[m, codes[:, m], : b - a]
    for _ in range(20):
        z = rng.normal(size=y.shape)
        z -= (z * y).sum(axis=1)[:, None] * y
        z /= np.linalg.norm(z, axis=1)[:, None]
        c = rng.uniform(0.9, 1, size=(len(y), 1))
        assert (((c * y + np.sqrt(1 - c**2) * z) * built).sum(axis=1) >= least - 1e-9).all()


def test_every_length_links_with_its_own(spark):
    rng = np.random.default_rng(8)
    rows = clusters(5, dim=8, centres=6, each=15)
    rows += [(1000 + k, v) for k, (_, v) in enumerate(clusters(6, dim=5, centres=4, each=10)[:90])]
    rows += [(2000, [1.0, 0.0]), (2001, [2.0, 0.0]), (2002, [0.0, 1.0]), (2003, [3.0]), (2004, [0.5]), (2005, [-1.0]), (2006, [0.0])]
    rows += [(3000 + k, (rng.normal(size=3) * 0.1 + 1).tolist()) for k in range(70)]
    for block in (4096, 50):
        got, want = run(spark, rows, block=block), {i: x for d in (1, 2, 3) for i, x in brute([(i, np.float32(v).astype(float).tolist()) for i, v in rows if i >= 2000 and len(v) == d]).items()}
        exact = [i for i in want if i < 3000 or block == 4096]
        assert {i: got[i] for i in exact} == {i: want[i] for i in exact}
        whole = brute_by_length(rows)
        assert all(got[i][0] <= whole[i] for i in whole) and sum(g[0] for g in got.values()) >= 0.98 * sum(whole.values())


def brute_by_length(rows):
    by = {}
    for i, v in rows:
        by.setdefault(len(v), []).append((i, np.float32(v).astype(float).tolist()))
    return {i: n for part in by.values() for i, (n, _, _) in brute(part).items()}
