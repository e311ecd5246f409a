"""Clusters against the plain algorithm in Python integers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from paywarden.llm import rotated_means as rm
from paywarden.llm.common import table
from tests.llm.helpers import SF


def brute(rows, clusters=8, rounds=10, d=64, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * e) for e in x]) for i, x in rows if x is not None and len(x) == d and all(e is not None and math.isfinite(e) for e in x)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=key)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(c))
    for _ in range(rounds if c else 0):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else m for k, m in enumerate(c)]
    last = [(i, *near(v)) for i, v in kept]
    of = {k: sum(far for _, far, at in last if at == k) for k in range(len(c))}
    return [(i, k, far, of[k], sum(of.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, far, k in last]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_given_vectors(spark):
    vectors = table(spark, SF, "embeddings")
    got = ordered(rm.rotated_means(vectors).collect())
    assert got == ordered(brute([(r["vec_id"], r["embedding"]) for r in vectors.collect()])) and len({r[1] for r in got}) == 8
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert ordered(con.sql(rm.oracle()).fetchall()) == got


def test_odd_rows(spark):
    one, nan, inf = [0.5, -0.25, 1.0], float("nan"), float("inf")
    rows = [(1, one), (1, one), (2, one), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [nan, 0.0, 0.0]), (7, [inf, 0.0, 0.0]), (8, [1.0, 2.0])]
    rows += [(None, [0.0, 0.0, -0.0]), (None, one), (9, [-9.0, 3.0, 0.001]), (10, [-0.0001, 0.0, 1e-9]), (11, [1.0, 2.0, 3.0, 4.0])]
    docs = spark.createDataFrame([(i, x, "clash", 0) for i, x in rows], "vec_id long, embedding array<double>, v string, cluster int")
    for k in (1, 2, 4, 20):
        got = rm.rotated_means(docs, clusters=k, dimensions=3, leading=2)
        assert ordered(got.collect()) == ordered(brute(rows, k, d=3)), k
    assert rm.rotated_means(docs.limit(0)).count() == 0 and rm.rotated_means(docs).count() == 0
    huge = spark.createDataFrame([(1, [1e30, 0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exact range"):
        rm.rotated_means(huge, dimensions=3).count()


@pytest.mark.parametrize("spread, leading", [(1, 1), (30, 4), (2**26 - 1, 3), (2, 12)])
def test_bounds_lose_no_centroid(spread, leading):
    rng = np.random.default_rng(leading)
    v = rng.integers(-spread, spread + 1, (500, 12))
    v[:50] = v[50:100]
    c = np.concatenate([v[rng.integers(0, 500, 9)], v[:3]])
    x = v.astype(float)
    axes = rm.Axes.fit(len(v), x.sum(axis=0), x.T @ x, leading)
    far = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    at, best, compared = rm.nearest(v, *axes.turned(x), c, axes)
    assert (at == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all() and compared <= far.size + len(v)


def test_bounds_rule_most_centroids_out():
    rng = np.random.default_rng(1)
    c = rng.integers(-1000, 1000, (40, 64))
    v = c[rng.integers(0, 40, 2000)] + rng.integers(-50, 50, (2000, 64))
    x = v.astype(float)
    axes = rm.Axes.fit(len(v), x.sum(axis=0), x.T @ x, 16)
    assert rm.nearest(v, *axes.turned(x), c, axes)[2] < 1.1 * len(v)
