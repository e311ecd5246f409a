"""Centroid clustering in exact integers, with most centroids ruled out in rotated coordinates.

Components are integers. The principal axes of all vectors give a rotation; a vector is
stored with its leading rotated coordinates and the norm of the rest. Because the
rotation is orthogonal, the squared distance to a centroid is at least the squared
distance of the leading coordinates plus the squared difference of the two residual
norms. Only centroids whose bound does not exceed the exact distance to the most
promising one are compared, in integers, so assignments are exact whatever the axes.

A round is one pass over the stored vectors: tasks return sums a cluster and dimension,
which Spark adds up; `clusters * dimensions` numbers reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.llm.common import written

# Squared distances of components below this stay in 64 bits for up to 256 dimensions.
LIMIT = 1 << 26


@dataclass(frozen=True)
class Axes:
    """An orthogonal rotation around a centre; the first `leading` coordinates are stored."""

    centre: np.ndarray
    rotation: np.ndarray
    leading: int

    @staticmethod
    def fit(n: int, sums: np.ndarray, products: np.ndarray, leading: int) -> Axes:
        """Principal axes from the count, the sums and the sums of products of all vectors."""
        centre = sums / max(n, 1)
        _, vectors = np.linalg.eigh(products / max(n, 1) - np.outer(centre, centre))
        return Axes(centre, np.ascontiguousarray(vectors[:, ::-1]), min(leading, len(centre)))

    def turned(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and residual norms; the residual is summed itself, not as a difference."""
        y = (v - self.centre) @ self.rotation
        return y[:, : self.leading], np.sqrt((y[:, self.leading :] ** 2).sum(axis=1))


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: Axes) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the smaller number of equals) and squared distance of each row of v, and how many pairs were compared."""
    c_lead, c_rest = axes.turned(centroids.astype(float))
    size = (lead**2).sum(axis=1) + rest**2
    c_size = (c_lead**2).sum(axis=1) + c_rest**2
    bound = (lead**2).sum(axis=1)[:, None] + (c_lead**2).sum(axis=1) - 2 * lead @ c_lead.T + (rest[:, None] - c_rest) ** 2
    # More than rounding can add to a bound.
    bound -= 1e-10 * (size[:, None] + c_size) + 1e-6
    first = bound.argmin(axis=1)
    best, at = ((v - centroids[first]) ** 2).sum(axis=1), first
    row, other = np.nonzero(bound <= best[:, None])
    fresh = other != first[row]
    row, other = row[fresh], other[fresh]
    exact = ((v[row] - centroids[other]) ** 2).sum(axis=1)
    # Ascending centroids, so that of equal distances the smaller number is seen first.
    row, other, exact = np.concatenate([np.arange(len(v)), row]), np.concatenate([at, other]), np.concatenate([best, exact])
    order = np.lexsort([other, exact, row])
    pick = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(order) else order
    return other[pick], exact[pick], len(row)


def _rows(column: pa.Array, d: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), d)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), kind))


def kept_vectors(vectors: DataFrame, dimensions: int, scale: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of vectors of that many components, none null or non-finite; v is floor(scale * x)."""
    raw = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("x"))
    fine = f"size(x) = {dimensions} AND forall(x, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))"
    kept = raw.where(F.expr(f"x IS NOT NULL AND {fine}"))
    # A component that leaves the exact range is an error, not a wrong distance.
    exact = f"IF(abs(e) < {LIMIT / scale}D, floor({scale}D * e), cast(raise_error('component beyond the exact range') as bigint))"
    return kept.select("vec_id", F.expr(f"transform(x, e -> {exact})").alias("v"))


def _moments(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            v = _rows(b.column(0), d, float)
            n, sums, products = n + len(v), sums + v.sum(axis=0), products + v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([n]), _lists(sums[None], pa.float64()), _lists(products.reshape(1, -1), pa.float64())], ["n", "sums", "products"])

    return run


def fit_axes(vectors: DataFrame, dimensions: int, leading: int) -> Axes:
    """Axes of all rows (v): tasks return one row of moments each, which are added up place by place."""
    part = vectors.select("v").mapInArrow(_moments(dimensions), "n long, sums array<double>, products array<double>")
    got = part.select("n", F.posexplode(F.concat("sums", "products")).alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    d = dimensions
    flat = np.zeros(d + d * d)
    for r in got:
        flat[r["i"]] = r["x"]
    return Axes.fit(got[0]["n"] if got else 0, flat[:d], flat[d:].reshape(d, d), leading)


def stored(kept: DataFrame, axes: Axes) -> DataFrame:
    """(vec_id, v, lead, rest): the vectors with their leading rotated coordinates and residual norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lead, rest = axes.turned(_rows(b.column(1), len(axes.centre), float))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(np.ascontiguousarray(lead), pa.float64()), pa.array(rest)], ["vec_id", "v", "lead", "rest"])

    return written(kept.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, lead array<double>, rest double"))


def assigned(rows: DataFrame, centroids: np.ndarray, axes: Axes) -> DataFrame:
    """(vec_id, cluster, distance) of the stored vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, lead = _rows(b.column(1), centroids.shape[1], np.int64), _rows(b.column(2), axes.leading, float)
                at, far, _ = nearest(v, lead, b.column(3).to_numpy(), centroids, axes)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v", "lead", "rest").mapInArrow(run, "vec_id long, cluster int, distance long")


def updated(rows: DataFrame, centroids: np.ndarray, axes: Axes) -> np.ndarray:
    """One round: centroids of the clusters' vectors, floor(sum / count); an empty one stays."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums of a batch fit 64 bits; those of a task are kept as whole numbers of any size.
        n, sums = np.zeros(k, np.int64), np.zeros((k, d), object)
        for b in batches:
            if not b.num_rows:
                continue
            v = _rows(b.column(0), d, np.int64)
            at, _, _ = nearest(v, _rows(b.column(1), axes.leading, float), b.column(2).to_numpy(), centroids, axes)
            n += np.bincount(at, minlength=k)
            for c in np.unique(at).tolist():
                sums[c] += v[at == c].sum(axis=0).astype(object)
        some = np.flatnonzero(n)
        cluster, place = np.repeat(some, d), np.tile(np.arange(d), len(some))
        total = pa.array([Decimal(int(x)) for c in some for x in sums[c]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(n[cluster]), total], ["c", "i", "n", "x"])

    parts = rows.select("v", "lead", "rest").mapInArrow(run, "c int, i int, n long, x decimal(38,0)")
    after = centroids.copy()
    for r in parts.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        after[r["c"], r["i"]] = int(r["x"]) // r["n"]
    return after


def first_centroids(kept: DataFrame, clusters: int, seed: int, dimensions: int) -> np.ndarray:
    """The vectors with the smallest sha256 of `seed:vec_id`, in that order; a null id comes last, equal ids in the order of their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = kept.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(clusters).collect()
    return np.array([r["v"] for r in got], np.int64).reshape(len(got), dimensions)


def rotated_means(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: int = 3, leading: int = 16,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Kept are vectors with exactly `dimensions` components, none null or non-finite; the
    others have no row. Of `clusters` or fewer kept vectors each is a first centroid.
    Repeated ids and vectors count each, a null id is an id. An empty table gives
    no rows. A component of 2**26 or more after scaling raises an error. Inertias
    that leave 64 bits are null.
    """
    kept = written(kept_vectors(vectors, dimensions, scale, id_column, vector_column))
    axes = fit_axes(kept, dimensions, leading)
    rows = stored(kept, axes)
    centroids = first_centroids(kept, clusters, seed, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        after = updated(rows, centroids, axes)
        # Nothing moves any more: the rounds that are left would repeat this one.
        if np.array_equal(after, centroids):
            break
        centroids = after
    last = written(assigned(rows, centroids, axes)) if len(centroids) else rows.selectExpr("vec_id", "0 AS cluster", "0L AS distance")
    inertia = {r["cluster"]: int(r["s"]) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    total = fits(sum(inertia.values()))
    table = [(c, fits(s), total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    # One row a cluster.
    per = last.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same in SQL: a round is two table expressions."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({scale} * x)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding::DOUBLE[], lambda x: isfinite(x))) = {dimensions})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS cluster, v AS c FROM kept
  ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, v LIMIT {clusters})""",
    ]
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT row, vec_id, v, cluster, {far} AS distance FROM kept CROSS JOIN c{r}
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY {far}, cluster) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, old.c) AS c FROM c{r} old LEFT JOIN (
    SELECT cluster, list(x ORDER BY i) AS c FROM (
      SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x
      FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
