"""Near-duplicate vectors by product quantisation: coarse inverted lists, residual codes, exact rerank.

Every vector lies in the list of its nearest coarse centroid, as the codes of its
residual in `parts` subspaces. As a query it visits all lists that a vector at the
threshold is likely to lie in, gets approximate products of all their members from one
lookup table per subspace, and compares what passes exactly. A member passes when
its approximate product reaches the least value that any query at the threshold can
have with its reconstruction, so the codes lose nothing; only the choice of lists can.

Work is cut into blocks of members times blocks of queries, each a group of bounded
size, whatever a list holds. A block returns counts and a spanning forest of its
links, never its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.llm.common import components, forget, settle, written


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _k_means(x: np.ndarray, k: int, rounds: int, spherical: bool) -> np.ndarray:
    """Centroids of the rows of x from evenly spaced rows; an empty one stays where it was."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T - (0 if spherical else 0.5 * (c**2).sum(axis=1))).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
        if spherical:
            c = _unit(c)
    return c


@dataclass(frozen=True)
class Quantiser:
    """Coarse centroids (unit vectors) and, per subspace, the codes' vectors."""

    centroids: np.ndarray
    books: np.ndarray
    cuts: tuple[int, ...]
    threshold: float
    reach: float

    @staticmethod
    def fit(sample: np.ndarray, lists: int, parts: int = 8, codes: int = 256, threshold: float = 0.9, reach: float = 2.5, rounds: int = 8):
        x = _unit(sample.astype(float))
        k, d = max(1, min(lists, len(x))), x.shape[1]
        c = _k_means(x, k, rounds, True)
        residual = x - c[(x @ c.T).argmax(axis=1)]
        cuts = tuple(np.linspace(0, d, min(parts, d) + 1).astype(int).tolist())
        width = max(b - a for a, b in zip(cuts, cuts[1:]))
        books = np.zeros((len(cuts) - 1, min(codes, len(x)), width))
        for m, (a, b) in enumerate(zip(cuts, cuts[1:])):
            books[m, :, : b - a] = _k_means(residual[:, a:b], books.shape[1], rounds, False)
        return Quantiser(c, books, cuts, threshold, reach)

    def encode(self, u: np.ndarray):
        """Per unit vector: list, codes, least approximate product of a link, visited lists as bits."""
        dots = u @ self.centroids.T
        home = dots.argmax(axis=1)
        best = dots[np.arange(len(u)), home]
        residual, built = u - self.centroids[home], self.centroids[home].copy()
        codes = np.zeros((len(u), len(self.books)), np.uint8)
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            book = self.books[m, :, : b - a]
            codes[:, m] = (residual[:, a:b] @ book.T - 0.5 * (book**2).sum(axis=1)).argmax(axis=1)
            built[:, a:b] += book[codes[:, m]]
        # q = c u + s z with z at right angles to u: q's product with `built` is least at the threshold.
        along = (u * built).sum(axis=1)
        across = np.sqrt(np.maximum((built**2).sum(axis=1) - along**2, 0))
        cos, sin = self.threshold, np.sqrt(1 - self.threshold**2)
        least = np.where(along > 0, cos * along, along) - sin * across
        # Where the home of a vector at the threshold is expected, less `reach` deviations.
        spread = sin * np.sqrt(np.maximum(1 - best**2, 0) * 2 / u.shape[1])
        visits = dots >= (cos * cos * best - self.reach * spread)[:, None]
        visits[np.arange(len(u)), home] = True
        return home, codes, least, np.packbits(visits, axis=1, bitorder="little")


_ROW = "vec_id long, weight long, unit array<double>, home int, codes binary, least double, bits binary"


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _bytes_matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _encoder(q: Quantiser):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(_matrix(b.column(2)))
            home, codes, least, bits = q.encode(u)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, u.size + 1, u.shape[1]), pa.int32()), pa.array(u.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), lists, pa.array(home, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(least), pa.array([x.tobytes() for x in bits], pa.binary())],
                ["vec_id", "weight", "unit", "home", "codes", "least", "bits"],
            )

    return run


class _Forest:
    """Smallest reachable place per place, joined by arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := self.root[self.root]).tolist() != self.root.tolist():
                self.root = up


def _compare(q: Quantiser, step: int = 256):
    def run(group: pa.Table) -> pa.Table:
        is_query = group["role"].to_numpy() == 1
        members, queries = group.filter(pa.array(~is_query)), group.filter(pa.array(is_query))
        out = {"vec_id": [], "links": [], "root": []}
        if members.num_rows and queries.num_rows:
            home = int(members["home"][0].as_py())
            y, x = _matrix(members["unit"]), _matrix(queries["unit"])
            codes, least = _bytes_matrix(members["codes"]), members["least"].to_numpy()
            visited = np.unpackbits(_bytes_matrix(members["bits"]), axis=1, bitorder="little")
            ids_y, ids_x = members["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            weight_y, weight_x = members["weight"].to_numpy(), queries["weight"].to_numpy()
            home_x = queries["home"].to_numpy()
            ids, place = np.unique(np.concatenate([ids_y, ids_x]), return_inverse=True)
            place_y, place_x = place[: len(y)], place[len(y) :]
            links, forest = np.zeros(len(ids), np.int64), _Forest(len(ids))
            for i in range(0, len(x), step):
                part = x[i : i + step]
                near = np.repeat((part @ q.centroids[home]).astype(np.float32)[:, None], len(y), axis=1)
                for m, (a, b) in enumerate(zip(q.cuts, q.cuts[1:])):
                    near += (part[:, a:b] @ q.books[m, :, : b - a].T).astype(np.float32)[:, codes[:, m]]
                r, c = np.nonzero(near >= (least - 1e-3)[None, :])
                if len(r) > near.size // 16:
                    exact = (part @ y.T)[r, c]
                else:
                    exact = np.einsum("ij,ij->i", part[r], y[c])
                hit = (exact >= q.threshold) & (ids_x[i + r] != ids_y[c])
                r, c = i + r[hit], c[hit]
                links += np.bincount(place_x[r], weight_y[c], len(ids)).astype(np.int64)
                # The member finds this query itself if it visits the query's list.
                unseen = visited[c, home_x[r]] == 0
                links += np.bincount(place_y[c][unseen], weight_x[r][unseen], len(ids)).astype(np.int64)
                forest.join(place_x[r], place_y[c])
            some = np.flatnonzero((links > 0) | (forest.root != np.arange(len(ids))))
            out = {"vec_id": ids[some], "links": links[some], "root": ids[forest.root[some]]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def list_count(n: int) -> int:
    """Lists for n vectors: half the square root, 16 to 4,096, so centroids stay small enough to send to tasks."""
    return int(min(4096, max(16, round(n**0.5 / 2))))


_LINKS = "vec_id long, links long, root long"


def _compare_all(threshold: float, step: int = 256):
    """Counts and a spanning forest of the links among all vectors of a group, which the caller keeps small."""

    def run(group: pa.Table) -> pa.Table:
        u, ids, weight = _unit(_matrix(group["v"])), group["vec_id"].to_numpy(), group["weight"].to_numpy()
        links, forest = np.zeros(len(u), np.int64), _Forest(len(u))
        for i in range(0, len(u), step):
            r, c = np.nonzero(u[i : i + step] @ u.T >= threshold)
            r, c = (i + r)[i + r != c], c[i + r != c]
            links += np.bincount(r, weight[c], len(u)).astype(np.int64)
            forest.join(r, c)
        root = np.full(len(u), np.iinfo(np.int64).max)
        np.minimum.at(root, forest.root, ids)
        some = np.flatnonzero(links > 0)
        return pa.table({"vec_id": ids[some], "links": links[some], "root": root[forest.root[some]]})

    return run


def _search(nodes: DataFrame, threshold: float, sample_rows: int, block: int) -> DataFrame:
    """Counts and spanning forests of the links among vectors (vec_id, weight, v) of one length."""
    sample = nodes.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    q = Quantiser.fit(np.array([r["v"] for r in sample]), list_count(nodes.count()), threshold=threshold)
    coded = written(nodes.select("vec_id", "weight", "v").mapInArrow(_encoder(q), _ROW))
    lists = len(q.centroids)
    visit = F.expr(f"filter(sequence(0, {lists - 1}), k -> (shiftright(conv(hex(substring(bits, int(k div 8) + 1, 1)), 16, 10)::int, int(k % 8)) & 1) = 1)")
    asked = coded.select("vec_id", "weight", "unit", "home", F.explode(visit).alias("list"))
    # One row per list, so at most 4,096 rows with their sizes.
    held = coded.groupBy(F.col("home").alias("list")).agg(F.count("*").alias("n"))
    wanted = asked.groupBy("list").agg(F.count("*").alias("m"))
    blocks = F.broadcast(written(held.join(wanted, "list").select("list", F.expr(f"int(ceil(n / {block}))").alias("nb"), F.expr(f"int(ceil(m / {block}))").alias("mb"))))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    members = coded.withColumn("list", F.col("home")).join(blocks, "list").select(
        F.lit(0).alias("role"), "list", (salt % F.col("nb")).cast("int").alias("b"), F.explode(F.expr("sequence(0, mb - 1)")).alias("s"),
        "vec_id", "weight", "unit", "home", "codes", "least", "bits",
    )
    queries = asked.join(blocks, "list").select(
        F.lit(1).alias("role"), "list", F.explode(F.expr("sequence(0, nb - 1)")).alias("b"), (salt % F.col("mb")).cast("int").alias("s"),
        "vec_id", "weight", "unit", "home", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("binary").alias("bits"),
    )
    return members.union(queries).groupBy("list", "b", "s").applyInArrow(_compare(q), _LINKS)


def neighbour_components(
    vectors: DataFrame, threshold: float = 0.9, sample_rows: int = 20_000, block: int = 4096, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: links are pairs found with cosine >= threshold.

    A null, zero or empty vector, or one with a null or non-finite component, links
    with nothing; vectors of different lengths do not link. Each length is a search of
    its own, but lengths of at most `block` vectors, other than the most frequent,
    are compared exactly, a length in one group. Equal vectors are one node with their
    number as weight. A quantiser is fitted on at most `sample_rows` vectors, the
    smallest by a hash of the id. Null ids are left out; rows with one id and vector
    count once, and of different vectors under one id the smallest by hash stands
    for it.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")).where("vec_id IS NOT NULL")
    finite = "v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    keyed = raw.withColumn("fine", F.expr(f"({finite}) AND exists(v, x -> x <> 0)")).withColumn("fine", F.coalesce("fine", F.lit(False)))
    # -0.0 and 0.0 are one value; two hashes make a key of 128 bits.
    keyed = keyed.withColumn("v", F.expr("transform(v, x -> x + 0.0D)"))
    keyed = keyed.select("vec_id", "v", "fine", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v", F.size("v")).alias("h2"))
    ids = written(
        keyed.groupBy("vec_id").agg(F.min(F.struct((~F.col("fine")).alias("bad"), "h1", "h2", F.size("v").alias("d"))).alias("k"))
        .select("vec_id", (~F.col("k.bad")).alias("fine"), "k.h1", "k.h2", "k.d")
    )
    # Longer lists than this are no rarity; each is a search of its own.
    sizes = ids.where("fine").groupBy("d").count()
    top = sizes.orderBy(F.desc("count"), "d").first()
    unlinked = ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if top is None:
        return unlinked
    searched = sorted({top["d"]} | {r["d"] for r in sizes.where(F.col("count") > block).collect()})
    usable = ids.where("fine")
    classes = usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    named = written(usable.join(classes, ["h1", "h2"]).select("vec_id", "rep", "weight", "h1", "h2"))
    reps = named.where("vec_id = rep").select("vec_id", "weight", "h1", "h2")
    nodes = keyed.join(reps, ["vec_id", "h1", "h2"]).groupBy("vec_id", "weight").agg(F.first("v").alias("v"))
    nodes = written(nodes.withColumn("d", F.size("v")))
    few = nodes.where(~F.col("d").isin(searched))
    found = [_search(nodes.where(F.col("d") == d), threshold, sample_rows, block) for d in searched]
    found.append(few.select("d", "vec_id", "weight", "v").groupBy("d").applyInArrow(_compare_all(threshold), _LINKS))
    found = written(reduce(DataFrame.union, found))
    settle(spark)
    component = written(components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    forget(spark, nodes)
    stars = named.select("vec_id", "rep", "weight").join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left")
    stars = stars.join(component.withColumnRenamed("id", "rep"), "rep", "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    return ids.select("vec_id").join(stars, "vec_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"),
    )
