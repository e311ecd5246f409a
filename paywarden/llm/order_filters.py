"""Jaccard join on word shingles, filtered by prefixes under several global token orders.

Two sets that link share at least t = ceil(0.75 n) tokens, so under any one order of
all tokens their prefixes of n - t + l tokens share l tokens. The orders used:

0. by hash. Only prefix tokens are counted over the corpus: a token that one document
   has is dead, and a document with fewer than l living prefix tokens links with none.
   This leaves a small part of the corpus, whose whole sets go on.
1. by document frequency, then hash. Prefix tokens make the lists in which candidates meet.
2. and 3. by frequency, then other hashes. A candidate pair must also share a token of
   both these prefixes before its sets are compared.

If a pair's first common token under order 1 is at living places i and j, it shares no
more than the lesser of what either has from there on (its room). A pair that links
meets that bound at its first common token, so it forms only where the bound holds.

Equal sets are one class. Lists never become all pairs of their documents: in a few
rounds every document of a list is compared with one hub of it, components so far are
found, and what is left to compare are pairs of different components only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.llm.common import blank, components, forget, settle, text_chunks, written
from paywarden.llm.shingles import mixed, shingle_sets

HUB_ROUNDS = 2
CHUNK = 250_000  # characters of text at once in a task, for bounded memory


def needed(n):
    """Shared tokens that a set of n tokens needs at least with any partner; also its least size."""
    return (3 * n + 3) // 4


def slack(n):
    """l of order 0: the more, the longer the prefix and the fewer documents that pass."""
    return 1 + n // 16


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix tokens of order 0 as rows (token, n = 0, doc), and one row (0, n + 1, doc) per document."""
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_pylist()
        for i, j in text_chunks(texts, CHUNK):
            sets = shingle_sets(texts[i:j])
            n = np.array([len(s) for s in sets])
            p = np.minimum(n, n - needed(n) + slack(n))
            tokens = np.concatenate([np.empty(0, np.uint64), *(s[:k] for s, k in zip(sets, p.tolist()))]).view(np.int64)
            doc = ids[i:j]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([tokens, doc])),
                    pa.array(np.concatenate([np.zeros(len(tokens), np.int32), (n + 1).astype(np.int32)])),
                    pa.array(np.concatenate([np.repeat(doc, p), doc])),
                ],
                ["token", "n", "doc"],
            )


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, j in text_chunks(texts, CHUNK):
            sets = shingle_sets(texts[i:j])
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(halves[:, 0].copy()),
                 pa.array(halves[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["doc", "rows", "d1", "d2", "tokens"],
            )


def _order_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Living prefix tokens of a document under orders 1 to 3, from its living tokens and their frequencies."""
    for batch in batches:
        sizes = batch.column(1).to_numpy(zero_copy_only=False)
        dfs, tokens = (batch.column(k).flatten().to_numpy() for k in (2, 3))
        ends = np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
        docs, flat, places, kept = [], ([], [], []), [], []
        for doc, n, lo, hi in zip(batch.column(0).to_pylist(), sizes.tolist(), np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
            # Dead tokens come first in every order by frequency and take their places.
            p = n - needed(n) + 1 - (n - (hi - lo))
            if p > 0:
                df, token = dfs[lo:hi], tokens[lo:hi]
                h = token.view(np.uint64)
                docs.append(doc)
                kept.append((n, hi - lo))
                places.append(min(p, hi - lo))
                for out, tie in zip(flat, (h, mixed(h, 1), mixed(h, 2))):
                    out.append(token[np.lexsort([tie, df])[:p]])
        bounds = pa.array(np.concatenate([[0], np.cumsum(places)]), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.empty(0, np.int64), *out]))) for out in flat]
        size, alive = (pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), size, alive, *lists], ["doc", "n", "alive", "o1", "o2", "o3"])


def linked(shared: Column, n: Column, m: Column) -> Column:
    return 100 * shared >= 75 * (n + m - shared)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: filters of orders 2 and 3 first, then the whole sets."""

    def side(x: str) -> DataFrame:
        return sets.select(F.col("doc").alias(x), F.col("o2").alias(f"o2{x}"), F.col("o3").alias(f"o3{x}"), F.col("tokens").alias(f"s{x}"))

    both = pairs.join(side("b"), "b").join(side("a"), "a")
    size = [F.size("sa").cast("long"), F.size("sb").cast("long")]
    close = (4 * size[0] >= 3 * size[1]) & (4 * size[1] >= 3 * size[0])
    hit = both.where(close & F.arrays_overlap("o2a", "o2b") & F.arrays_overlap("o3a", "o3b"))
    return hit.where(linked(F.size(F.array_intersect("sa", "sb")).cast("long"), *size)).select("a", "b").distinct()


def _may_link(n: str, room: str, t_n: str, t_room: str) -> Column:
    """What two documents have from a common token on is enough for their sizes."""
    return 7 * F.least(room, t_room) >= 3 * (F.col(n) + F.col(t_n))


def _links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between representatives whose components are all those of the Jaccard graph."""
    side = ["doc", "n", "room", "label"]
    pair = [F.least("doc", "t_doc").alias("a"), F.greatest("doc", "t_doc").alias("b")]
    edges, label = None, None

    def labelled() -> DataFrame:
        if label is None:
            return lists.withColumn("label", F.col("doc"))
        return lists.join(label, lists["doc"] == label["id"], "left").select(
            "token", "doc", "n", "room", "dead_share", F.coalesce("component", "doc").alias("label")
        )

    for r in range(HUB_ROUNDS):
        open_ = labelled()
        # First the document with the smallest share of dead tokens, which most others are near to; then others.
        rank = ["dead_share"] if r == 0 else []
        hub = open_.groupBy("token").agg(F.min(F.struct(*rank, F.xxhash64("doc", F.lit(r)).alias("h"), *side)).alias("hub"))
        pairs = open_.join(hub.select("token", *(F.col(f"hub.{c}").alias(f"t_{c}") for c in side)), "token")
        pairs = pairs.where("label <> t_label").where(_may_link("n", "room", "t_n", "t_room")).select(*pair).distinct()
        links = written(verified(pairs, sets))
        edges = links if edges is None else edges.union(links)
        label = written(components(edges))
    # Labels that still meet in a list, with the best that a document of each can have there.
    open_ = written(labelled())
    best = open_.groupBy("token", "label").agg(F.max("room").alias("room"), F.min("n").alias("n"))
    several = best.groupBy("token").agg(F.count("*").alias("labels")).where("labels > 1").select("token")
    best = written(best.join(several, "token"))
    other = best.select("token", F.col("label").alias("t_label"), F.col("room").alias("t_room"), F.col("n").alias("t_n"))
    could = _may_link("n", "room", "t_n", "t_room")
    meet = best.join(other, "token").where((F.col("label") < F.col("t_label")) & could)
    mine = meet.select("token", "label", "t_label", "t_room", "t_n").join(open_, ["token", "label"]).where(could).drop("t_room", "t_n")
    theirs = open_.select("token", *(F.col(c).alias(f"t_{c}") for c in side))
    rest = mine.join(theirs, ["token", "t_label"]).where(could)
    return edges.union(written(verified(rest.select(*pair).distinct(), sets)))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: components of Jaccard >= 0.75 on five-word shingles.

    Null and empty texts have no set and link with nothing. Rows without doc_id are
    left out, as nothing could refer to them. Rows that share a doc_id are one
    document; if their texts differ, the one with the largest set stands for it.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", blank("text").alias("text"))
    tokens = texts.mapInArrow(_prefix_rows, "token long, n int, doc long")
    # Combined before the shuffle, so a token of a third of all rows is a few rows here.
    counted = tokens.groupBy("token", "n").agg(F.count("*").alias("c"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    # A token of one document counts against it; a document's own row keeps its size.
    own = F.col("n") > 0
    told = counted.where("n > 0 OR lo = hi").select(
        F.when(own, F.col("token")).otherwise(F.col("lo")).alias("doc"), "n", F.when(own, F.col("c")).otherwise(0).alias("rows")
    )
    stats = written(
        told.groupBy("doc").agg((F.max("n") - 1).alias("n"), F.count(F.when(~own, 1)).alias("dead"), F.sum("rows").alias("rows"))
    )
    settle(spark)
    # Hints below keep one plan at every size: what passes grows with the corpus, so it is never broadcast.
    t = F.expr("(3 * n + 3) div 4")
    alive = F.least("n", F.col("n") - t + 1 + F.expr("n div 16")) - F.col("dead")
    passing = stats.where("n > 0").where((alive >= 1 + F.floor(t / 16)) | (F.col("rows") > 1)).select("doc", "rows")
    every = written(
        texts.join(passing.hint("merge"), texts["doc_id"] == passing["doc"]).select("doc_id", "text", "rows")
        .mapInArrow(_whole_sets, "doc long, rows long, d1 long, d2 long, tokens array<long>").where("size(tokens) > 0")
    )
    settle(spark)
    largest = F.max(F.struct(F.size("tokens").alias("n"), "d1", "d2", "tokens")).alias("s")
    sets = every.where("rows = 1").select("doc", "d1", "d2", "tokens").union(
        every.where("rows > 1").groupBy("doc").agg(largest).select("doc", "s.d1", "s.d2", "s.tokens")
    )
    classes = sets.groupBy("d1", "d2").agg(F.min("doc").alias("rep"))
    members = written(sets.select("doc", "d1", "d2").join(classes, ["d1", "d2"]).select("doc", "rep"))
    reps = written(
        sets.join(members.where("doc = rep").select("doc").hint("merge"), "doc", "left_semi").select("doc", F.size("tokens").alias("n"), "tokens")
    )
    forget(spark, every)
    settle(spark)
    counted = reps.select("doc", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("df"), F.min("doc").alias("lo"), F.max("doc").alias("hi")
    )
    dead = counted.where("lo = hi").groupBy(F.col("lo").alias("doc")).agg(F.sum("df").alias("dead"))
    frequent = counted.where("lo <> hi").select("token", "df")
    open_ = reps.join(dead.hint("merge"), "doc", "left").where(F.col("n") - F.coalesce("dead", F.lit(0)) >= t)
    living = open_.select("doc", "n", F.explode("tokens").alias("token")).join(frequent, "token")
    living = living.groupBy("doc", "n").agg(F.collect_list("df").alias("dfs"), F.collect_list("token").alias("found"))
    prefixes = written(living.mapInArrow(_order_prefixes, "doc long, n long, alive long, o1 array<long>, o2 array<long>, o3 array<long>"))
    settle(spark)
    posted = prefixes.select("doc", "n", "alive", F.posexplode("o1").alias("at", "token")).select(
        "token", "doc", "n", (F.col("alive") - F.col("at")).alias("room"), (1 - F.col("alive") / F.col("n")).alias("dead_share")
    )
    shared = posted.groupBy("token").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("token")
    lists = written(posted.join(shared, "token"))
    listed = lists.select("doc").distinct()
    near = written(reps.join(listed, "doc", "left_semi").select("doc", "tokens").join(prefixes.select("doc", "o2", "o3"), "doc"))
    forget(spark, reps, prefixes)
    settle(spark)
    component = components(_links(lists, near))
    forget(spark, lists, near)
    settle(spark)
    copies = members.where("doc <> rep")
    placed = copies.join(component, copies["rep"] == component["id"], "left").select(
        "doc", F.coalesce("component", "rep").alias("component")
    ).union(component.select(F.col("id").alias("doc"), "component"))
    return stats.join(placed, "doc", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component", "doc").alias("component_id"),
    )
