"""A Merkle manifest of a data set as a content-addressed DAG, with membership proofs by descent.

Every row is a leaf. The leaves of a language ascend by doc_id and are hashed pairwise,
level by level, to a subroot; the subroots, ordered by language, likewise give the
root. The store maps a digest to what lies under it: a record holds the levels of
`height` consecutive generations, children first, so a tree of n leaves is read in
log2(n) / height joins. A record is addressed by its content, so equal subtrees share
one.

A proof starts at the root. The digits of a leaf's rank (base 2^height) name the
record on its way, their bits the child; children that are not selected are collected.
Leaves below one record share the way to it: only distinct prefixes of the ranks
descend, and the requests of a last record, at most 2^height, meet it at once. The
collected path runs from the root down and is reversed in the end.

DataFrame functions only. Nothing but the root's digest reaches the driver, and no group
holds more than 2^height rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paywarden.llm.common import numbered, written

HEIGHT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<digest:string,left:boolean>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**changed: Column) -> Column:
    return F.sha2(F.concat(*(field(changed.get(name, F.col(name))) for name in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, altered): altered is the leaf of a row that is tampered with, null for the others.

    `tree` is the language, marked so that null is a value and comes first.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id", leaf_digest().alias("leaf"),
        F.when(chosen, leaf_digest(n_chars=more)).alias("altered"),
    )


# Levels of a record from its bottom up: pairs are hashed until `up` levels lie on it; the last run may be one node.
_LEVELS = """
aggregate(IF(up = 0, array(), sequence(1, up)), array(kids), (done, j) -> concat(done, array(
    transform(sequence(0, (size(element_at(done, -1)) - 1) div 2), i -> sha2(concat(
        get(element_at(done, -1), int(2 * i)), coalesce(get(element_at(done, -1), int(2 * i + 1)), '')), 256)))))
"""


def build(nodes: DataFrame, height: int) -> tuple[DataFrame, list[DataFrame]]:
    """Tops (tree, digest) of the trees over nodes (tree, rank, n, digest), and the records of each layer."""
    layer, records = nodes.select("tree", "rank", "n", "digest"), []
    while True:
        # Levels above n nodes: the bits of n - 1.
        up = f"int(least({height}, IF(n = 1, 0, length(bin(n - 1)))))"
        group = layer.groupBy("tree", "n", F.shiftright("rank", height).alias("rank")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("kids"))
        group = group.select("tree", "n", "rank", F.expr("transform(kids, k -> k.digest)").alias("kids"), F.expr(up).alias("up"))
        group = written(group.select("tree", "n", "rank", "up", F.expr(_LEVELS).alias("levels")))
        top = group.select("tree", "rank", F.expr(f"(n + {(1 << height) - 1}) div {1 << height}").alias("n"), F.expr("levels[up][0]").alias("digest"))
        record = F.expr("reverse(slice(levels, 1, up))").alias("children")
        records.append(group.where("up > 0").select(F.expr("levels[up][0]").alias("digest"), record).dropDuplicates(["digest"]))
        layer = top
        if not group.where(f"n > {1 << height}").limit(1).count():
            return top.select("tree", "digest"), records


def write_manifest(docs: DataFrame, folder: str, height: int = HEIGHT) -> str | None:
    """Write the manifest of `docs` to `folder` and return its root, None without rows.

    `folder`/leaves: tree, doc_id, leaf, altered, rank and n of every row; rows of one
    language and doc_id ascend by leaf; a null doc_id comes first. `folder`/languages:
    the subroots. `folder`/records: digest to children, content-addressed.
    """
    spark = docs.sparkSession
    ranked = written(numbered(written(leaves(docs)), "tree", "doc_id", "leaf"), f"{folder}/leaves")
    subroots, layers = build(ranked.withColumnRenamed("leaf", "digest"), height)
    over = numbered(written(subroots.select(F.lit("root").alias("tree"), F.col("tree").alias("lang"), "digest")), "tree", "lang")
    languages = written(over, f"{folder}/languages")
    root, upper = build(languages, height)
    for records in layers + upper:
        records.write.mode("append").parquet(f"{folder}/records")
    found = root.first()
    return found["digest"] if found else None


def descend(records: DataFrame, start: DataFrame, wanted: DataFrame, payload: list[str], height: int) -> DataFrame:
    """The nodes at the bottom of trees, by their ranks: payload, digest, subroot and the path from the root.

    `start`: (tree, digest, subroot, path) of the tops; `wanted`: (tree, rank, n) of the
    distinct requests with the columns `payload`. A layer of the DAG takes one join
    of the prefixes asked for with the records they lead to.
    """
    most = wanted.agg(F.max("n")).first()[0] or 1
    layers = 1
    while most > 1 << (height * layers):
        layers += 1
    mask = (1 << height) - 1
    at = start.select("tree", F.lit(0).cast("long").alias("prefix"), "digest", "subroot", "path")
    for s in reversed(range(layers)):
        # Nodes at the bottom of this layer; a tree of one node there has no record in it.
        held = F.expr(f"(n + {(1 << height * s) - 1}) div {1 << height * s}")
        place = F.shiftright("rank", height * s)
        asked = wanted.select("tree", place.alias("rank"), (held > 1).alias("deep"), *(payload if s == 0 else []))
        asked = asked if s == 0 else asked.distinct()
        asked = asked.select("tree", "deep", F.shiftright("rank", height).alias("prefix"), F.struct(F.expr(f"int(rank & {mask})").alias("digit"), "rank", *(payload if s == 0 else [])).alias("w"))
        groups = asked.groupBy("tree", "prefix", "deep").agg(F.collect_list("w").alias("ws"))
        met = groups.join(at, ["tree", "prefix"]).withColumn("key", F.when(F.col("deep"), F.col("digest")))
        met = met.join(records.withColumnRenamed("digest", "key"), "key", "left")
        found = F.expr("""
            explode(transform(ws, w -> struct(w,
                IF(deep, element_at(children, -1)[w.digit], digest) AS digest,
                IF(deep, concat(path, transform(sequence(1, size(children)), t -> struct(
                    get(children[t - 1], shiftright(w.digit, size(children) - t) ^ 1) AS digest,
                    shiftright(w.digit, size(children) - t) % 2 = 1 AS left))), path) AS path)))
        """)  # fmt: skip
        out = met.select("tree", "subroot", found.alias("f"))
        at = written(out.select("tree", F.col("f.w.rank").alias("prefix"), "subroot", F.col("f.digest").alias("digest"), F.col("f.path").alias("path"), *(F.col(f"f.w.{c}").alias(c) for c in (payload if s == 0 else []))))
    return at.select(*payload, "tree", "digest", "subroot", "path")


# The collected siblings, leaf first, are hashed onto a leaf from their sides; a missing one leaves the node alone.
FOLD = "aggregate({path}, {leaf}, (h, s) -> sha2(IF(s.left, concat(s.digest, h), concat(h, coalesce(s.digest, ''))), 256))"


def prove(spark: SparkSession, folder: str, root: str, requests: DataFrame | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, altered, subroot, path (leaf first) of the rows of a manifest, or of the ids in `requests`."""
    records = spark.read.parquet(f"{folder}/records")
    wanted, languages = spark.read.parquet(f"{folder}/leaves"), spark.read.parquet(f"{folder}/languages")
    if requests is not None:
        wanted = wanted.join(requests.select("doc_id").distinct(), "doc_id")
    none = F.array().cast(PATH).alias("path")
    start = spark.range(1).select(F.lit("root").alias("tree"), F.lit(root).alias("digest"), F.lit(root).alias("subroot"), none)
    tops = descend(records, start, languages.select("tree", "rank", "n", "lang"), ["lang"], height)
    tops = tops.select(F.col("lang").alias("tree"), "digest", F.col("digest").alias("subroot"), "path")
    found = descend(records, tops, wanted, ["doc_id", "leaf", "altered"], height)
    return found.where("digest = leaf").select("doc_id", "leaf", "altered", "subroot", F.reverse("path").alias("path"))


def manifest_proofs(docs: DataFrame, folder: str, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of `docs`.

    A null in any column is hashed as `-`; a null doc_id is not tampered with. Rows that
    share language and doc_id are leaves of their own, in the order of their digests. An
    empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    root = write_manifest(docs, folder, height)
    schema = "doc_id long, leaf string, altered string, subroot string, path " + PATH
    proofs = prove(spark, folder, root, None, height) if root else spark.createDataFrame([], schema)
    digests = F.expr("concat_ws('', transform(path, s -> s.digest))")
    proofs = proofs.withColumn("folded_root", F.expr(FOLD.format(path="path", leaf="coalesce(altered, leaf)")))
    return proofs.select(
        "doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.sha2(digests, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"),
    )


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR))::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf_sql(n_chars: str = "n_chars") -> str:
    return f"sha256({' || '.join(_field_sql(n_chars if c == 'n_chars' else c) for c in FIELDS)})"


# Two recursive trees, siblings level by level, a fold over them; crc32 by its reflected polynomial.
ORACLE = f"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
leaves AS (
  SELECT doc_id, lang, {_leaf_sql()} AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 7 = 0 THEN {_leaf_sql('n_chars + 1')} ELSE {_leaf_sql()} END AS altered
  FROM documents, crc_table
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), tree AS (
  SELECT lang, 0 AS level, pos, leaf AS digest, n FROM ranked
  UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n
), subroots AS (
  SELECT lang, digest AS subroot, level AS depth, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, subroot AS digest, n FROM subroots
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, pos // 2, n
), top AS (SELECT digest AS root, level AS height FROM upper WHERE n = 1),
steps AS (
  SELECT r.doc_id, r.leaf, s.subroot, l AS step, r.pos >> l AS place, t.digest AS sibling FROM ranked r JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang
    CROSS JOIN LATERAL (SELECT unnest(range(s.depth)) AS l) LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM r.lang AND t.level = l AND t.pos = xor(r.pos >> l, 1)
  UNION ALL
  SELECT r.doc_id, r.leaf, s.subroot, s.depth + l, s.pos >> l, u.digest FROM ranked r JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang
    CROSS JOIN top CROSS JOIN LATERAL (SELECT unnest(range(top.height)) AS l) LEFT JOIN upper u ON u.level = l AND u.pos = xor(s.pos >> l, 1)
), paths AS (SELECT doc_id, leaf, list({{'left': place % 2 = 1, 'digest': sibling}} ORDER BY step) AS path FROM steps GROUP BY doc_id, leaf),
proofs AS (
  SELECT r.doc_id, r.leaf, r.altered, s.subroot, top.root, coalesce(p.path, []) AS path FROM ranked r JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang
    CROSS JOIN top LEFT JOIN paths p ON p.doc_id IS NOT DISTINCT FROM r.doc_id AND p.leaf = r.leaf
), folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s.digest), ''), '')) AS proof_sha256,
    list_reduce(list_prepend({{'left': false, 'digest': altered}}, path),
      lambda h, s: {{'left': false, 'digest': sha256(CASE WHEN s.left THEN s.digest || h.digest ELSE h.digest || coalesce(s.digest, '') END)}}).digest AS folded_root
  FROM proofs
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
