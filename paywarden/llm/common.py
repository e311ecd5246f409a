"""Shared pieces: intermediate tables in the cluster's shared folder, text chunks, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one the session names in ``spark.checkpoint.dir``.

    Only a local master may go without that setting (tests): every task then runs
    on this machine, and a temporary folder is as good as a shared one.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-shared-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs tasks, not the whole plan, and
    so that two readers of one frame do not compute it twice.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete intermediate tables of `written` that no later frame reads."""
    jvm = spark._jvm
    for df in frames:
        for f in df.inputFiles()[:1]:
            p = jvm.org.apache.hadoop.fs.Path(f.rsplit("/", 1)[0])
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settle(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that are over.

    They stay until the driver collects its garbage, which a driver with little to
    do may not do for the length of a job. The second collection takes what the
    first one only released.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.5)
    spark._jvm.System.gc()


def blank(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """`rows` with `rank` (from 0) among the rows of their key in this order, and `n`, the rows of the key.

    A global order is dealt into ranges; ranks are those inside a range plus the rows
    of the key in earlier ranges. A key may fill many ranges, and so may one value of
    the order: rows that tie are dealt by their place in the input.
    """
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(key, *order, "_row")
    held = written(dealt.sortWithinPartitions(key, *order, "_row").drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    held = held.withColumn("_part", F.shiftright("_at", 33))
    of_key = Window.partitionBy(key)
    earlier = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range and key that meet.
    runs = held.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    runs = runs.select(key, "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(of_key).alias("n"))
    rank = F.col("_at") - F.col("_first") + F.col("_before")
    return held.join(runs, [key, "_part"]).select(*rows.columns, rank.alias("rank"), "n")


def text_chunks(texts: list[str], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs [from, to) of whole texts of about `limit` characters, to bound the memory of a task."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def components(nodes_edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): rows (id, component), the smallest id reachable.

    Alternates two star steps until nothing changes: each node's neighbours above it
    point to the smallest id near it, then those below it do. A step is one grouped
    minimum, combined before the shuffle, and one join whose hot keys adaptive
    execution may split. Only ids that occur in an edge come back.
    """
    edges = written(
        nodes_edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    known = None
    while True:
        # Large star: every neighbour v > u of u is linked to the smallest id around u.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: u and its neighbours below it are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = written(small.where("a <> b").distinct())
        # Both steps keep the components, so equal sums of hashes mean equal edges: a fixed point.
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(nodes_edges.sparkSession, edges)
        edges = after
        if state == known:
            break
        known = state
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return stars.union(roots)
