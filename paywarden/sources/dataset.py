"""The eight-table payments data set on Parquet: load, write, layer, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywarden.schema import TABLES

STATIC_TABLES = ("parties", "devices", "merchants", "mandates", "disputes")


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def load_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All eight tables with their declared schemas; a missing table is an error.

    Timestamps are instants; a wall clock such as Asia/Kolkata is applied by the
    operators that need one.
    """
    out = {}
    for name, schema in TABLES.items():
        path = f"{folder}/{name}.parquet"
        found = _read_if_there(spark, path)
        if found is None:
            raise FileNotFoundError(f"missing dataset table: {path}")
        # A declared schema would read an absent column as null.
        absent = [f.name for f in schema.fields if f.name not in found.columns]
        if absent:
            raise ValueError(f"{path} lacks the columns {', '.join(absent)}")
        out[name] = spark.read.schema(schema).parquet(path)
    return out


def _read_if_there(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame | None:
    """None for a path that does not exist; any other trouble is an error."""
    try:
        return spark.read.format(form).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def with_event_time(transactions: DataFrame) -> DataFrame:
    """Add the integer columns the operators scan: microseconds and cents."""
    return transactions.withColumns(
        {"ts_us": F.unix_micros("timestamp"), "cents": (F.col("amount") * 100).cast("long")}
    )


def normalise_timestamps(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """Wall-clock columns without a zone become instants, read as ``tz``."""
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.to_utc_timestamp(F.col(c).cast("timestamp"), tz) for c in zoneless})


def write_table(df: DataFrame, name: str, folder: str, mode: str = "errorifexists") -> None:
    """Write a table in its declared column order and types."""
    schema = TABLES[name]
    _conform(df, schema).to(T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])).write.mode(
        mode
    ).parquet(f"{folder}/{name}.parquet")


def write_empty_table(spark: SparkSession, name: str, folder: str) -> None:
    write_table(spark.createDataFrame([], TABLES[name]), name, folder)


def write_report(spark: SparkSession, report: DataFrame, path: str) -> None:
    """A one-row nested report as a single JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def manifest(tables: Mapping[str, DataFrame], version: str, seed: int | None = None) -> DataFrame:
    """One nested row: version, seed, row counts and the transaction time range."""
    counts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in sorted(tables.items())]
    rows = reduce(DataFrame.unionByName, counts).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("row_counts")
    )
    span = tables["transactions"].agg(
        F.min("timestamp").alias("transaction_start"), F.max("timestamp").alias("transaction_end")
    )
    return rows.crossJoin(span).select(
        F.lit(version).alias("dataset_version"), F.lit(seed).cast("long").alias("seed"), "*"
    )


def layer(
    baseline: Mapping[str, DataFrame], *extra: Mapping[str, DataFrame], tables: Sequence[str] = ("transactions", "labels")
) -> dict[str, DataFrame]:
    """Stack attack and lookalike rows on a baseline; the other tables are carried over."""
    out = dict(baseline)
    for name in tables:
        parts = [baseline[name], *[e[name] for e in extra if name in e]]
        out[name] = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out


def read_existing(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """Union of the retained-row files that exist; None when there is none."""
    found = [df for path in paths if (df := _read_if_there(spark, path)) is not None]
    if not found:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
