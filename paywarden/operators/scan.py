"""Ordered scans that survive hot keys.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. When
one payer or payee holds a large share of the table that task never ends. Here rows
take two lanes. Keys of at most ``max_rows`` rows keep the plain window plan. The
rows of larger keys, and only these, are dealt into ranges of (key, order columns)
and written once; each range is scanned on its own and receives the state of the
earlier ranges of the key from a small table of range totals. All order columns
take part, so one value of the first of them may fill many ranges. When no key is
large the second lane leaves no trace in the plan.

``sliding`` builds trailing-window counts, sums and distinct counts out of such a
scan: a row adds its contribution at its own time and takes it back when it
leaves the window, so the cost is linear in the rows whatever the window holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paywarden.session import cut_lineage

MAX_ROWS_PER_TASK = 4_000_000
MAX_HOT_KEYS_ON_DRIVER = 1_000
# Wide rows that pass several scans in one task.
ROWS_PER_SPREAD_TASK = 100_000
# Small ranges are written several to a task.
MIN_ROWS_PER_FILE = 16_384
# An exchange has at most so many ranges as parts of their own.
MAX_RANGE_PARTS = 1_000
CHUNK = "_chunk"


def _join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null keys meet each other; only the left copy of the keys stays."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


@dataclass(frozen=True)
class HotKeys:
    """The keys that are too large for one task, and into how many ranges their rows are dealt."""

    keys: tuple[str, ...]
    table: DataFrame
    small: bool
    ranges: int
    rows: int
    # Into how many tasks the rows of the other keys are dealt; None leaves it to the session.
    tasks: int | None = None
    # The rows of the other keys have been set apart before.
    alone: bool = False

    def _only(self, df: DataFrame, how: str) -> DataFrame:
        # Spark moves these joins below the windows and unions of earlier scans of the key.
        return _join_on_keys(df, F.broadcast(self.table) if self.small else self.table, self.keys, how)

    def part(self, df: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """Rows of the other keys (None if there are none), and those of the hot keys."""
        if self.alone or not self.keys:
            return None, df
        cold = self._only(df, "left_anti")
        return cold.repartition(self.tasks, *self.keys) if self.tasks else cold, self._only(df, "left_semi")

    def lanes(self, df: DataFrame, order: Sequence[str]) -> tuple[DataFrame | None, DataFrame]:
        """Rows of the other keys (None if there are none), and those of the hot keys with their range.

        The hot rows are written, so a task that runs again sees the same ranges.
        """
        cold, rows = self.part(df)
        files = max(1, min(self.ranges, math.ceil(self.rows / MIN_ROWS_PER_FILE)))
        if self.ranges <= MAX_RANGE_PARTS:
            dealt = rows.repartitionByRange(self.ranges, *self.keys, *order)
            # The number of a range is that of its own partition, also where a task writes several.
            return cold, cut_lineage(dealt.withColumn(CHUNK, F.spark_partition_id().cast("long")).coalesce(files))
        dealt = rows.repartitionByRange(files, *self.keys, *order)
        # More of them are cut inside the sorted tasks, as an exchange must not have a part for each.
        place, size = F.monotonically_increasing_id().alias("_place"), max(1, math.ceil(self.rows / self.ranges))
        dealt = dealt.sortWithinPartitions(*self.keys, *order).select("*", place)
        return cold, cut_lineage(dealt.withColumn(CHUNK, F.expr(f"_place div {size}L")).drop("_place"))


def in_lanes(df: DataFrame, hot: HotKeys | None, build: Callable[[DataFrame, HotKeys | None], DataFrame]) -> DataFrame:
    """``build(rows, hot)``, several scans of one key that follow each other.

    The rows are parted once. If each scan parted them, what the rows of the other keys come
    from would run once more for every scan.
    """
    if hot is None or hot.alone or not hot.keys:
        return build(df, hot)
    cold, rows = hot.part(df)
    return build(cold, None).unionByName(build(rows, replace(hot, alone=True)))


def find_hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> HotKeys | None:
    """Count rows per key; ``None`` when every key fits in one task.

    Runs one aggregation over the key columns, combined before its shuffle.
    """
    keys = tuple(keys)
    counts = df.select(*keys).groupBy(*keys).count().filter(F.col("count") > max_rows)
    found = counts.limit(MAX_HOT_KEYS_ON_DRIVER + 1).collect()
    if not found:
        return None
    small = len(found) <= MAX_HOT_KEYS_ON_DRIVER
    total = sum(r["count"] for r in found) if small else counts.agg(F.sum("count")).first()[0]
    if small:
        schema = df.select(*keys).schema
        table = df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in found], schema) if keys else counts
    else:
        table = cut_lineage(counts.select(*keys))
    return HotKeys(keys, table, small, max(2, math.ceil(total / max_rows)), total)


def spread_tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: all cores, and more where a task would get too many, whatever the session's shuffle partitions."""
    cores = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(cores, math.ceil(rows / ROWS_PER_SPREAD_TASK))


def count_keys(df: DataFrame, keys: Sequence[str], order: str, max_rows: int = MAX_ROWS_PER_TASK) -> tuple[int, HotKeys | None]:
    """``spread_tasks`` of all rows, and the hot keys; one aggregation when no key is hot."""
    counts = df.select(*keys).groupBy(*keys).count()
    rows, largest = counts.agg(F.sum("count"), F.max("count")).first()
    tasks = spread_tasks(df.sparkSession, rows or 0)
    hot = find_hot_keys(df, keys, order, max_rows) if (largest or 0) > max_rows else None
    return tasks, hot and replace(hot, tasks=tasks)


@dataclass(frozen=True)
class KeyCensus:
    """Hot keys of several key sets of one table, found by a single count; for detectors that share the table.

    Parts of the table have no hot keys but these. A key that is hot in the table and
    small in a part takes the lane of the hot keys there, which costs time and nothing else.
    """

    found: Mapping[tuple[str, ...], HotKeys | None]

    def hot(self, keys: Sequence[str]) -> HotKeys | None:
        return self.found[tuple(keys)]


def key_census(
    df: DataFrame,
    key_sets: Sequence[Sequence[str]],
    max_rows: int = MAX_ROWS_PER_TASK,
    either: Mapping[str, Sequence[str]] | None = None,
) -> KeyCensus:
    """Count the rows of every key set in one aggregation over grouping sets.

    ``either`` names a key that stands in several columns, such as a party that pays and
    is paid: it is hot when one of its columns holds more than ``max_rows / len(columns)``
    rows of it. Those columns must be key sets of their own.
    """
    either = dict(either or {})
    sets = [tuple(keys) for keys in key_sets]
    columns = list(dict.fromkeys(k for keys in sets for k in keys))
    share = max((len(cs) for cs in either.values()), default=1)
    c = F.col
    # A bit of the grouping id is set for each column that is not of the set.
    ids = {keys: sum(1 << (len(columns) - 1 - i) for i, k in enumerate(columns) if k not in keys) for keys in sets}
    counts = (
        df.select(*columns).groupingSets([[c(k) for k in keys] for keys in sets], *[c(k) for k in columns])
        .agg(F.count("*").alias("_rows"), F.grouping_id().alias("_set"))
        .filter(c("_rows") > max_rows // share)
    )
    found = counts.limit(MAX_HOT_KEYS_ON_DRIVER + 1).collect()
    names = [*sets, *[(name,) for name in either]]
    if not found:
        return KeyCensus(dict.fromkeys(names))
    small = len(found) <= MAX_HOT_KEYS_ON_DRIVER
    counts = df.sparkSession.createDataFrame(found, counts.schema) if small else cut_lineage(counts)

    def table(keys: tuple[str, ...], rows: DataFrame) -> HotKeys | None:
        total = rows.agg(F.sum("_rows")).first()[0]
        if total is None:
            return None
        return HotKeys(keys, rows.select(*keys).distinct(), small, max(2, math.ceil(total / max_rows)), total)

    out = {keys: table(keys, counts.filter((c("_set") == ids[keys]) & (c("_rows") > max_rows))) for keys in sets}
    for name, cs in either.items():
        parts = [
            counts.filter((c("_set") == ids[(k,)]) & (c("_rows") > max_rows // len(cs))).select(c(k).alias(name), "_rows") for k in cs
        ]
        out[(name,)] = table((name,), reduce(DataFrame.unionByName, parts))
    return KeyCensus(out)


@dataclass(frozen=True)
class Metric:
    """One scanned value. ``op``: sum, max, min, bit_or, last, lag, lead, moments."""

    op: str
    value: Column
    inclusive: bool = False


def _local(name: str, m: Metric, spec) -> dict[str, Column]:
    if m.op == "lag":
        return {name: F.lag(m.value).over(spec)}
    if m.op == "lead":
        return {name: F.lead(m.value).over(spec)}
    frame = spec.rowsBetween(Window.unboundedPreceding, 0 if m.inclusive else -1)
    if m.op == "moments":
        return {
            f"{name}_n": F.count(m.value).over(frame),
            f"{name}_mean": F.avg(m.value).over(frame),
            f"{name}_var": F.var_pop(m.value).over(frame),
        }
    if m.op == "sum":
        return {name: F.coalesce(F.sum(m.value).over(frame), F.lit(0))}
    if m.op == "bit_or":
        return {name: F.coalesce(F.bit_or(m.value).over(frame), F.lit(0))}
    if m.op == "last":
        return {name: F.last(m.value, ignorenulls=True).over(frame)}
    return {name: {"max": F.max, "min": F.min}[m.op](m.value).over(frame)}


def _totals(name: str, m: Metric, order: Column, reverse: bool) -> dict[str, Column]:
    c = f"_c_{name}"
    if m.op == "moments":
        n = F.count(m.value)
        return {f"{c}_n": n, f"{c}_mean": F.coalesce(F.avg(m.value), F.lit(0.0)), f"{c}_m2": F.coalesce(n * F.var_pop(m.value), F.lit(0.0))}
    if m.op == "last":
        pick = F.min_by if reverse else F.max_by
        return {c: pick(m.value, F.when(m.value.isNotNull(), order))}
    fn = {"sum": F.sum, "max": F.max, "lag": F.max, "min": F.min, "lead": F.min, "bit_or": F.bit_or}
    return {c: fn[m.op](m.value)}


def _carry(name: str, m: Metric, spec, reverse: bool) -> dict[str, Column]:
    c = f"_c_{name}"
    before = spec.rowsBetween(Window.unboundedPreceding, -1)
    if m.op == "moments":
        # Sums are taken around the mean of the whole key, so that large values do not cancel.
        n, mean, whole = F.col(f"{c}_n"), F.col(f"{c}_mean"), spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        middle = F.sum(n * mean).over(whole) / F.greatest(F.sum(n).over(whole), F.lit(1))
        off = mean - middle
        return {
            f"{c}_n": F.sum(n).over(before), f"{c}_c": middle, f"{c}_s": F.sum(n * off).over(before),
            f"{c}_q": F.sum(F.col(f"{c}_m2") + n * off * off).over(before),
        }
    if m.op == "last":
        return {c: F.last(c, ignorenulls=True).over(before)}
    if m.op == "lead":
        return {c: F.min(c).over(spec.rowsBetween(1, Window.unboundedFollowing))}
    fn = {"sum": F.sum, "max": F.max, "lag": F.max, "min": F.min, "bit_or": F.bit_or}
    return {c: fn[m.op](c).over(before)}


def _merge(name: str, m: Metric) -> dict[str, Column]:
    here, c = F.col(name), F.col(f"_c_{name}")
    if m.op == "moments":
        na, nb = F.coalesce(F.col(f"_c_{name}_n"), F.lit(0)), F.col(f"{name}_n")
        off = F.when(na > 0, F.col(f"_c_{name}_s") / na).otherwise(0.0)
        ma = F.coalesce(F.col(f"_c_{name}_c"), F.lit(0.0)) + off
        m2a = F.when(na > 0, F.greatest(F.lit(0.0), F.col(f"_c_{name}_q") - na * off * off)).otherwise(0.0)
        mb, vb = F.coalesce(F.col(f"{name}_mean"), F.lit(0.0)), F.coalesce(F.col(f"{name}_var"), F.lit(0.0))
        n = na + nb
        return {
            f"{name}_n": n,
            f"{name}_mean": F.when(n > 0, (na * ma + nb * mb) / n),
            f"{name}_var": F.when(n > 0, (m2a + nb * vb + (mb - ma) ** 2 * na * nb / n) / n),
        }
    if m.op in ("sum",):
        return {name: here + F.coalesce(c, F.lit(0))}
    if m.op == "bit_or":
        return {name: here.bitwiseOR(F.coalesce(c, F.lit(0)))}
    if m.op == "max":
        return {name: F.greatest(here, c)}
    if m.op == "min":
        return {name: F.least(here, c)}
    return {name: F.coalesce(here, c)}


def prefix_scans(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: Sequence[tuple[Sequence[str], Mapping[str, Metric]]],
    hot: HotKeys | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Add running values over each key in ``order``; ``reverse`` scans from the end.

    Each scan is ``(within, metrics)``: ``within`` names columns that cut a key
    further (the payees of a payer), while the ranges are still those of ``keys``.
    The scans must not depend on each other. The rows of hot keys are written once,
    and the range totals of all scans come from that copy.
    """
    ordering = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]

    def spec_for(cols):
        return (Window.partitionBy(*cols) if cols else Window.partitionBy()).orderBy(*ordering)

    if hot is None:
        for within, metrics in scans:
            spec = spec_for([*keys, *within])
            exprs: dict[str, Column] = {}
            for name, m in metrics.items():
                exprs.update(_local(name, m, spec))
            df = df.select("*", *[e.alias(n) for n, e in exprs.items()])
        return df

    cold, hot_rows = hot.lanes(df, order)
    at = F.struct(*order)
    out = hot_rows
    for within, metrics in scans:
        groups = [*keys, *within]
        spec = spec_for([*groups, CHUNK])
        chunk_spec = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy(
            F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
        )
        local, totals, carry, merged = {}, {}, {}, {}
        for name, m in metrics.items():
            local.update(_local(name, m, spec))
            totals.update(_totals(name, m, at, reverse))
            carry.update(_carry(name, m, chunk_spec, reverse))
            merged.update(_merge(name, m))
        chunk_totals = (
            hot_rows.groupBy(*groups, CHUNK)
            .agg(*[e.alias(n) for n, e in totals.items()])
            .select(*groups, CHUNK, *[e.alias(n) for n, e in carry.items()])
        )
        before = out.columns
        left = out.select("*", *[e.alias(n) for n, e in local.items()])
        # A null group value must still meet its own totals.
        on = F.col(f"l.{CHUNK}") == F.col(f"r.{CHUNK}")
        for g in groups:
            on = on & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
        joined = left.alias("l").join(chunk_totals.alias("r"), on, "left").select("l.*", *[f"r.{n}" for n in carry])
        out = joined.select(*before, *[e.alias(n) for n, e in merged.items()])
    out = out.drop(CHUNK)
    return out if cold is None else prefix_scans(cold, keys, order, scans, None, reverse).unionByName(out)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    metrics: Mapping[str, Metric],
    hot: HotKeys | None = None,
    within: Sequence[str] = (),
    reverse: bool = False,
) -> DataFrame:
    """One scan; see ``prefix_scans``."""
    return prefix_scans(df, keys, order, [(within, metrics)], hot, reverse)


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    windows: Mapping[str, int],
    sums: Mapping[str, str] | None = None,
    distincts: Mapping[str, str] | None = None,
    count: str | None = "count",
    include_current: bool = False,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Trailing-window counts, sums and distinct counts per key.

    A row sees the earlier rows of its key (in ``(ts, tie)`` order) whose time is
    at or after ``ts - width``; both ends are closed. ``windows`` maps a suffix to
    a width in the unit of ``ts``. ``sums`` maps an output name to an integer
    column, ``distincts`` to a value column whose null and '' are skipped. Output
    columns are ``{name}_{suffix}``.
    """
    sums, distincts = dict(sums or {}), dict(distincts or {})
    if hot is not None and hot.keys and not hot.alone:
        return in_lanes(df, hot, lambda rows, h: sliding(rows, keys, ts, tie, windows, sums, distincts, count, include_current, h))
    columns = df.columns
    if distincts:
        islands = [
            ((value,), {f"_prev_{name}": Metric("lag", F.col(ts)), f"_next_{name}": Metric("lead", F.col(ts))})
            for name, value in distincts.items()
        ]
        df = prefix_scans(df, keys, [ts, tie], islands, hot)

    # Per event: its time, whether it is a row (0) or an exit (1), and what it changes.
    names: list[str] = []
    enter: dict[str, str] = {}
    leave: dict[str, dict[str, str]] = {suffix: {} for suffix in windows}
    for suffix, width in windows.items():
        if count:
            names.append(f"{count}_{suffix}")
            enter[names[-1]], leave[suffix][names[-1]] = "1L", "-1L"
        for name, value in sums.items():
            names.append(f"{name}_{suffix}")
            enter[names[-1]] = f"coalesce(cast(`{value}` as bigint), 0L)"
            leave[suffix][names[-1]] = f"-coalesce(cast(`{value}` as bigint), 0L)"
        for name, value in distincts.items():
            # Equal values closer than the width form one stretch: it counts from its
            # first row until the width after its last one.
            names.append(f"{name}_{suffix}")
            filled = f"`{value}` IS NOT NULL AND cast(`{value}` as string) <> ''"
            prev, nxt = f"`_prev_{name}`", f"`_next_{name}`"
            enter[names[-1]] = f"CASE WHEN {filled} AND ({prev} IS NULL OR `{ts}` - {prev} > {width}L) THEN 1L ELSE 0L END"
            leave[suffix][names[-1]] = f"CASE WHEN {filled} AND ({nxt} IS NULL OR {nxt} - `{ts}` > {width}L) THEN -1L ELSE 0L END"

    def event(time: str, kind: int, deltas: Mapping[str, str], row: str) -> str:
        changes = ", ".join(f"'_d_{n}', {deltas.get(n, '0L')}" for n in names)
        return f"named_struct('_t', cast({time} as bigint), '_k', {kind}, {changes}, '_row', {row})"

    row = "struct(" + ", ".join(f"`{c}`" for c in columns) + ")"
    events = [event(f"`{ts}`", 0, enter, row)] + [
        event(f"`{ts}` + {width}L", 1, leave[suffix], f"if(false, {row}, null)") for suffix, width in windows.items()
    ]
    timeline = df.selectExpr(
        *[f"`{k}`" for k in keys], f"`{tie}` AS _tie", f"explode(array({', '.join(events)})) AS _e"
    ).selectExpr(*[f"`{k}`" for k in keys], "_tie", "_e.*")
    scanned = prefix_scan(
        timeline,
        keys,
        ["_t", "_k", "_tie"],
        {n: Metric("sum", F.col(f"_d_{n}"), inclusive=include_current) for n in names},
        hot=hot,
    )
    # Key columns stay as they are, so their partitioning is still known afterwards.
    own = [f"`{c}`" if c in keys else f"_row.`{c}`" for c in columns]
    return scanned.filter("_k = 0").selectExpr(*own, *[f"`{n}`" for n in names])
