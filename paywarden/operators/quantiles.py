"""Exact quantiles and ranks by counting, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.operators.scan import MAX_ROWS_PER_TASK, Metric, _join_on_keys, find_hot_keys, prefix_scan
from paywarden.session import cut_lineage

MAX_BROADCAST_KEYS = 1_000


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, max_rows: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """Distinct values per key with ``_n`` and ``_below``, the rows strictly under them."""
    rows = df.filter(F.col(value).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    # A key has no more distinct values than rows, and rows are cheaper to count.
    hot = find_hot_keys(rows, keys, value, max_rows)
    return prefix_scan(counts, keys, [value], {"_below": Metric("sum", F.col("_n"))}, hot=hot)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    rule: str = "lower",
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """One row per key with a column per entry of ``probs``.

    ``lower`` takes the value at position ``floor((n - 1) * p)`` of the sorted
    values; ``linear`` interpolates between the two neighbours of ``(n - 1) * p``.
    """
    keys = list(keys)
    ranked = value_counts(df, keys, value, max_rows)
    totals = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_values"))
    joined = ranked.join(totals, keys) if keys else ranked.crossJoin(totals)

    def at(position):
        inside = (F.col("_below") <= position) & (position < F.col("_below") + F.col("_n"))
        return F.max(F.when(inside, F.col(value)))

    out = []
    for name, p in probs.items():
        h = (F.col("n_values") - 1) * F.lit(float(p))
        if rule == "lower":
            out.append(at(F.floor(h)).alias(name))
        else:
            lo, hi = at(F.floor(h)).cast("double"), at(F.ceil(h)).cast("double")
            share = F.max(h - F.floor(h))
            out.append((lo + share * (hi - lo)).alias(name))
    return joined.groupBy(*keys).agg(F.max("n_values").alias("n_values"), *out)


def percent_rank_average(
    df: DataFrame, keys: Sequence[str], value: str, out: str, max_rows: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """Rank with average ties over the non-null count of the key; null stays null."""
    keys = list(keys)
    ranked = value_counts(df, keys, value, max_rows)
    totals = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_total"))
    ranked = ranked.join(totals, keys) if keys else ranked.crossJoin(totals)
    ranked = ranked.select(
        *keys, value, ((F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_total")).alias(out)
    )
    return df.join(ranked, [*keys, value], "left")


def bracketed_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    probs: Mapping[str, float],
    accuracy: int = 2_000,
    max_rows: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Exact interpolated quantiles of many columns per key: ``(*keys, feature, n_values, *probs)``.

    A mergeable sketch brackets every quantile in one pass, with a rank error of at most
    one part in ``accuracy``. The rows below a bracket are then counted, and only values
    inside it, about ``4 / accuracy`` of the rows, become rows of their own; none do where the
    bracket is a single value, however many rows share it. A column with at most ``10 * accuracy`` values in a key is bracketed by everything. Columns without
    any value in a key give no row.
    """
    keys, c = list(keys), F.col
    rows = df.select(*keys, *[c(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    margin = 2.0 / accuracy
    edges = [e for p in probs.values() for e in (max(0.0, p - margin), min(1.0, p + margin))]
    cells = [(i, j) for i in range(len(values)) for j in range(len(probs))]

    def low(i: int, j: int):
        return F.when(c(f"_n{i}") > 10 * accuracy, c(f"_e{i}")[2 * j]).otherwise(float("-inf"))

    def high(i: int, j: int):  # NaN is the largest double
        return F.when(c(f"_n{i}") > 10 * accuracy, c(f"_e{i}")[2 * j + 1]).otherwise(float("nan"))

    def single(i: int, j: int):
        """The quantile itself when both ends of its bracket are one value."""
        e = c(f"_e{i}")
        return F.when((c(f"_n{i}") > 10 * accuracy) & (e[2 * j] == e[2 * j + 1]), e[2 * j])

    # Bounds are columns of a key's one row: each row of the input only compares. Nothing lies within a null bound.
    # The sketches of all tasks are merged by one task a key.
    brackets = cut_lineage(rows.coalesce(df.sparkSession.sparkContext.defaultParallelism).groupBy(*keys).agg(
        *[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(values))],
        *[F.percentile_approx(f"_v{i}", edges, accuracy).alias(f"_e{i}") for i in range(len(values))],
    ).select(
        *keys, *[f"_n{i}" for i in range(len(values))],
        *[
            x for i, j in cells for x in (
                low(i, j).alias(f"_l{i}_{j}"), F.when(single(i, j).isNull(), high(i, j)).alias(f"_h{i}_{j}"), single(i, j).alias(f"_s{i}_{j}"),
            )
        ],
    ))
    few = brackets.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    sizes, singles = [f"_n{i}" for i in range(len(values))], [f"_s{i}_{j}" for i, j in cells]
    beside = F.broadcast(brackets.drop(*sizes, *singles)) if few else brackets.drop(*sizes, *singles)
    met = _join_on_keys(rows, beside, keys, "inner") if keys else rows.crossJoin(beside)
    below = met.groupBy(*keys).agg(*[F.count_if(c(f"_v{i}") < c(f"_l{i}_{j}")).alias(f"_u{i}_{j}") for i, j in cells])
    counted = brackets.select(*keys, *sizes, *singles)
    below = _join_on_keys(below, counted, keys, "inner") if keys else below.crossJoin(counted)
    starts = below.select(
        *keys,
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("_f"), F.lit(j).alias("_p"), c(f"_u{i}_{j}").alias("_under"), c(f"_n{i}").alias("n_values"))
            for i, j in cells
        ])).alias("_s"),
    ).select(*keys, "_s.*")
    found = F.array(*[
        F.when(
            c(f"_v{i}").between(c(f"_l{i}_{j}"), c(f"_h{i}_{j}")), F.struct(F.lit(i).alias("_f"), F.lit(j).alias("_p"), c(f"_v{i}").alias("_v"))
        )
        for i, j in cells
    ])
    inside = met.select(*keys, F.explode(F.array_compact(found)).alias("_s")).select(*keys, "_s.*")
    cell = [*keys, "_f", "_p"]
    counts = cut_lineage(inside.groupBy(*cell, "_v").agg(F.count("*").alias("_n")))
    ranked = prefix_scan(counts, cell, ["_v"], {"_below": Metric("sum", c("_n"))}, find_hot_keys(counts, cell, "_v", max_rows))
    h = (c("n_values") - 1) * F.element_at(F.array(*[F.lit(float(p)) for p in probs.values()]), c("_p") + 1)
    first = c("_below") + c("_under")

    def at(position):
        return F.max(F.when((first <= position) & (position < first + c("_n")), c("_v")))

    lo, hi = at(F.floor(h)), at(F.ceil(h))
    exact = _join_on_keys(ranked, starts, cell, "inner").groupBy(*cell).agg(
        F.max("n_values").alias("n_values"), (lo + F.max(h - F.floor(h)) * (hi - lo)).alias("_q")
    )
    known = F.array(*[
        F.struct(F.lit(i).alias("_f"), F.lit(j).alias("_p"), c(f"_n{i}").alias("n_values"), c(f"_s{i}_{j}").alias("_one")) for i, j in cells
    ])
    ones = counted.select(*keys, F.explode(known).alias("_s")).select(*keys, "_s.*").filter("_one IS NOT NULL")
    ones = ones.select(*cell, "n_values", (c("_one") + (c("_one") - c("_one"))).alias("_q"))
    exact = exact.select(*cell, "n_values", "_q").unionByName(ones)
    name = F.element_at(F.array(*[F.lit(v) for v in values]), c("_f") + 1).alias("feature")
    return exact.groupBy(*keys, name).agg(
        F.max("n_values").alias("n_values"), *[F.max(F.when(c("_p") == j, c("_q"))).alias(p) for j, p in enumerate(probs)]
    )
