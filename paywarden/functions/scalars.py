"""Column expressions shared by the rule scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ramp_up(value: Column | str, low: float, high: float) -> Column:
    """0 up to ``low``, 1 from ``high``, linear between; null counts as 0."""
    v = col(value).cast("double")
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))
    return F.when(v.isNull(), 0.0).otherwise(ramp)


def ramp_down(value: Column | str, full: float, zero: float) -> Column:
    """1 up to ``full``, 0 from ``zero``; null counts as 0."""
    v = col(value)
    return F.when(v.isNull(), 0.0).otherwise(1.0 - ramp_up(v, full, zero))


def money(value: Column | str, floor: float = 0.01) -> Column:
    """Round half up to two decimals, never below ``floor``."""
    return F.round(F.greatest(col(value), F.lit(floor)), 2).cast(MONEY)


def is_round_amount(amount: Column | str) -> Column:
    """Multiples of 100; multiples of 500 are among them."""
    return col(amount) % 100 == 0


def calibrated_base_score(
    probability: Column | str, recall_threshold: float, precision_threshold: float
) -> Column:
    """Map a model probability to 0-100 around two operating points.

    0-30 below the recall point, 30-60 up to the precision point, 60-100 above.
    """
    p = col(probability)
    low = 30.0 * (p / recall_threshold) if recall_threshold > 0 else F.lit(0.0)
    mid_span = precision_threshold - recall_threshold
    mid = 30.0 + 30.0 * ((p - recall_threshold) / mid_span) if mid_span > 0 else F.lit(60.0)
    top_span = 1.0 - precision_threshold
    top = (
        F.least(F.lit(100.0), 60.0 + 40.0 * ((p - precision_threshold) / top_span))
        if top_span > 0
        else F.lit(100.0)
    )
    return F.when(p < recall_threshold, low).when(p < precision_threshold, mid).otherwise(top)


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, halves rounded up."""
    return F.format_string(f"%.{digits}f", F.round(value.cast("double") + 1e-9, digits))


def grouped(value: Column, digits: int) -> Column:
    """Text with thousands separators."""
    return F.format_number(F.round(value.cast("double") + 1e-9, digits), digits)


def top_family(probabilities: Column | str) -> Column:
    """(probability, family) of the largest entry; equal ones by name."""
    entries = F.map_entries(col(probabilities))
    best = F.array_min(F.transform(entries, lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("family"))))
    return F.when(
        F.size(entries) > 0, F.struct((-best["p"]).alias("probability"), best["family"].alias("family"))
    )


def expected_severity(probabilities: Column | str, severity: dict[str, float], default: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in severity.items() for x in kv])
    return F.aggregate(
        F.map_entries(col(probabilities)),
        F.lit(0.0),
        lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(table, e["key"]), F.lit(default)),
    )


def top_contributions(contributions: Column | str, k: int = 6, smallest: float = 1e-6) -> Column:
    """The k largest by absolute value, tiny ones dropped after the cut."""
    ranked = F.array_sort(
        F.transform(
            col(contributions),
            lambda e: F.struct(
                (-F.abs(e["contribution"])).alias("rank"), e["name"].alias("name"), e["contribution"].alias("contribution")
            ),
        )
    )
    kept = F.filter(F.slice(ranked, 1, k), lambda e: F.abs(e["contribution"]) > smallest)
    return F.transform(
        kept,
        lambda e: F.struct(
            e["name"].alias("name"),
            e["contribution"].alias("contribution"),
            F.when(e["contribution"] > 0, "increases_risk").otherwise("decreases_risk").alias("direction"),
        ),
    )
