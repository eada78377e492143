"""Scalar expressions: null-safe arithmetic, dates, bands."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def safe_divide(n: Column, d: Column) -> Column:
    return F.try_divide(n.cast("double"), d.cast("double"))


def pct_change(new: Column, old: Column) -> Column:
    return safe_divide(new - old, F.abs(old))


def cagr(old: Column, new: Column, years: float) -> Column:
    """Compound growth a year; null unless both ends and the span are positive."""
    return F.when((old > 0) & (new > 0) & F.lit(years > 0), F.pow(new / old, F.lit(1.0 / years)) - 1)


def clip_pe(pe: Column, most: float = 500.0) -> Column:
    return F.when((pe > 0) & (pe <= most), pe)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def months_ago(d: Column, n: int) -> Column:
    """Month end ``n`` months before a date."""
    return F.last_day(F.add_months(d, -n))


def target_date(d: Column, months: int = 12) -> Column:
    return F.last_day(F.add_months(d, months))


def calendar_months_between(a: Column, b: Column) -> Column:
    return (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))


def quarter_label(d: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(d).cast("string"))


def report_lag_days(d: Column) -> Column:
    return F.when(F.quarter(d) == 4, 90).otherwise(45)


def probability_bucket(p: Column) -> Column:
    # Bucket labels.
    return (
        F.when(p.isNull() | F.isnan(p), "Unknown")
        .when(p < 0.40, "< 0.40 (Low)")
        .when(p < 0.50, "0.40–0.50")
        .when(p < 0.60, "0.50–0.60")
        .when(p < 0.70, "0.60–0.70")
        .when(p < 0.80, "0.70–0.80")
        .otherwise("≥ 0.80 (High)")
    )


def average_rank(c: Column, *by: str) -> Column:
    """Rank with ties averaged; null where the value is null."""
    w = Window.partitionBy(*by).orderBy(c.asc_nulls_last())
    upto = F.count("*").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(c.isNotNull(), (F.rank().over(w) + upto) / 2)


def percent_rank_average(c: Column, *by: str) -> Column:
    """Average rank as a share of the non-null rows."""
    return average_rank(c, *by) / F.count(c).over(Window.partitionBy(*by))


def rank_score(c: Column, *by: str) -> Column:
    return F.coalesce(percent_rank_average(c, *by) * 100, F.lit(50.0))


def inverse_rank_score(c: Column, *by: str) -> Column:
    return 100 - rank_score(c, *by)


def quantile_bucket(c: Column, q: int, *by: str) -> Column:
    """Equal-frequency bucket (1 up), right-closed, with repeated edges dropped."""
    edges = F.array_distinct(F.percentile(c, F.array(*[F.lit(i / q) for i in range(q + 1)])).over(Window.partitionBy(*by)))
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    # An edge between equal values is that value but for rounding, so edges are compared relative to it.
    return F.when(c.isNotNull(), 1 + F.size(F.filter(inner, lambda e: e < c - F.abs(c) * 1e-12)))


def half_even(c: Column, digits: int) -> Column:
    """Rounded to an even last digit at ties; noise beyond the eighth digit is no difference."""
    units = F.round(c * 1e8).cast("long")
    step = 10 ** (8 - digits)
    whole, rest = F.floor(units / step).cast("long"), F.pmod(units, F.lit(step))
    up = (2 * rest > step) | ((2 * rest == step) & (whole % 2 != 0))
    return (whole + up.cast("long")) / 10**digits
