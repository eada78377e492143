"""Student's t as Spark expressions: two-sided p-values and quantiles, row by row in the JVM.

The regularised incomplete beta function is a continued fraction of a fixed number of
terms, folded from its end by ``aggregate`` over a sequence; the log of the gamma function is a
Stirling series. Quantiles start from a normal one and take Newton steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 200
STEPS = 12


def log_gamma(x: Column) -> Column:
    """ln(gamma(x)) of positive x: Stirling's series at x + 8, brought back by the product."""
    product = F.lit(1.0)
    for k in range(8):
        product = product * (x + k)
    y = x + 8
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def beta_share(a: Column, b: Column, x: Column, terms: int = TERMS) -> Column:
    """The regularised incomplete beta function of 0 <= x <= 1."""

    def tail(a: Column, b: Column, x: Column) -> Column:
        """For x below (a + 1) / (a + b + 2), where the fraction converges fast."""

        def fold(rest: Column, k: Column) -> Column:
            m = F.floor(k / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + F.when(k % 2 == 0, even).otherwise(odd) / rest

        fraction = F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(terms))), F.lit(1.0), fold)
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x)) / a
        return front / fraction

    inside = F.when(x < (a + 1) / (a + b + 2), tail(a, b, x)).otherwise(1 - tail(b, a, 1 - x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value; null where t or df is null or df is not positive."""
    v = df.cast("double")
    return F.when(v > 0, beta_share(v / 2, F.lit(0.5), v / (v + t * t)))


def t_quantile(p: float, df: Column) -> Column:
    """The two-sided quantile: |t| exceeds it with probability ``p``."""
    v = df.cast("double")
    log_front = log_gamma((v + 1) / 2) - log_gamma(v / 2) - 0.5 * F.ln(v * math.pi)
    density = lambda t: F.exp(log_front - (v + 1) / 2 * F.ln(1 + t * t / v))
    # In y = ln(t) the p-value falls smoothly for every df, so steps from the heavy tail's own order converge.
    start = F.when(v < 3, F.pow(F.lit(2.0 / p), 1 / v)).otherwise(F.lit(2.0 + 4.0 * p))

    def step(y: Column, _: Column) -> Column:
        t = F.exp(y)
        now = t_p_value(t, v)
        return y + F.greatest(F.least((F.ln(now) - math.log(p)) * now / (2 * density(t) * t), F.lit(1.0)), F.lit(-1.0))

    return F.when(v > 0, F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.ln(start), step)))
