"""Cross-sectional statistics in long form: one pass over (feature, month)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import student
from ..functions.scalars import average_rank, quantile_bucket


def long_form(panel: DataFrame, features: list[str], label: str = "excess_return") -> DataFrame:
    """(feature, feature_date, ticker, x, y) of the complete pairs."""
    return panel.unpivot(["feature_date", "ticker", label], features, "feature", "x").where(f"x is not null and {label} is not null").withColumnRenamed(label, "y")


def monthly_ic(long: DataFrame, least: int = 5) -> DataFrame:
    """Spearman correlation of each feature with the label, month by month."""
    ranked = long.withColumns({"rx": average_rank(F.col("x"), "feature", "feature_date"), "ry": average_rank(F.col("y"), "feature", "feature_date")})
    got = ranked.groupBy("feature", "feature_date").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("ic")).where(F.col("n") >= least)
    return got.where(F.col("ic").isNotNull() & ~F.isnan("ic"))


def ic_summary(ics: DataFrame, least: int = 12) -> DataFrame:
    mean, std, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    return ics.groupBy("feature").agg(n.alias("n_months"), mean.alias("mean_ic"), std.alias("std_ic"), F.try_divide(mean, std).alias("icir"), F.try_divide(mean, std / F.sqrt(n)).alias("t_stat")).where(F.col("n_months") >= least)


def ic_stability(ics: DataFrame, months: int = 36) -> DataFrame:
    """Share of full rolling windows whose mean is positive."""
    w = Window.partitionBy("feature").orderBy("feature_date").rowsBetween(-(months - 1), 0)
    rolled = ics.withColumn("rolling", F.when(F.count("ic").over(w) == months, F.avg("ic").over(w)))
    return rolled.where("rolling is not null").groupBy("feature").agg(F.count("*").alias("n_windows"), F.avg((F.col("rolling") > 0).cast("double")).alias("pct_positive"))


def rolling_ic(ics: DataFrame, months: int = 36) -> DataFrame:
    w = Window.partitionBy("feature").orderBy("feature_date").rowsBetween(-(months - 1), 0)
    return ics.select("feature", "feature_date", F.when(F.count("ic").over(w) == months, F.avg("ic").over(w)).alias("rolling_ic"))


def quintiles(long: DataFrame, q: int = 5, least: int = 10) -> DataFrame:
    """Mean over months of each bucket's mean label, and its spread over the lowest bucket."""
    enough = long.withColumn("n", F.count("*").over(Window.partitionBy("feature", "feature_date"))).where(F.col("n") >= least)
    cut = enough.withColumn("bucket", quantile_bucket(F.col("x"), q, "feature", "feature_date"))
    monthly = cut.groupBy("feature", "feature_date", "bucket").agg(F.avg("y").alias("m"), F.count("*").alias("n"))
    out = monthly.groupBy("feature", "bucket").agg(F.avg("m").alias("mean_return"), F.sum("n").alias("n"))
    return out.withColumn("spread", F.col("mean_return") - F.first("mean_return").over(Window.partitionBy("feature").orderBy("bucket")))


def pooled(long: DataFrame, least: int = 10) -> DataFrame:
    return long.groupBy("feature").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")).where(F.col("n") >= least)


def corrected(p_values: DataFrame, p: str = "p_value") -> DataFrame:
    """Bonferroni and Benjamini-Hochberg corrections of a table of p-values (null counts as 1)."""
    everything = Window.partitionBy()
    known = p_values.withColumn(p, F.coalesce(p, F.lit(1.0)))
    m, rank = F.count("*").over(everything), F.row_number().over(Window.orderBy(p, "feature"))
    scaled = known.withColumns({"bonferroni": F.least(F.col(p) * m, F.lit(1.0)), "_scaled": F.col(p) * m / rank, "_rank": rank})
    return scaled.withColumn("bh", F.least(F.min("_scaled").over(Window.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0))).drop("_scaled", "_rank")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def t_p_value(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def correlation_report(panel: DataFrame, features: list[str]) -> DataFrame:
    """Every feature's correlation, IC summary, stability and corrected p-values.

    The p-value of a feature needs its r and n only: one small row a feature.
    """
    long = long_form(panel, features)
    ics = monthly_ic(long)
    r, n = F.col("r"), F.col("n")
    t = r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-15)))
    p_table = corrected(pooled(long).select("feature", student.t_p_value(t, n - 2).alias("p_value")))
    return pooled(long).join(ic_summary(ics), "feature", "left").join(ic_stability(ics), "feature", "left").join(p_table, "feature", "left").orderBy(F.abs("mean_ic").desc_nulls_last(), "feature")
