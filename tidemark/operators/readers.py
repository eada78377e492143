"""Filtered readers and the data sets behind screens and archives: declarative, pushed to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_of(df: DataFrame, date: str, tickers: list[str] | None = None, start=None, end=None, at=None) -> DataFrame:
    """Rows of the tickers within inclusive dates; an exact date takes the place of the range."""
    if tickers:
        df = df.where(F.col("ticker").isin(tickers))
    if at is not None:
        return df.where(F.col(date) == F.lit(at))
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start))
    return df if end is None else df.where(F.col(date) <= F.lit(end))


def active(stocks: DataFrame, only: bool = True) -> DataFrame:
    return stocks.where(F.col("is_active") == 1) if only else stocks


def newest(df: DataFrame, *by: str, n: int | None = None) -> DataFrame:
    """Rows by the columns, largest first; ties by all other columns; the first ``n`` if asked for."""
    out = df.orderBy(*[F.col(c).desc() for c in by], *[c for c in df.columns if c not in by])
    return out if n is None else out.limit(n)


def month_ends(start, end) -> Column:
    """Month ends from ``start`` to ``end``, both inclusive, as an array."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    return F.filter(F.transform(months, F.last_day), lambda d: (d >= start) & (d <= end))


def valid_date(text: Column) -> Column:
    return F.expr("true") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()


def json_number(json: Column, key: str) -> Column:
    """A number of a JSON object; null where it is absent, no number or not finite."""
    value = F.get_json_object(json, f"$.{key}").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def screened(df: DataFrame, least_score: float, most_pe: float, classes: list[str], sectors: list[str], least_quality: float) -> DataFrame:
    """The conjunction of a screener's conditions; a null score counts 0 and a null P/E passes."""
    pe = F.col("current_pe_ratio")
    return df.where(
        (F.coalesce("final_score", F.lit(0.0)) >= least_score)
        & (pe.isNull() | (pe <= most_pe))
        & F.col("class").isin(classes)
        & F.col("sector").isin(sectors)
        & (F.coalesce("data_quality_score", F.lit(0.0)) >= least_quality)
    )


def confidence_tier(score: Column) -> Column:
    """Bands of a confidence of 0 to 100."""
    return F.when(score >= 90, "high").when(score >= 70, "solid").when(score >= 50, "fair").otherwise("low")


def capped(df: DataFrame) -> DataFrame:
    """What is shown: excess return within -0.5 and 1, probability up to 0.99."""
    return df.withColumns({"predicted_excess": F.least(F.greatest("predicted_excess", F.lit(-0.5)), F.lit(1.0)), "probability": F.least("probability", F.lit(0.99))})


def class_rank(c: Column, unknown: int = 2) -> Column:
    # Order of the classes.
    return F.when(c == "Strong candidate", 0).when(c == "Watchlist candidate", 1).when(c == "Neutral", 2).when(c == "Weak / avoid", 3).otherwise(unknown)


def last_known(df: DataFrame, key: str, date: str, columns: list[str]) -> DataFrame:
    """For each key the last value of each column that is not null, whatever row it stands in."""
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in columns])


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("ticker", "feature_date", sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)).alias("n_missing"))


def availability(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whether each feature is there, one row for each (ticker, feature)."""
    return df.unpivot(["ticker"], columns, "feature", "value").select("ticker", "feature", F.col("value").isNotNull().alias("there"))


def interpreted(ic: Column, significant: Column) -> Column:
    # The reading of an information coefficient.
    strength = F.abs(ic)
    reading = (
        F.when(~significant, "Not significant after multiple-testing correction")
        .when(strength < 0.02, "Very weak signal — likely noise")
        .when(strength < 0.05, "Weak signal — modest value")
        .when(strength < 0.10, "Moderate signal — worth including")
        .otherwise("Strong signal — high predictive value")
    )
    return F.when(ic.isNull() | F.isnan(ic), "Insufficient data").otherwise(F.concat(F.when(ic > 0, "Positive").otherwise("Negative"), F.lit(" relationship. "), reading, F.lit(".")))


def research_confidence(flag: Column, label: Column, quality: Column, agreement: Column, excess: Column) -> Column:
    """Points of 0 to 100: agreement of the models, class, data quality, votes and predicted excess."""
    share = lambda c: 15 * F.least(F.coalesce(c, F.lit(0.0)) / 100, F.lit(1.0))
    by_class = F.when(label == "Strong candidate", 25).when(label == "Watchlist candidate", 10).otherwise(0)
    by_excess = F.when(excess > 0.10, 10).when(excess > 0.05, 7).when(excess > 0, 3).otherwise(0)
    return 35 * (F.coalesce(flag, F.lit(0)) == 1).cast("int") + by_class + share(quality) + share(agreement) + by_excess


#: Share of profits that sectors pay out, and that of others.
PAYOUT = {"Consumer Staples": 0.55, "Energy": 0.45, "Financials": 0.40, "Healthcare": 0.30, "Technology": 0.15, "Communication Services": 0.20, "Consumer Discretionary": 0.20}
OTHER_PAYOUT = 0.25


def dividend_yield(sector: Column, ttm_eps: Column, price: Column) -> Column:
    share = F.lit(OTHER_PAYOUT)
    for name, value in PAYOUT.items():
        share = F.when(sector == name, value).otherwise(share)
    return F.when((ttm_eps > 0) & (price > 0), ttm_eps * share / price)


def return_between(benchmark: DataFrame, start, end) -> DataFrame:
    """Benchmark return from the first price at or after ``start`` to the last at or before ``end``, in one pass."""
    day, price = F.col("date"), F.col("adjusted_close")
    ends = benchmark.agg(F.min_by(price, F.when(day >= F.lit(start), day)).alias("p0"), F.max_by(price, F.when(day <= F.lit(end), day)).alias("p1"))
    return ends.select(F.when(F.col("p0") != 0, F.col("p1") / F.col("p0") - 1).alias("total_return"))


def accuracy_by_class(realized: DataFrame, classes: DataFrame) -> DataFrame:
    """Hit rate and returns of each class; predictions without a class form their own."""
    rows = realized.join(classes, ["feature_date", "ticker"], "left").where("winner_actual is not null")
    return rows.groupBy("class").agg(
        F.count("*").alias("n"),
        F.avg("correct").alias("hit_rate"),
        F.avg("winner_actual").alias("winner_rate"),
        F.avg("actual").alias("mean_actual"),
        F.avg("probability").alias("mean_probability"),
        F.avg("final_score").alias("mean_score"),
    )


def ic_heatmap(monthly: DataFrame, features: list[str]) -> DataFrame:
    """Information coefficients with a column for each feature and a row for each month."""
    return monthly.groupBy("feature_date").pivot("feature", features).agg(F.first("ic"))
