"""Daily prices to clean month-end series, and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def standardize_prices(daily: DataFrame, ticker: str = "ticker", date: str = "date", price: str = "adjusted_close", volume: str = "volume") -> DataFrame:
    """Month ends from an entity's first to its last month: the last value of each column that is not null.

    Months without a row stay, flagged ``missing``; prices of 0 or less are ``suspect``.
    A return is that on the last price before it, as gaps are filled forward.
    """
    rows = daily.select(F.col(ticker).alias("ticker"), F.to_date(date).alias("day"), F.col(price).try_cast("double").alias("p"), F.col(volume).try_cast("double").alias("v")).where("day is not null")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("day")))
    monthly = rows.groupBy("ticker", F.last_day("day").alias("date")).agg(last("p").alias("adjusted_close"), last("v").alias("volume"))
    spine = monthly.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b")).select("ticker", F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")).select("ticker", F.last_day("m").alias("date"))
    full = spine.join(monthly, ["ticker", "date"], "left")
    w = Window.partitionBy("ticker").orderBy("date")
    filled = full.withColumn("known", F.last("adjusted_close", ignorenulls=True).over(w))
    flag = F.when(F.col("adjusted_close").isNull(), "missing").when(F.col("adjusted_close") <= 0, "suspect").otherwise("ok")
    return filled.withColumn("monthly_return", F.try_divide("known", F.lag("known").over(w)) - 1).select("ticker", "date", "adjusted_close", "volume", "monthly_return", flag.alias("data_quality_flag"))


def validate_prices(prices: DataFrame, extreme: float = 0.8) -> DataFrame:
    """Counts of what is wrong with each entity's series."""
    return prices.groupBy("ticker").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("adjusted_close").isNull()).alias("n_missing"),
        F.count_if(F.col("adjusted_close") <= 0).alias("n_not_positive"),
        F.count_if(F.abs("monthly_return") > extreme).alias("n_extreme"),
        (F.count("date") - F.count_distinct("date")).alias("n_repeated_dates"),
    )


def returns_matrix(prices: DataFrame, tickers: list[str], least: int = 12) -> DataFrame:
    """Returns with a column for each entity; entities with fewer than ``least`` returns are null throughout."""
    w = Window.partitionBy("ticker")
    enough = prices.withColumn("_n", F.count("monthly_return").over(w)).where((F.col("_n") >= least) & F.col("monthly_return").isNotNull())
    return enough.groupBy("date").pivot("ticker", tickers).agg(F.first("monthly_return"))


def clipped_to_training(df: DataFrame, columns: list[str], train: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Columns clipped to the quantiles of the rows where ``train`` holds; one row of quantiles is broadcast."""
    cuts = df.where(train).agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(cuts))  # one row
    return joined.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_{c}")[1]), F.col(f"_{c}")[0])) for c in columns}).drop(*[f"_{c}" for c in columns])
