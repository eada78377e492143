"""Labels: return over a horizon relative to the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_divide, target_date
from .asof import nearest


def targets(keys: DataFrame, prices: DataFrame, benchmark: DataFrame, months: int = 12, as_of=None) -> DataFrame:
    """Stock, benchmark and excess return of each (feature_date, ticker); winner is excess > 0.

    Labels whose horizon lies after ``as_of`` stay null.
    """
    asked = keys.select("feature_date", "ticker").withColumn("target_date", target_date(F.col("feature_date"), months))
    got = nearest(asked, prices, "ticker", "feature_date", "date", "adjusted_close", "p0")
    got = nearest(got, prices, "ticker", "target_date", "date", "adjusted_close", "p1")
    got = nearest(got, benchmark, None, "feature_date", "date", "adjusted_close", "b0")
    got = nearest(got, benchmark, None, "target_date", "date", "adjusted_close", "b1")
    stock, bench = safe_divide(F.col("p1"), F.col("p0")) - 1, safe_divide(F.col("b1"), F.col("b0")) - 1
    if as_of is not None:
        due = F.col("target_date") <= F.lit(as_of)
        stock, bench = F.when(due, stock), F.when(due, bench)
    made = got.withColumns({"stock_return": stock, "benchmark_return": bench}).withColumn("excess_return", F.col("stock_return") - F.col("benchmark_return"))
    return made.select("feature_date", "ticker", "target_date", "stock_return", "benchmark_return", "excess_return", F.when(F.col("excess_return").isNotNull(), (F.col("excess_return") > 0).cast("int")).alias("winner"))


def fill_elapsed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old labels with nulls filled from newly computed ones."""
    keys = ["feature_date", "ticker"]
    names = ["target_date", "stock_return", "benchmark_return", "excess_return", "winner"]
    joined = old.join(new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in names]), keys, "left")
    return joined.select(*keys, *[F.coalesce(c, f"new_{c}").alias(c) for c in names])


def target_summary(labels: DataFrame) -> DataFrame:
    done = F.col("winner").isNotNull()
    return labels.agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("labelled"),
        F.count_if(~done).alias("pending"),
        F.avg("winner").alias("winner_rate"),
        F.avg("excess_return").alias("mean_excess"),
        F.stddev_samp("excess_return").alias("std_excess"),
        F.percentile("excess_return", F.lit(0.5)).alias("median_excess"),
        F.min("excess_return").alias("min_excess"),
        F.max("excess_return").alias("max_excess"),
        F.count_distinct("feature_date").alias("n_dates"),
        F.count_distinct("ticker").alias("n_tickers"),
    )


def winner_rate_by_sector(labels: DataFrame, stocks: DataFrame) -> DataFrame:
    rows = labels.where("winner is not null").join(stocks.select("ticker", "sector"), "ticker", "left")
    return rows.groupBy("sector").agg(F.count("*").alias("n"), F.avg("winner").alias("winner_rate"), F.avg("excess_return").alias("mean_excess"), F.stddev_samp("excess_return").alias("std_excess"))
