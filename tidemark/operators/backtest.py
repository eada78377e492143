"""Set-based simulation of rebalanced portfolios, its metrics, and realised accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import probability_bucket
from .asof import next_period


def select_portfolio(scored: DataFrame, n: int, least_quality: float = 0.0, by: str = "feature_date") -> DataFrame:
    """The top n by score at every date; ties go by ticker."""
    able = scored.where(F.coalesce("data_quality_score", F.lit(0.0)) >= least_quality)
    return able.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col("final_score").desc(), "ticker"))).where(F.col("place") <= n)


def simulate(picks: DataFrame, prices: DataFrame, benchmark: DataFrame, warm_up: int = 24) -> DataFrame:
    """Equal-weight return of each month's picks in the next month, beside the benchmark's."""
    calendar = benchmark.select("date").distinct()
    dated = next_period(picks.withColumnRenamed("feature_date", "date"), calendar, "date")
    place = calendar.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))
    earned = dated.join(prices.select("ticker", F.col("date").alias("next_date"), F.col("monthly_return").alias("r")), ["ticker", "next_date"], "left")
    monthly = earned.groupBy("date", "next_date").agg(F.avg("r").alias("portfolio_return"), F.count("r").alias("n_held"))
    bench = benchmark.select(F.col("date").alias("next_date"), F.col("monthly_return").alias("benchmark_return"))
    out = monthly.join(F.broadcast(bench), "next_date").join(F.broadcast(place), "date").where((F.col("i") >= warm_up) & F.col("portfolio_return").isNotNull())
    excess = F.col("portfolio_return") - F.col("benchmark_return")
    return out.select("date", "next_date", "n_held", "portfolio_return", "benchmark_return", excess.alias("excess_return"), (excess > 0).cast("int").alias("hit"))


def compound(r: Column) -> Column:
    return F.product(1 + r) - 1


def growth(sim: DataFrame) -> DataFrame:
    """Growth of one unit in the portfolio and the benchmark, and its drawdown."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = sim.select("date", F.product(1 + F.col("portfolio_return")).over(w).alias("portfolio"), F.product(1 + F.col("benchmark_return")).over(w).alias("benchmark"))
    return grown.withColumns({"ratio": F.col("portfolio") / F.col("benchmark"), "drawdown": F.col("portfolio") / F.max("portfolio").over(w) - 1})


def metrics(sim: DataFrame) -> DataFrame:
    """One row: returns, volatilities, ratios, worst drawdown and hit rate."""
    n, p, b = F.count("portfolio_return"), F.col("portfolio_return"), F.col("benchmark_return")
    yearly = lambda r: F.pow(F.product(1 + r), 12.0 / n) - 1
    vol = lambda r: F.stddev_samp(r) * F.sqrt(F.lit(12.0))
    worst = growth(sim).agg(F.min("drawdown").alias("max_drawdown"))
    one = sim.agg(
        n.alias("n_months"),
        compound(p).alias("total_return"),
        compound(b).alias("benchmark_total_return"),
        yearly(p).alias("annual_return"),
        yearly(b).alias("benchmark_annual_return"),
        vol(p).alias("volatility"),
        vol(F.when(p < 0, p)).alias("downside_volatility"),
        yearly(F.col("excess_return")).alias("annual_excess"),
        vol(F.col("excess_return")).alias("tracking_error"),
        F.avg((p > b).cast("double")).alias("hit_rate"),
    )
    ratios = {"sharpe": F.try_divide("annual_return", "volatility"), "sortino": F.try_divide("annual_return", "downside_volatility"), "information_ratio": F.try_divide("annual_excess", "tracking_error")}
    return one.crossJoin(F.broadcast(worst)).withColumns({**ratios, "calmar": F.try_divide(F.col("annual_return"), F.abs("max_drawdown"))})  # one row each


def rolling(sim: DataFrame, months: int = 12) -> DataFrame:
    """Sharpe ratio and hit rate of full windows."""
    w = Window.orderBy("date").rowsBetween(-(months - 1), 0)
    full, p = F.count("*").over(w) == months, F.col("portfolio_return")
    sharpe = F.try_divide(F.pow(F.product(1 + p).over(w), F.lit(12.0 / months)) - 1, F.stddev_samp(p).over(w) * F.sqrt(F.lit(12.0)))
    hits = F.avg(F.coalesce((p > F.col("benchmark_return")).cast("double"), F.lit(0.0))).over(w)
    return sim.select("date", F.when(full, sharpe).alias("rolling_sharpe"), F.when(full, hits).alias("rolling_hit_rate"))


def by_year(sim: DataFrame) -> DataFrame:
    year = sim.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n_months"), compound(F.col("portfolio_return")).alias("portfolio"), compound(F.col("benchmark_return")).alias("benchmark"), F.sum("hit").alias("hits"))
    w = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return year.withColumns({"value_of_1000": 1000 * F.product(1 + F.col("portfolio")).over(w), "partial": F.col("n_months") < 10})


def by_sector(picks: DataFrame, prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    dated = next_period(picks.withColumnRenamed("feature_date", "date"), benchmark.select("date").distinct(), "date")
    earned = dated.join(prices.select("ticker", F.col("date").alias("next_date"), F.col("monthly_return").alias("r")), ["ticker", "next_date"])
    excess = earned.join(F.broadcast(benchmark.select(F.col("date").alias("next_date"), F.col("monthly_return").alias("b"))), "next_date").where("r is not null and b is not null")
    return excess.groupBy("sector").agg(F.count("*").alias("n_picks"), F.avg("r").alias("mean_return"), F.avg((F.col("r") > F.col("b")).cast("double")).alias("hit_rate"))


def picks_history(picks: DataFrame) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "ticker"))), lambda x: x["ticker"])
    return picks.groupBy("feature_date").agg(F.array_join(ordered, ", ").alias("tickers"))


def walk_forward(dates: DataFrame, least: int, step: int = 1, window: int | None = None) -> DataFrame:
    """Train dates of each test date, expanding or over a window of dates."""
    placed = dates.select("feature_date", (F.row_number().over(Window.orderBy("feature_date")) - 1).alias("i"))
    test = placed.select(F.col("feature_date").alias("test_date"), F.col("i").alias("j")).where((F.col("j") >= least) & ((F.col("j") - least) % step == 0))
    on = (F.col("i") < F.col("j")) if window is None else (F.col("i") < F.col("j")) & (F.col("i") >= F.col("j") - window)
    return placed.join(F.broadcast(test), on).groupBy("test_date").agg(F.count("*").alias("n_train"), F.min("feature_date").alias("first_train"), F.max("feature_date").alias("last_train"))


def realized(snapshots: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions beside what came: returns to 8 digits, correctness, error, bucket."""
    rows = snapshots.join(labels.where("winner is not null"), ["feature_date", "ticker"])
    stock, bench = F.bround("stock_return", 8), F.bround("benchmark_return", 8)
    made = rows.withColumns({"actual": stock - bench, "bucket": probability_bucket(F.col("probability"))})
    won, said = (F.col("actual") > 0).cast("int"), (F.col("probability") >= 0.5).cast("int")
    return made.withColumns({"winner_actual": won, "winner_predicted": said, "correct": (won == said).cast("int"), "return_error": F.col("predicted_excess") - F.col("actual")})


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    agg = [F.count("*").alias("n"), F.sum("correct").alias("n_correct"), F.avg("correct").alias("hit_rate"), F.avg("actual").alias("mean_actual"), F.avg("probability").alias("mean_probability"), F.avg("return_error").alias("mean_error")]
    return rows.groupBy(*by).agg(*agg) if by else rows.agg(*agg)


def rolling_hit_rate(rows: DataFrame, months: int = 6) -> DataFrame:
    monthly = rows.groupBy("feature_date").agg(F.avg("correct").alias("monthly"))
    return monthly.select("feature_date", "monthly", F.avg("monthly").over(Window.orderBy("feature_date").rowsBetween(-(months - 1), 0)).alias("rolling"))
