"""Point-in-time features: price windows by row, reported figures as known, cross-sections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cagr, clip_pe, safe_divide
from .asof import backward, known_at_reports, spine

PRICE_FEATURES = ("six_month_momentum", "twelve_month_momentum", "return_1m", "return_3m", "five_year_price_gain", "volatility_12m", "volatility_3m", "downside_volatility_12m", "drawdown_from_52w_high", "abnormal_volume", "beta")

#: Points a missing feature costs.
QUALITY_DEDUCTIONS = {
    "current_pe_ratio": 12,
    "five_year_eps_growth": 10,
    "five_year_revenue_growth": 8,
    "five_year_price_gain": 8,
    "twelve_month_momentum": 6,
    "six_month_momentum": 5,
    "volatility_12m": 5,
    "roe": 5,
    "debt_to_equity": 4,
    "free_cash_flow_yield": 4,
    "gross_margin": 3,
    "operating_margin": 3,
    "pe_vs_historical_median": 3,
    "dividend_yield": 3,
    "roic": 3,
    "price_to_book": 3,
    "price_to_sales": 3,
    "revenue_growth_acceleration": 2,
    "eps_growth_acceleration": 2,
    "return_1m": 1,
    "return_3m": 1,
    "drawdown_from_52w_high": 2,
    "volatility_3m": 2,
    "downside_volatility_12m": 2,
    "abnormal_volume": 2,
}


def price_features(prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The window features of every price row; windows count rows, not calendar months."""
    w = Window.partitionBy("ticker").orderBy("date")
    p, n, r = F.col("adjusted_close"), F.row_number().over(w), F.col("monthly_return")
    back = lambda k: F.lag("adjusted_close", k).over(w)
    last = lambda k: w.rowsBetween(-(k - 1), 0)
    year = math.sqrt(12)
    volatility = lambda k: F.when((n >= k + 1) & (F.count(r).over(last(k)) >= 3), F.stddev_samp(r).over(last(k)) * year)
    loss = F.when(r < 0, r)
    high = F.max(p).over(last(13))
    usual = F.avg("volume").over(w.rowsBetween(-12, -1))
    rows = prices.select(
        "ticker",
        "date",
        p,
        "volume",
        r,
        (safe_divide(back(1), back(7)) - 1).alias("six_month_momentum"),
        (safe_divide(back(1), back(13)) - 1).alias("twelve_month_momentum"),
        (safe_divide(p, back(1)) - 1).alias("return_1m"),
        (safe_divide(p, back(3)) - 1).alias("return_3m"),
        (safe_divide(p, back(60)) - 1).alias("five_year_price_gain"),
        volatility(12).alias("volatility_12m"),
        volatility(3).alias("volatility_3m"),
        F.when((n >= 13) & (F.count(loss).over(last(12)) >= 3), F.stddev_samp(loss).over(last(12)) * year).alias("downside_volatility_12m"),
        F.when((n >= 13) & (high > 0), (p - high) / high).alias("drawdown_from_52w_high"),
        F.when((n >= 13) & (usual > 0), F.col("volume") / usual).alias("abnormal_volume"),
    )
    return backward(rows, betas(prices, benchmark).withColumnRenamed("date", "beta_date"), "ticker", "date", "beta_date").drop("beta_date")


def betas(prices: DataFrame, benchmark: DataFrame, rows: int = 24, least: int = 12) -> DataFrame:
    """Slope of returns on the benchmark's over the last common dates."""
    market = F.broadcast(benchmark.select("date", F.col("monthly_return").alias("market")))  # a row a month
    common = prices.select("ticker", "date", "monthly_return").join(market, "date")
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(rows - 1), 0)
    both = F.col("monthly_return").isNotNull() & F.col("market").isNotNull()
    y, x = F.when(both, F.col("monthly_return")), F.when(both, F.col("market"))
    enough = (F.count("*").over(w) >= least) & (F.count(y).over(w) >= least)
    return common.select("ticker", "date", F.when(enough & (F.var_samp(x).over(w) != 0), F.covar_samp(y, x).over(w) / F.var_samp(x).over(w)).alias("beta"))


def report_features(reports: DataFrame) -> DataFrame:
    """From each report date on: trailing sums, latest ratios, growth accelerations."""
    known = known_at_reports(reports, "ticker", REPORT_ROWS)
    q = lambda i: F.get("q", F.lit(i))
    trailing = lambda name: F.when(F.size(F.filter(F.slice("q", 1, 4), lambda x: x[name].isNotNull())) == 4, F.aggregate(F.slice("q", 1, 4), F.lit(0.0), lambda a, x: a + x[name]))
    eps_growth = lambda i: safe_divide(q(i)["eps"] - q(i + 4)["eps"], F.abs(q(i + 4)["eps"]))
    sales_growth = lambda i: F.when(q(i + 4)["revenue"] > 0, q(i)["revenue"] / q(i + 4)["revenue"] - 1)
    return known.select(
        "ticker",
        "known_from",
        "n_known",
        "last_report",
        "q",
        *[trailing(c).alias(f"ttm_{c}") for c in ("eps", "revenue", "net_income", "free_cash_flow")],
        *[q(0)[c].alias(c) for c in ("roe", "debt_to_equity", "operating_margin", "equity")],
        (eps_growth(0) - eps_growth(4)).alias("eps_growth_acceleration"),
        (sales_growth(0) - sales_growth(4)).alias("revenue_growth_acceleration"),
    )


def feature_panel(stocks: DataFrame, prices: DataFrame, benchmark: DataFrame, reports: DataFrame, carry: list[str] = (), dates: DataFrame | None = None) -> DataFrame:
    """Every entity at every month of the benchmark, or at each feature_date of ``dates``, with what was known then."""
    dates = benchmark.select(F.col("date").alias("feature_date")).distinct() if dates is None else dates.select("feature_date").distinct()
    base = spine(dates, stocks)
    priced = backward(base, price_features(prices, benchmark), "ticker", "feature_date", "date")
    known = backward(priced, report_features(reports), "ticker", "feature_date", "known_from")
    p, d = F.col("adjusted_close"), F.col("feature_date")
    low, high = F.add_months(d, -66), F.add_months(d, -54)
    then = F.filter("q", lambda x: x["fiscal_date"].between(low, high))
    then = F.slice(then, 1, 4)  # newest first
    old = lambda name: F.when((F.size(then) > 0) & (F.size(F.filter(then, lambda x: x[name].isNull())) == 0), F.aggregate(then, F.lit(0.0), lambda a, x: a + x[name]))
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.size("q") - 3, F.lit(1))), lambda i: F.aggregate(F.slice("q", i, 4), F.lit(0.0), lambda a, x: a + x["eps"]))
    ratios = F.slice(F.transform(F.filter(sums, lambda s: s > 0), lambda s: p / s), 1, 20)
    middle = F.array_sort(ratios)
    half = F.size(middle)
    median = (F.get(middle, F.floor((half - 1) / 2).cast("int")) + F.get(middle, F.floor(half / 2).cast("int"))) / 2
    pe = clip_pe(F.when(F.col("ttm_eps") > 0, p / F.col("ttm_eps")))
    cap = p * F.col("shares_outstanding_m")
    staleness = F.greatest(F.datediff(d, "last_report"), F.lit(0))
    return known.select(
        "feature_date",
        "ticker",
        "sector",
        "adjusted_close",
        *PRICE_FEATURES,
        pe.alias("current_pe_ratio"),
        F.when((F.col("n_known") >= 8) & (F.size(ratios) >= 4), pe / median - 1).alias("pe_vs_historical_median"),
        cagr(old("eps"), F.col("ttm_eps"), 5).alias("five_year_eps_growth"),
        cagr(old("revenue"), F.col("ttm_revenue"), 5).alias("five_year_revenue_growth"),
        "roe",
        "debt_to_equity",
        "operating_margin",
        cap.alias("market_cap"),
        safe_divide(F.col("ttm_free_cash_flow"), cap).alias("free_cash_flow_yield"),
        safe_divide(cap, F.col("ttm_revenue")).alias("price_to_sales"),
        safe_divide(cap, F.col("equity")).alias("price_to_book"),
        "eps_growth_acceleration",
        "revenue_growth_acceleration",
        staleness.alias("staleness_days"),
        *carry,
    )


def sector_relative(panel: DataFrame) -> DataFrame:
    """Adds features relative to the sector at the date; a median of 0 is a median."""
    w = Window.partitionBy("feature_date", "sector")
    median = lambda c: F.percentile(c, F.lit(0.5)).over(w)

    def ratio(c: str) -> Column:
        return F.when(median(c) > 0, F.col(c) / median(c) - 1)

    def zscore(c: str) -> Column:
        return F.when((F.count(c).over(w) >= 3) & (F.stddev_samp(c).over(w) > 0), (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w))

    return panel.withColumns(
        {
            "sector_relative_pe": ratio("current_pe_ratio"),
            "sector_relative_ps": ratio("price_to_sales"),
            "sector_relative_momentum": F.col("twelve_month_momentum") - median("twelve_month_momentum"),
            "sector_relative_fcf_yield": F.when(F.count("free_cash_flow_yield").over(w) >= 3, F.col("free_cash_flow_yield") - median("free_cash_flow_yield")),
            "peer_momentum_zscore": zscore("twelve_month_momentum"),
            "peer_valuation_zscore": zscore("current_pe_ratio"),
        }
    )


def winsorize(df: DataFrame, columns: list[str], by: str = "feature_date", low: float = 0.01, high: float = 0.99) -> DataFrame:
    w = Window.partitionBy(by)
    cut = lambda c: F.percentile(c, F.array(F.lit(low), F.lit(high))).over(w)
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), cut(c)[1]), cut(c)[0])) for c in columns})


def standardize(df: DataFrame, columns: list[str], by: str = "feature_date") -> DataFrame:
    w = Window.partitionBy(by)
    return df.withColumns({c: F.when(F.stddev_samp(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w)) for c in columns})


def minmax(df: DataFrame, columns: list[str], by: str = "feature_date") -> DataFrame:
    """Scaled to 0..1; a constant column is 0.5 on every row."""
    w = Window.partitionBy(by)
    spread = lambda c: F.max(c).over(w) - F.min(c).over(w)
    return df.withColumns({c: F.when(spread(c) == 0, 0.5).otherwise((F.col(c) - F.min(c).over(w)) / spread(c)) for c in columns})


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    long = df.unpivot([], columns, "feature", "value")
    q = lambda x: F.percentile("value", F.lit(x))
    return long.groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max("value").alias("high"), (F.count_if(F.col("value").isNull()) * 100.0 / F.count("*")).alias("pct_missing")
    )


def quality_score(panel: DataFrame) -> Column:
    """100 less the points of missing features and stale reports, at least 0."""
    missing = sum((F.when(F.col(c).isNull(), points).otherwise(0) if c in panel.columns else F.lit(points) for c, points in QUALITY_DEDUCTIONS.items()), F.lit(0))
    days = F.col("staleness_days")
    stale = F.when(days.isNull(), 20).when(days > 180, 10).when(days > 90, 5).otherwise(0)
    return F.greatest(100.0 - missing - stale, F.lit(0.0))


#: Rows that a later month's features can look back on: prices (61 and the one before, for its return), common dates for beta, reports.
PRICE_ROWS, COMMON_ROWS, REPORT_ROWS = 62, 24, 28


def price_tail(prices: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The price rows of each entity that features of later dates can need: its last ones, and its last dates in common with the benchmark."""
    market = F.broadcast(benchmark.select("date", F.lit(1).alias("_common")))  # a row a month
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    placed = prices.join(market, "date", "left").withColumns({"_n": F.row_number().over(w), "_k": F.count("_common").over(w)})
    return placed.where((F.col("_n") <= PRICE_ROWS) | (F.col("_common").isNotNull() & (F.col("_k") <= COMMON_ROWS))).select(*prices.columns)


def report_tail(reports: DataFrame) -> DataFrame:
    """The reports of each entity that features of later dates can need: its last ones by fiscal date, and the last to come out."""
    newest, latest = (Window.partitionBy("ticker").orderBy(F.col(c).desc()) for c in ("fiscal_date", "report_date"))
    placed = reports.withColumns({"_n": F.row_number().over(newest), "_k": F.row_number().over(latest)})
    return placed.where((F.col("_n") <= REPORT_ROWS) | (F.col("_k") == 1)).select(*reports.columns)


def missing_pairs(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys not computed yet."""
    return wanted.join(stored.select("feature_date", "ticker"), ["feature_date", "ticker"], "left_anti")
