"""A word for each feature's value: an interval lookup in a table of ordered bounds.

One row a feature (bounds in the order of the rules, one label more than bounds); a value's
place among the bounds is its label, which is what the first matching rule would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NONE = "—"
ABOVE, BELOW = "above", "below"
_GAIN, _NEG, _MIXED = "✅ Positive", "🔴 Negative", "⚠️ Moderate"

#: Per feature the side that a bound opens to, the bounds, and the labels (the last one for the rest).
RULES: dict[str, tuple[str, tuple[float, ...], tuple[str, ...]]] = {
    "return_1m": (ABOVE, (0.08, 0.0), ("✅ Strong momentum", _GAIN, _NEG)),
    "return_3m": (ABOVE, (0.12, 0.0), ("✅ Strong", _GAIN, _NEG)),
    "six_month_momentum": (ABOVE, (0.10, 0.0), ("✅ Strong", _GAIN, _NEG)),
    "twelve_month_momentum": (ABOVE, (0.15, 0.0), ("✅ Strong", _GAIN, _NEG)),
    "five_year_price_gain": (ABOVE, (0.5, 0.0), ("✅ Strong", _GAIN, "🔴 Declined over 5yr")),
    "five_year_revenue_growth": (ABOVE, (0.10, 0.02, -0.02), ("✅ Strong", _GAIN, "⚠️ Slow growth", "🔴 Revenue declining")),
    "five_year_eps_growth": (ABOVE, (0.10, 0.02, -0.02), ("✅ Strong", _GAIN, "⚠️ Weak growth", "🔴 Earnings declining")),
    "eps_growth_acceleration": (ABOVE, (0.02, -0.02), ("✅ Accelerating EPS growth", "⚠️ Stable", "🔴 Decelerating earnings")),
    "revenue_growth_acceleration": (ABOVE, (0.02, -0.02), ("✅ Accelerating revenue", "⚠️ Stable", "🔴 Decelerating revenue")),
    "roe": (ABOVE, (0.20, 0.10, 0.0), ("✅ Excellent", "✅ Good", "⚠️ Low", "🔴 Negative ROE")),
    "roic": (ABOVE, (0.15, 0.08, 0.0), ("✅ Excellent", "✅ Good", "⚠️ Low", "🔴 Negative ROA")),
    "gross_margin": (ABOVE, (0.40, 0.20), ("✅ High", "✅ Solid", "⚠️ Thin margins")),
    "operating_margin": (ABOVE, (0.15, 0.05, 0.0), ("✅ High", _GAIN, "⚠️ Low", "🔴 Operating loss")),
    "free_cash_flow_yield": (ABOVE, (0.05, 0.01, 0.0), ("✅ High yield", _GAIN, "⚠️ Thin", "🔴 Negative FCF")),
    "dividend_yield": (ABOVE, (0.03, 0.005), ("✅ Solid yield", "⚠️ Low yield", "— Growth stock (no div.)")),
    "current_pe_ratio": (BELOW, (15.0, 30.0, 50.0), ("✅ Low P/E", "⚠️ Moderate P/E", "⚠️ Elevated P/E", "🔴 Very high P/E")),
    "price_to_book": (BELOW, (2.0, 5.0), ("✅ Low P/B", _MIXED, "🔴 Expensive vs assets")),
    "price_to_sales": (BELOW, (2.0, 8.0), ("✅ Low P/S", _MIXED, "🔴 Very expensive vs sales")),
    "pe_vs_historical_median": (BELOW, (-0.05, 0.10), ("✅ Below own median", "⚠️ Near median", "🔴 Premium to own history")),
    "sector_relative_pe": (BELOW, (-0.05, 0.10), ("✅ Cheaper than sector", "⚠️ Near sector average", "🔴 Premium to sector")),
    "sector_relative_momentum": (ABOVE, (0.05, -0.05), ("✅ Outperforming sector", "⚠️ In line with sector", "🔴 Underperforming sector")),
    "peer_valuation_zscore": (BELOW, (-0.5, 0.5), ("✅ Cheap vs peers", "⚠️ Fairly valued", "🔴 Expensive vs peers")),
    "peer_momentum_zscore": (ABOVE, (0.5, -0.5), ("✅ Outpacing peers", "⚠️ In line with peers", "🔴 Lagging peers")),
    "beta": (BELOW, (0.8, 1.2), ("✅ Defensive (β<0.8)", "⚠️ Market-like", "🔴 High β — amplified risk")),
    "volatility_3m": (BELOW, (0.18, 0.30), ("✅ Low risk", "⚠️ Moderate risk", "🔴 High volatility")),
    "volatility_12m": (BELOW, (0.18, 0.30), ("✅ Low risk", "⚠️ Moderate risk", "🔴 High volatility")),
    "downside_volatility_12m": (BELOW, (0.025, 0.05), ("✅ Low downside risk", _MIXED, "🔴 High downside risk")),
    "drawdown_from_52w_high": (ABOVE, (-0.05, -0.20), ("✅ Near 52w high", "⚠️ Moderate pullback", "🔴 Deep drawdown")),
    "debt_to_equity": (BELOW, (0.3, 1.0), ("✅ Low debt", "⚠️ Moderate debt", "🔴 High leverage")),
    "abnormal_volume": (ABOVE, (1.8, 0.5), ("⚠️ Unusually high volume", "✅ Normal volume", "⚠️ Unusually low volume")),
}


def rule_table(spark: SparkSession, rules: dict = RULES) -> DataFrame:
    rows = [(f, side == ABOVE, list(bounds), list(labels)) for f, (side, bounds, labels) in rules.items()]
    return spark.createDataFrame(rows, "feature string, above boolean, bounds array<double>, labels array<string>")


def signalled(long: DataFrame, rules: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """``long`` with ``signal``; a feature without a rule and a value that is no number get a dash."""
    v = F.col(value)
    passed: Column = F.size(F.filter("bounds", lambda b: F.when(F.col("above"), b >= v).otherwise(b <= v)))
    number = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    found = long.join(F.broadcast(rules.withColumnRenamed("feature", "_feature")), F.col(feature) == F.col("_feature"), "left")  # a row a feature
    return found.withColumn("signal", F.coalesce(F.when(number, F.get("labels", passed)), F.lit(NONE))).select(*long.columns, "signal")
