"""Scores, classes, flags and texts for each entity at a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, inverse_rank_score, rank_score, half_even

#: Component weights, thresholds, labels.
WEIGHTS = {"probability": 0.35, "excess": 0.25, "agreement": 0.15, "risk": 0.10, "data_quality": 0.10, "valuation": 0.05}
STRONG = (0.60, 0.05, 70.0, 75.0)
WATCHLIST = (0.50, 0.02, 55.0, 60.0)
WEAK = (0.40, -0.10, 40.0)
LABELS = ("Strong candidate", "Watchlist candidate", "Weak / avoid", "Neutral")
RISK = ("volatility_12m", "downside_volatility_12m", "beta")
VALUATION = ("sector_relative_pe", "pe_vs_historical_median", "current_pe_ratio")
MOMENTUM = ("twelve_month_momentum", "six_month_momentum", "return_3m")
FUNDAMENTAL = ("roe", "roic", "gross_margin", "operating_margin", "free_cash_flow_yield", "five_year_eps_growth", "five_year_revenue_growth")


def mean_of_ranks(names: tuple[str, ...], there: list[str], by: str, inverse: tuple[str, ...] = (), least: int = 3) -> Column:
    """Mean rank score of the columns with enough values at the date; 50 if none has."""
    w = Window.partitionBy(by)
    use = [c for c in (*names, *inverse) if c in there]
    usable = {c: F.count(c).over(w) >= least for c in use}
    score = {c: (inverse_rank_score if c in inverse else rank_score)(F.col(c), by) for c in use}
    n = sum((u.cast("int") for u in usable.values()), F.lit(0))
    total = sum((F.when(usable[c], score[c]).otherwise(0.0) for c in use), F.lit(0.0))
    return F.when(n > 0, total / n).otherwise(50.0)


def scores(panel: DataFrame, probability: str | None = None, excess: str | None = None, votes: tuple[str, ...] = (), by: str = "feature_date") -> DataFrame:
    """Adds the components and final_score (two digits). Absent models count as 50."""
    there = panel.columns
    p = F.coalesce(clamp(F.col(probability) * 100, 0.0, 100.0), F.lit(50.0)) if probability else F.lit(50.0)
    x = rank_score(F.col(excess), by) if excess else F.lit(50.0)
    rule = lambda c: F.coalesce((F.col(c) >= (0.5 if c == probability else 0.0)).cast("int"), F.lit(0))
    agree = sum((rule(c) for c in votes), F.lit(0)) * 100.0 / len(votes) if votes else F.lit(50.0)
    parts = {
        "probability_score": p,
        "excess_score": x,
        "agreement_score": agree,
        "risk_score": 100 - mean_of_ranks(RISK, there, by),
        "valuation_score": mean_of_ranks((), there, by, inverse=VALUATION),
        "momentum_score": mean_of_ranks(MOMENTUM, there, by),
        "fundamental_score": mean_of_ranks(FUNDAMENTAL, there, by, inverse=("debt_to_equity",)),
    }
    made = panel.withColumns(parts)
    weights = {"probability_score": "probability", "excess_score": "excess", "agreement_score": "agreement", "risk_score": "risk", "valuation_score": "valuation"}
    total = sum((F.col(c) * WEIGHTS[k] for c, k in weights.items()), F.coalesce("data_quality_score", F.lit(50.0)) * WEIGHTS["data_quality"])
    return made.withColumn("final_score", half_even(total, 2))


def classify(p: Column, x: Column, agree: Column, quality: Column) -> Column:
    """Strong, then watchlist, then weak, else neutral; missing inputs count as neutral ones."""
    p, x, agree, quality = F.coalesce(p, F.lit(0.5)), F.coalesce(x, F.lit(0.0)), F.coalesce(agree, F.lit(50.0)), F.coalesce(quality, F.lit(50.0))
    meets = lambda t: (p >= t[0]) & (x >= t[1]) & (agree >= t[2]) & (quality >= t[3])
    return F.when(meets(STRONG), LABELS[0]).when(meets(WATCHLIST), LABELS[1]).when((p <= WEAK[0]) | (x <= WEAK[1]) | (quality < WEAK[2]), LABELS[2]).otherwise(LABELS[3])


def label_of_score(score: Column) -> Column:
    return F.when(score >= 70, LABELS[0]).when(score >= 55, LABELS[1]).when(score < 35, LABELS[2]).otherwise(LABELS[3])


def agreement_flag(df: DataFrame, predictions: list[str], by: str = "feature_date", share: float = 0.30, quality: float = 60.0) -> DataFrame:
    """Flags the top share by the weakest of several predictions among rows of enough quality."""
    w = Window.partitionBy(by)
    n = F.greatest(F.lit(1), F.bround(F.count("*").over(w) * share).cast("int"))
    able = F.col("data_quality_score") >= quality
    weakest = F.least(*predictions) if len(predictions) > 1 else F.col(predictions[0])
    ranked = df.withColumn("_weakest", weakest)
    place = F.row_number().over(w.orderBy(F.when(able, F.col("_weakest")).desc_nulls_last(), "ticker"))
    return ranked.withColumn("flag", (able & F.col("_weakest").isNotNull() & (place <= n)).cast("int")).drop("_weakest")


def flag_by_models(p: Column, x: Column, agree: Column, quality: Column) -> Column:
    return ((p >= 0.5) & (x >= 0) & (agree >= 60) & (quality >= 60)).cast("int")


def warnings(quality: Column, p: Column, agree: Column, risk: Column) -> Column:
    """Messages for a row, as an array."""
    out_of_100 = lambda what, c: F.format_string(f"{what}: %.0f of 100", c)
    found = F.array(
        F.when(quality < 40, out_of_100("Most inputs are missing", quality)).when(quality < 60, out_of_100("Many inputs are missing", quality)),
        F.when(p.isNull(), "No model gave a probability; one half is assumed"),
        F.when(agree < 40, out_of_100("The models contradict one another", agree)),
        F.when(risk < 30, "Among the riskiest of its date"),
    )
    return F.filter(found, lambda m: m.isNotNull())


def draw(pool: DataFrame, month: str, n: int) -> DataFrame:
    """A sample of the pool fixed by the month: the n smallest digests."""
    return pool.withColumn("_d", F.md5(F.concat(F.lit(month), "ticker").cast("binary"))).orderBy("_d", "ticker").limit(n).drop("_d")


def draw_refilled(pool: DataFrame, able: DataFrame, month: str, n: int) -> DataFrame:
    """ticker, place in the month's order and whether it is a substitute: the first ``n`` of the order that are ``able``.

    One pass: what fails the check is left out before the smallest digests are taken, and a
    place beyond ``n`` says that it stands in for one that failed. Places are counted
    among digests up to the last one taken, not over a sort of the pool.
    """
    digest = F.md5(F.concat(F.lit(month), "ticker").cast("binary"))
    ordered = pool.select("ticker", digest.alias("_d"))
    taken = ordered.join(able.select("ticker").distinct(), "ticker", "left_semi").orderBy("_d", "ticker").limit(n)
    before = ordered.select(F.struct("_d", "ticker").alias("_o")).join(F.broadcast(taken.select("ticker", F.struct("_d", "ticker").alias("_t"))), F.col("_o") <= F.col("_t"))  # n rows
    return before.groupBy("ticker").agg(F.count("*").alias("place")).withColumn("substitute", F.col("place") > n)
