"""Fitted models as a table, and what it gives without a fit: predictions of any rows.

A model table has a row for each (model, term): weights of the linear models, and under
``fill``, ``low`` and ``high`` the training mean and the training percentiles of each
feature. Its size depends on the number of features alone. To predict, features are cut
to the training percentiles, missing ones take the training mean (0 if there was none),
and each model is one expression; nothing of the training rows is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fitted, models
from .stats import long_form

#: The five variables of the one-variable fits, and the training percentiles of the cuts.
OLS = ("current_pe_ratio", "five_year_eps_growth", "five_year_revenue_growth", "five_year_price_gain", "twelve_month_momentum")
LOW, HIGH = 0.01, 0.99
FILL, BOTTOM, TOP = "fill", "low", "high"
LINEAR = ("ridge", "lasso")
SCHEMA = "model string, term string, weight double"


def fit(train: DataFrame, features: list[str], full: bool = True, ols: tuple[str, ...] = OLS, label: str = "excess_return", won: str = "winner", least: int = models.LEAST) -> DataFrame:
    """The table of all models fitted on ``train``; without ``full`` (or enough complete rows) of the one-variable fits only.

    Cuts and means take a feature's values where there is one; fits take complete rows. A
    one-variable fit is left out if its feature has fewer than ``least`` rows, or no line.
    """
    cut = lambda c: F.percentile(c, F.array(F.lit(LOW), F.lit(HIGH)))
    wide = train.agg(*[F.struct(F.avg(c).alias(FILL), cut(c)[0].alias(BOTTOM), cut(c)[1].alias(TOP)).alias(c) for c in features])
    figures = wide.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("term"), F.col(c)[m].alias("weight")) for c in features for m in (FILL, BOTTOM, TOP)])).alias("r")).select("r.*")
    single = models.simple_lines(long_form(train.select("feature_date", "ticker", label, *ols), list(ols)), least)
    lines = single.select(F.explode(F.array(F.struct(F.concat(F.lit("ols_"), "feature").alias("model"), F.lit("intercept").alias("term"), F.col("intercept").alias("weight")), F.struct(F.concat(F.lit("ols_"), "feature").alias("model"), F.col("feature").alias("term"), F.col("slope").alias("weight")))).alias("r")).select("r.*")
    table = figures.where("weight is not null").unionByName(lines)
    if not full:
        return table
    complete = train.na.drop(subset=[*features, label, won])
    if complete.limit(fitted.LEAST_ROWS).count() < fitted.LEAST_ROWS:
        return table
    found = {"ridge": fitted.ridge_of(complete, features, label)[1], "lasso": fitted.lasso_of(complete, features, label)[1], "logit": models.logistic(complete, features, won)}
    rows = [(m, t, float(v)) for m, w in found.items() for t, v in zip(["intercept", *features], w, strict=True)]
    return table.unionByName(train.sparkSession.createDataFrame(rows, SCHEMA))


def weights(table: DataFrame) -> dict[str, dict[str, float]]:
    """{model: {term: weight}}; a few hundred numbers."""
    out: dict[str, dict[str, float]] = {}
    for r in table.select("model", "term", "weight").collect():
        out.setdefault(r.model, {})[r.term] = r.weight
    return out


def predicted(rows: DataFrame, w: dict[str, dict[str, float]]) -> tuple[DataFrame, dict]:
    """``rows`` with a column for each model, ``weakest`` and ``predicted_excess``; and what scoring.scores takes.

    predicted_excess is the ridge's, without one the mean of the one-variable fits; weakest
    is the least of those fits. probability is null without a logistic model.
    """
    low, high, fill = (w.get(k, {}) for k in (BOTTOM, TOP, FILL))

    def x(c: str):
        cut = F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(high[c])), F.lit(low[c]))) if c in high else F.col(c)
        return F.coalesce(cut, F.lit(fill.get(c, 0.0)), F.lit(0.0))

    def linear(name: str):
        return sum((x(t) * F.lit(float(v)) for t, v in sorted(w[name].items()) if t != "intercept"), F.lit(float(w[name]["intercept"])))

    single = sorted(m for m in w if m.startswith("ols_"))
    several = [m for m in LINEAR if m in w]
    out = rows.withColumns({m: linear(m) for m in (*single, *several)})
    out = out.withColumn("probability", 1 / (1 + F.exp(-linear("logit"))) if "logit" in w else F.lit(None).cast("double"))
    mean = sum((F.col(m) for m in single), F.lit(0.0)) / len(single) if single else F.lit(None).cast("double")
    weakest = F.least(*single) if len(single) > 1 else F.col(single[0]) if single else F.lit(None).cast("double")
    out = out.withColumns({"weakest": weakest, "predicted_excess": F.col("ridge") if "ridge" in w else mean})
    votes = tuple(c for c in (*(("probability",) if "logit" in w else ()), *several)) or tuple(single)
    return out, {"probability": "probability" if "logit" in w else None, "excess": "predicted_excess" if single or several else None, "votes": votes}
