"""What fitted models give: penalised fits, rolling fits, tables, predictions, snapshots."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import features as made
from . import models, scoring

#: The least number of rows that models are fitted on, and the labels of two signs.
LEAST_ROWS = 50
ZEROED, POSITIVE, NEGATIVE, APART = "Lasso zeroed", "Both positive", "Both negative", "Sign disagree"
PENALTIES = [10 ** (-4 + 6 * k / 49) for k in range(50)]
PATH = [10 ** (-3 + 4 * k / 39) for k in range(40)]
NORMAL_95 = 1.959963984540054


# --- penalised fits


def row_folds(df: DataFrame, folds: int = 5, date: str = "feature_date", key: str = "ticker") -> DataFrame:
    """Adds fold: rows by (date, key) in ``folds`` equal blocks at the end (1, 2, ...) and the rest before them (0)."""
    counts = df.groupBy(date).agg(F.count("*").alias("_n"))
    # A row a date: the only window without a partition.
    before = counts.select(date, (F.sum("_n").over(Window.orderBy(date)) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    placed = df.join(F.broadcast(before), date).withColumn("_nth", F.col("_before") + F.row_number().over(Window.partitionBy(date).orderBy(key)) - 1)
    block = F.floor(F.col("_all") / (folds + 1))
    ahead = F.col("_nth") - (F.col("_all") - folds * block)
    return placed.withColumn("fold", F.when(ahead < 0, 0).otherwise(F.floor(F.try_divide(ahead, block)) + 1).cast("int")).drop("_before", "_all", "_nth")


def _rescaled(matrix: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """The Gram matrix of (1, (x - mean) / sd, y)."""
    t = np.diag([1.0, *(1 / sd), 1.0])
    t[1:-1, 0] = -mean / sd
    return t @ matrix @ t.T


def _centred(matrix: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float]:
    n = matrix[0, 0]
    mean = matrix[0, 1:] / n
    cross = matrix[1:, 1:] - n * np.outer(mean, mean)
    return n, mean[:-1], cross[:-1, :-1], cross[:-1, -1], mean[-1]


def ridge(matrix: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, coefficients...) of features as they are; the intercept is not penalised."""
    _, mean, xx, xy, my = _centred(matrix)
    b = np.linalg.solve(xx + alpha * np.eye(len(xy)), xy)
    return np.append(my - mean @ b, b)


def lasso(matrix: np.ndarray, alpha: float, rounds: int = 2000) -> np.ndarray:
    """The same for (1 / 2n) squared loss and ``alpha`` times the sum of absolute coefficients."""
    n, mean, xx, xy, my = _centred(matrix)
    b = np.zeros(len(xy))
    for _ in range(rounds):
        before = b.copy()
        for j in np.flatnonzero(np.diag(xx) > 0):
            rho = xy[j] - xx[j] @ b + xx[j, j] * b[j]
            b[j] = math.copysign(max(abs(rho) - alpha * n, 0.0), rho) / xx[j, j]
        if np.abs(b - before).max() < 1e-10:
            break
    return np.append(my - mean @ b, b)


def r_squared(matrix: np.ndarray, w: np.ndarray) -> float:
    spread = matrix[-1, -1] - matrix[0, -1] ** 2 / matrix[0, 0]
    return 1 - models.squared_error(matrix, w) / spread if spread > 0 else 0.0


def minus_mean_error(matrix: np.ndarray, w: np.ndarray) -> float:
    return -models.squared_error(matrix, w) / matrix[0, 0]


def penalised(df: DataFrame, features: list[str], label: str, fit, score, penalties: list[float], folds: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Best penalty by the mean score over forward-chained folds of rows, and the refit on all rows.

    Features are standardised by all complete rows. One aggregation gives every fold's
    matrix; the grid is solved on sums of matrices. Returns the penalty, the weights on
    the features' own scale and those on the standardised one. Of equal scores the first
    penalty counts. No complete row gives weights of 0.
    """
    by_fold = {k[0]: m for k, m in models.gram(row_folds(df.na.drop(subset=[*features, label]), folds), [*features, label], "fold")}
    if not by_fold:
        return penalties[0], np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    total = sum(by_fold.values())
    n, mean = total[0, 0], total[0, 1:-1] / total[0, 0]
    variance = np.diag(total)[1:-1] / n - mean**2
    sd = np.where(variance > 1e-300, np.sqrt(np.maximum(variance, 1e-300)), 1.0)
    scaled = {f: _rescaled(m, mean, sd) for f, m in by_fold.items()}
    order = sorted(scaled)
    tests = [(sum(scaled[g] for g in order if g < f), scaled[f]) for f in order[1:]]
    quality = [np.mean([score(test, fit(train, a)) for train, test in tests]) for a in penalties] if tests else [0.0]
    best = penalties[int(np.argmax(quality))]
    w = fit(sum(scaled.values()), best)
    own = w[1:] / sd
    return best, np.append(w[0] - mean @ own, own), w


def ridge_of(df: DataFrame, features: list[str], label: str = "excess_return") -> tuple[float, np.ndarray, np.ndarray]:
    return penalised(df, features, label, ridge, r_squared, PENALTIES)


def lasso_of(df: DataFrame, features: list[str], label: str = "excess_return") -> tuple[float, np.ndarray, np.ndarray]:
    """Of equal errors the largest penalty counts."""
    return penalised(df, features, label, lasso, minus_mean_error, PENALTIES[::-1])


def lasso_path(df: DataFrame, features: list[str], label: str = "excess_return", penalties: list[float] = PATH) -> list[tuple[float, str, float]]:
    """(penalty, feature, coefficient of the standardised feature) over all complete rows."""
    matrix = models.gram(df, [*features, label])[0][1]
    if not matrix[0, 0]:
        return []
    n, mean = matrix[0, 0], matrix[0, 1:-1] / matrix[0, 0]
    variance = np.diag(matrix)[1:-1] / n - mean**2
    scaled = _rescaled(matrix, mean, np.where(variance > 1e-300, np.sqrt(np.maximum(variance, 1e-300)), 1.0))
    return [(a, name, float(b)) for a in penalties for name, b in zip(features, lasso(scaled, a)[1:], strict=True)]


def compared(ridge_table: DataFrame, lasso_table: DataFrame) -> DataFrame:
    """Both models' coefficients side by side; a feature that one of them lacks stays, with 0 for the lasso's."""
    r, c = F.col("ridge_coef"), F.col("lasso_coef")
    both = ridge_table.select("feature", F.col("coefficient").alias("ridge_coef")).join(lasso_table.select("feature", F.col("coefficient").alias("lasso_coef"), "selected"), "feature", "full").na.fill({"lasso_coef": 0.0, "selected": False})
    return both.withColumn("agreement", F.when(c == 0, ZEROED).when((r > 0) & (c > 0), POSITIVE).when((r < 0) & (c < 0), NEGATIVE).otherwise(APART))


def model_comparison(df: DataFrame, features: list[str], label: str = "excess_return", share: float = 0.7, date: str = "feature_date") -> tuple[list[tuple], list[tuple]]:
    """OLS, ridge and lasso fitted on the first share of the dates and measured on both parts, from two matrices.

    Returns (model, penalty, n_train, n_test, r2_train, r2_test, rmse_train, rmse_test, gap,
    n_used) of each model, gap being the R² lost on the later dates, and (feature, ridge
    weight, lasso weight) on standardised features.
    """
    rows = models.time_split(df.na.drop(subset=[*features, label]), share, date)
    parts = {k[0]: m for k, m in models.gram(rows, [*features, label], "is_train")}
    if True not in parts or False not in parts:
        return [], []
    train, test = parts[True], parts[False]
    earlier = rows.where("is_train")
    found = {"ols": (None, models.inverse(train[:-1, :-1]) @ train[:-1, -1], None), "ridge": ridge_of(earlier, features, label), "lasso": lasso_of(earlier, features, label)}
    table = []
    for name, (alpha, w, standard) in found.items():
        r2 = [r_squared(m, w) for m in (train, test)]
        rmse = [math.sqrt(max(models.squared_error(m, w), 0.0) / m[0, 0]) for m in (train, test)]
        table.append((name, alpha, int(train[0, 0]), int(test[0, 0]), *map(float, r2), *rmse, float(r2[0] - r2[1]), int(np.count_nonzero(w[1:] if standard is None else standard[1:]))))
    return table, [(f, float(r), float(c)) for f, r, c in zip(features, found["ridge"][2][1:], found["lasso"][2][1:], strict=True)]


# --- fits by date


def actual_vs_predicted(df: DataFrame, features: list[str], label: str = "excess_return", keep: tuple[str, ...] = ("feature_date", "ticker")) -> DataFrame:
    """Actual value, full-sample fit and residual of every complete row."""
    rows = df.na.drop(subset=[*features, label])
    matrix = models.gram(rows, [*features, label])[0][1]  # all 0 without rows
    w = models.inverse(matrix[:-1, :-1]) @ matrix[:-1, -1]
    predicted = models.linear(features, w)
    return rows.select(*keep, F.col(label).alias("actual"), predicted.alias("predicted"), (F.col(label) - predicted).alias("residual"))


def rolling_r_squared(df: DataFrame, features: list[str], label: str = "excess_return", dates: int = 36, date: str = "feature_date") -> list[tuple]:
    """(date, rows, R², adjusted R²) over the ``dates`` dates before each date, with at least ten rows more than features.

    One matrix a date reaches the driver; a window is a sum of matrices.
    """
    by_date = sorted(((k[0], m) for k, m in models.gram(df, [*features, label], date)), key=lambda x: x[0])
    out = []
    for at in range(dates, len(by_date)):
        m = sum(x for _, x in by_date[at - dates : at])
        if m[0, 0] >= len(features) + 10:
            fit = models.ols(m, features)
            out.append((by_date[at][0], int(m[0, 0]), float(fit["r2"]), float(fit["adj_r2"])))
    return out


def logit_table(df: DataFrame, features: list[str], label: str = "winner", rounds: int = 50) -> tuple[list[tuple], dict]:
    """Unpenalised logistic regression: (term, coefficient, std_error, z, p_value, low, high, odds_ratio) and the fit's figures.

    Each step is one pass over complete rows; without rows of both labels there is no fit. Figures: n, log_likelihood,
    null_log_likelihood, pseudo_r2, aic, bic, converged.
    """
    from . import newton  # which builds on this module

    rows = df.na.drop(subset=[*features, label]).select(F.lit(0).alias("_all"), *features, label)
    fit = newton.fits(rows, features, label, [(0, 0)], "_all", None, rounds)[0]
    if fit is None:
        return [], {"n": 0, "converged": False}
    n, k, converged = fit.n, len(features) + 1, fit.converged
    back = np.diag([1.0, *(1 / fit.sd)])
    back[0, 1:] = -fit.mean / fit.sd
    b, covariance = back @ fit.weights, back @ np.linalg.pinv(fit.hessian) @ back.T
    se = np.sqrt(np.maximum(np.diag(covariance), 0.0))
    share, ll = float(rows.agg(F.avg(label)).first()[0]), fit.log_likelihood
    null = float(n * sum(q * math.log(q) for q in (share, 1 - share) if q > 0))
    table = []
    for term, v, s in zip(["intercept", *features], b.tolist(), se.tolist(), strict=True):
        z = v / s if s > 0 else 0.0
        table.append((term, v, s, z, math.erfc(abs(z) / math.sqrt(2)), v - NORMAL_95 * s, v + NORMAL_95 * s, math.exp(min(v, 700.0))))
    return table, {"n": int(n), "log_likelihood": ll, "null_log_likelihood": null, "pseudo_r2": 1 - ll / null if null else 0.0, "aic": 2 * k - 2 * ll, "bic": k * math.log(n) - 2 * ll, "converged": converged}


# --- scoring with models, snapshots


def filled(panel: DataFrame, train: DataFrame, features: list[str]) -> DataFrame:
    """Missing features as the mean of the training rows, else 0."""
    means = train.agg(*[F.avg(c).alias(c) for c in features]).first()
    return panel.withColumns({c: F.coalesce(F.col(c), F.lit(means[c]).cast("double"), F.lit(0.0)) for c in features})


def with_predictions(panel: DataFrame, train: DataFrame, features: list[str]) -> tuple[DataFrame, dict]:
    """probability, ridge and lasso prediction of every row of ``panel``, by models fitted on ``train``; what to score with.

    With fewer than ``LEAST_ROWS`` complete training rows nothing is fitted or added.
    """
    complete = train.na.drop(subset=[*features, "excess_return", "winner"])
    if complete.limit(LEAST_ROWS).count() < LEAST_ROWS:
        return panel, {}
    logit = models.logistic(complete, features, "winner")
    weights = {"ridge_prediction": ridge_of(complete, features)[1], "lasso_prediction": lasso_of(complete, features)[1]}
    x = filled(panel.select("feature_date", "ticker", *features), complete, features)
    shown = {"probability": 1 / (1 + F.exp(-models.linear(features, logit))), **{c: models.linear(features, w) for c, w in weights.items()}}
    predicted = x.select("feature_date", "ticker", *[v.alias(c) for c, v in shown.items()])
    return panel.join(predicted, ["feature_date", "ticker"]), {"probability": "probability", "excess": "ridge_prediction", "votes": ("probability", *weights)}


def scored_by_models(panel: DataFrame, train: DataFrame, features: list[str]) -> DataFrame:
    """Scores, class and label of every row; without enough training rows the models count as 50."""
    rows, used = with_predictions(panel, train, features)
    for c in ("probability", "ridge_prediction", "lasso_prediction"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("double"))
    s = scoring.scores(rows, **used)
    return s.withColumns({"class": scoring.classify(*[F.col(c) for c in ("probability", "ridge_prediction", "agreement_score", "data_quality_score")]), "label": scoring.label_of_score(F.col("final_score"))})


def _json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def snapshot_records(scored: DataFrame, features: list[str], version: str) -> DataFrame:
    """Scored rows frozen as records: features and standardised features as JSON (nulls left out), scores, class and warnings."""
    standard = made.standardize(scored.select("feature_date", "ticker", *features), features)
    frozen = standard.select("feature_date", "ticker", _json(features).alias("standardized_json"))
    kept = [c for c in scored.columns if c not in features and c not in ("feature_date", "ticker")]
    texts = scoring.warnings(*[F.col(c) for c in ("data_quality_score", "probability", "agreement_score", "risk_score")])
    return scored.select("feature_date", "ticker", *kept, _json(features).alias("features_json"), texts.alias("warnings"), F.lit(version).alias("model_version")).join(frozen, ["feature_date", "ticker"])


def backfilled(panel: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of entities that ``stored`` lacks, on its dates, relative to the whole cross-section of those dates."""
    dates = stored.select("feature_date").distinct()  # a row a month
    whole = made.sector_relative(panel.join(F.broadcast(dates), "feature_date", "left_semi"))
    return whole.join(stored.select("ticker").distinct(), "ticker", "left_anti")
