"""Linear and logistic models from sufficient statistics.

Rows never leave the cluster: a fit needs the sums of products of the columns (a matrix
of k + 2 rows), by fold or by month where a grid or a window asks for it. Only those
matrices, whose size depends on the number of features alone, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import student
from .stats import t_p_value


def time_split(df: DataFrame, share: float = 0.7, date: str = "feature_date") -> DataFrame:
    """Adds is_train: dates before the one at position int(n * share)."""
    dates = df.select(date).distinct()
    n = F.count("*").over(Window.partitionBy())
    placed = dates.withColumn("is_train", F.row_number().over(Window.orderBy(date)) - 1 < F.floor(n * share))
    return df.join(F.broadcast(placed), date)  # a row a date


#: The least number of rows that a one-variable fit is reported for, unless a caller says otherwise.
LEAST = 20


def simple_lines(long: DataFrame, least: int = LEAST) -> DataFrame:
    """feature, n, slope and intercept of y on x, where ``least`` rows (two at least) with different x settle a line."""
    made = long.groupBy("feature").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    return made.where((F.col("n") >= max(least, 2)) & F.col("slope").isNotNull())


def simple_regressions(long: DataFrame, least: int = LEAST) -> DataFrame:
    """One-variable OLS of y on x for each feature, in closed form, with t tests and 95% intervals."""
    agg = long.groupBy("feature").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"))
    n = F.col("n")
    residual = (1 - F.col("r2")) * F.col("syy") / (n - 2)
    out = agg.where(n >= least).withColumn("std_error", F.sqrt(residual / F.col("sxx")))
    t, half = F.try_divide("slope", "std_error"), student.t_quantile(0.05, n - 2) * F.col("std_error")
    return out.select(
        "feature",
        "n",
        student.t_p_value(t, n - 2).alias("p_value"),
        (F.col("slope") - half).alias("ci_low"),
        (F.col("slope") + half).alias("ci_high"),
        "slope",
        "intercept",
        "r2",
        "std_error",
        F.try_divide("slope", "std_error").alias("t_stat"),
        (1 - (1 - F.col("r2")) * (n - 1) / (n - 2)).alias("adj_r2"),
        F.try_divide(F.col("r2") * (n - 2), 1 - F.col("r2")).alias("f_stat"),
        (F.col("slope") * F.sqrt(F.col("sxx") / F.col("syy"))).alias("std_slope"),
    )


def held_out_r_squared(long: DataFrame, share: float = 0.7, least: tuple[int, int] = (20, 10)) -> DataFrame:
    """feature, r2_test: each fit on the first share of its own dates, measured on the rest; from sums by date."""
    x, y = F.col("x"), F.col("y")
    names = ("n", "sx", "sy", "sxx", "sxy", "syy")
    daily = long.groupBy("feature", "feature_date").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
    w = Window.partitionBy("feature")
    train = F.row_number().over(w.orderBy("feature_date")) - 1 < F.floor(F.count("*").over(w) * share)
    parts = daily.withColumn("_train", train).groupBy("feature").agg(*[F.sum(F.when(F.col("_train") == side, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k, side in ((0, True), (1, False)) for c in names])
    b = F.try_divide(F.col("n0") * F.col("sxy0") - F.col("sx0") * F.col("sy0"), F.col("n0") * F.col("sxx0") - F.col("sx0") * F.col("sx0"))
    a = (F.col("sy0") - F.col("b") * F.col("sx0")) / F.col("n0")
    made = parts.where((F.col("n0") >= least[0]) & (F.col("n1") >= least[1])).withColumn("b", b).withColumn("a", a)
    rss = F.expr("syy1 - 2 * a * sy1 - 2 * b * sxy1 + n1 * a * a + 2 * a * b * sx1 + b * b * sxx1")
    return made.select("feature", (1 - F.try_divide(rss, F.expr("syy1 - sy1 * sy1 / n1"))).alias("r2_test"))


def residuals(long: DataFrame, fits: DataFrame) -> DataFrame:
    fitted = F.col("intercept") + F.col("slope") * F.col("x")
    return long.join(F.broadcast(fits.select("feature", "slope", "intercept")), "feature").withColumns({"fitted": fitted, "residual": F.col("y") - fitted})


def residual_stats(rows: DataFrame) -> DataFrame:
    """Moments of the residuals; skew and excess kurtosis are corrected for bias."""
    n, g1, g2 = F.count("residual"), F.skewness("residual"), F.kurtosis("residual")
    return rows.groupBy("feature").agg(
        F.avg("residual").alias("mean"),
        F.stddev_samp("residual").alias("std"),
        F.min("residual").alias("low"),
        F.max("residual").alias("high"),
        (g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
        F.avg((F.col("residual") > 0).cast("double")).alias("pct_positive"),
    )


def rolling_slopes(long: DataFrame, dates: int = 36, least: int = 15) -> DataFrame:
    """Slope over the ``dates`` dates before each date, from sums by date."""
    x, y = F.col("x"), F.col("y")
    daily = long.groupBy("feature", "feature_date").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    w = Window.partitionBy("feature").orderBy("feature_date").rowsBetween(-dates, -1)
    sums = daily.select("feature", "feature_date", *[F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")], F.count("*").over(w).alias("n_dates"))
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    return sums.where((F.col("n_dates") == dates) & (F.col("n") >= least)).select("feature", "feature_date", "n", F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), spread).alias("slope"))


def apply_simple(panel: DataFrame, fits: DataFrame, features: list[str], by: str = "feature_date") -> DataFrame:
    """Predictions of each one-variable fit; a missing value counts as the month's median (else 0)."""
    w = Window.partitionBy(by)
    filled = panel.select(by, "ticker", *[F.coalesce(c, F.percentile(c, F.lit(0.5)).over(w), F.lit(0.0)).alias(c) for c in features])
    long = filled.unpivot([by, "ticker"], features, "feature", "x")
    return long.join(F.broadcast(fits.select("feature", "slope", "intercept")), "feature").select(by, "ticker", "feature", (F.col("intercept") + F.col("slope") * F.col("x")).alias("prediction"))


def moments(df: DataFrame, columns: list[str], *by: str) -> list[tuple[tuple, np.ndarray]]:
    """Sums of products of (1, columns...) over complete rows, one matrix for each group of ``by``.

    Tasks multiply their batches and hand on one matrix a group; those meet by group and
    place, so a wide matrix needs no wide aggregation.
    """
    complete = df.na.drop(subset=columns).select(*by, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    names, k = [f"_c{i}" for i in range(len(columns))], len(columns) + 1
    upper = np.triu_indices(k)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            z = np.column_stack([np.ones(len(batch)), batch[names].to_numpy(float)])
            groups = batch.groupby(list(by), sort=False).indices if by else {(): np.arange(len(batch))}
            for key, at in groups.items():
                key, m = key if isinstance(key, tuple) else (key,), (z[at].T @ z[at])[upper]
                total[key] = total[key] + m if key in total else m
        for key, m in total.items():
            yield pd.DataFrame({**{b: [v] * len(m) for b, v in zip(by, key, strict=True)}, "_place": np.arange(len(m)), "_value": m})

    kinds = "".join(f"`{b}` {complete.schema[b].dataType.simpleString()}, " for b in by)
    rows = complete.mapInPandas(sums, f"{kinds}_place int, _value double").groupBy(*by, "_place").agg(F.sum("_value").alias("_value")).collect()
    found: dict[tuple, np.ndarray] = {} if by else {(): np.zeros(len(upper[0]))}
    for r in rows:
        found.setdefault(tuple(r[b] for b in by), np.zeros(len(upper[0])))[r["_place"]] = r["_value"]
    out = []
    for key, v in found.items():
        m = np.zeros((k, k))
        m[upper] = v
        out.append((key, m + np.triu(m, 1).T))
    return out


gram = moments


def inverse(g: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of a matrix of sums of products, its columns scaled first, so that small figures beside large ones count."""
    d = np.sqrt(np.maximum(np.diag(g), 1e-300))
    return np.linalg.pinv(g / np.outer(d, d), rcond=1e-13, hermitian=True) / np.outer(d, d)


def ols(matrix: np.ndarray, names: list[str]) -> dict:
    """Multiple regression from a Gram matrix of (1, features..., label)."""
    n, xx, xy, yy = float(matrix[0, 0]), matrix[:-1, :-1], matrix[:-1, -1], matrix[-1, -1]
    inverted = inverse(xx)
    beta = inverted @ xy
    rss = max(yy - beta @ xy, 0.0)
    tss = yy - matrix[0, -1] ** 2 / n
    df = n - len(beta)
    se = np.sqrt(np.maximum(np.diag(inverted) * rss / df, 0))
    t = np.divide(beta, se, out=np.zeros_like(beta), where=se > 0)
    log_likelihood = -n / 2 * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / n) + 1)
    r2 = 1 - rss / tss if tss > 0 else 0.0
    rows = [(name, float(b), float(s), float(v), t_p_value(float(v), df)) for name, b, s, v in zip(["intercept", *names], beta, se, t, strict=True)]
    return {"coefficients": rows, "n": int(n), "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / df, "aic": 2 * len(beta) - 2 * log_likelihood, "bic": math.log(n) * len(beta) - 2 * log_likelihood}


def vif(matrix: np.ndarray, names: list[str]) -> list[tuple[str, float]]:
    """Variance inflation without intercept, from the Gram matrix of the features."""
    g = matrix[1 : 1 + len(names), 1 : 1 + len(names)]
    inverted = inverse(g)
    return [(name, float(g[i, i] * inverted[i, i])) for i, name in enumerate(names)]


def squared_error(matrix: np.ndarray, w: np.ndarray) -> float:
    full = np.append(w, -1.0)
    return float(full @ matrix @ full)


def linear(names: list[str], weights) -> Column:
    """intercept + sum of weight * feature; a missing feature adds nothing."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * float(w) for c, w in zip(names, weights[1:], strict=True)), F.lit(float(weights[0])))


def logistic(df: DataFrame, features: list[str], label: str, c: float = 1.0, rounds: int = 50) -> np.ndarray:
    """L2-penalised logistic regression: (intercept, weights...) on the features' own scale; 0 without rows of both labels."""
    from . import newton  # which builds on this module

    rows = df.na.drop(subset=[*features, label]).select(F.lit(0).alias("_all"), *features, label)
    fit = newton.fits(rows, features, label, [(0, 0)], "_all", c, rounds)[0]
    return np.zeros(len(features) + 1) if fit is None else fit.own_scale()


def running(at: DataFrame, value: str, columns: list[str], slices: int = 256) -> DataFrame:
    """Adds before_<c>, the sum of a column over smaller values, and total_<c>.

    Values are cut into slices of about equal numbers; each is sorted by itself and
    starts from the sum of those before it, so no task sorts all values.
    """
    cuts = at.agg(F.percentile_approx(value, [i / slices for i in range(1, slices)], 10_000).alias("_cuts"))
    sliced = at.crossJoin(F.broadcast(cuts)).withColumn("_slice", F.coalesce(F.size(F.filter("_cuts", lambda x: x < F.col(value))), F.lit(0))).drop("_cuts")  # one row of cuts
    sums = sliced.groupBy("_slice").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    w, everything = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # ``slices`` rows at most
    starts = sums.select("_slice", *[F.coalesce(F.sum(f"_s_{c}").over(w), F.lit(0)).alias(f"_b_{c}") for c in columns], *[F.sum(f"_s_{c}").over(everything).alias(f"total_{c}") for c in columns])
    within = Window.partitionBy("_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.join(F.broadcast(starts), "_slice")
    return placed.withColumns({f"before_{c}": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns}).drop("_slice", *[f"_b_{c}" for c in columns])


def classification_metrics(df: DataFrame, p: str = "p", label: str = "winner") -> DataFrame:
    """Accuracy, precision, recall, F1, AUC by rank sums, log-loss and Brier score."""
    hit, y = F.col(p) >= 0.5, F.col(label) == 1
    ranked = df.where(F.col(p).isNotNull() & F.col(label).isNotNull()).groupBy(p).agg(F.count("*").alias("n"), F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    below = running(ranked, p, ["neg"])
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    tp, fp, fn, tn = (F.sum(F.when(c, F.col(k)).otherwise(0)) for c, k in ((hit, "pos"), (hit, "neg"), (~hit, "pos"), (~hit, "neg")))
    total = below.agg(
        F.sum("n").alias("n"),
        ((tp + tn) / F.sum("n")).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.try_divide(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"),
        (-F.sum(F.col("pos") * F.log(q) + F.col("neg") * F.log(1 - q)) / F.sum("n")).alias("log_loss"),
        (F.sum(F.col("pos") * F.pow(1 - F.col(p), F.lit(2)) + F.col("neg") * F.pow(p, 2)) / F.sum("n")).alias("brier"),
    )
    return total


def roc_curve(df: DataFrame, p: str = "p", label: str = "winner") -> DataFrame:
    """False and true positive rates at every distinct prediction."""
    at = df.where(F.col(p).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(p).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    rate = lambda c: F.try_divide(F.col(f"total_{c}") - F.col(f"before_{c}"), F.col(f"total_{c}"))
    return running(at, "threshold", ["pos", "neg"]).select("threshold", rate("neg").alias("fpr"), rate("pos").alias("tpr"))
