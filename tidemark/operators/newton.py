"""Logistic fits of many windows of dates at once, by Newton steps on sums by window.

Each step is one job: a task adds, for its rows and every window that a row's date is in,
gradient and Hessian at that window's weights, and hands on one small matrix a window; the
sums meet by window and place. So no task holds a window's rows, rows are never copied to
their windows, and what reaches the driver depends on windows and features alone.
Features are standardised by the window's own mean and deviation, from running sums by date.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models, outside
from .refits import Running


@dataclass
class Fit:
    """Weights on standardised features, their means and deviations, and how the fit ended (Hessian without the penalty)."""

    weights: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    n: int
    log_likelihood: float
    converged: bool
    rounds: int
    hessian: np.ndarray | None = None

    def own_scale(self) -> np.ndarray:
        b = self.weights[1:] / self.sd
        return np.append(self.weights[0] - self.mean @ b, b)


def _sums(features: list[str], label: str, date: str, windows: list[tuple], state: list[tuple]):
    """Per window (place in ``windows``) the gradient, the upper Hessian and the log-likelihood, flattened."""
    k = len(features) + 1
    upper = np.triu_indices(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            days = batch[date].to_numpy()
            x, y = batch[features].to_numpy(float), batch[label].to_numpy(float)
            for day in pd.unique(days):
                at = days == day
                xd, yd = x[at], y[at]
                for i, (first, last) in enumerate(windows):
                    if state[i] is None or not first <= day <= last:
                        continue
                    w, mean, sd = state[i]
                    z = np.column_stack([np.ones(len(xd)), (xd - mean) / sd])
                    eta = z @ w
                    p = 1 / (1 + np.exp(-eta))
                    h = (z * (p * (1 - p))[:, None]).T @ z
                    ll = yd @ eta - np.logaddexp(0, eta).sum()
                    got = np.concatenate([z.T @ (yd - p), h[upper], [ll]])
                    total[i] = total[i] + got if i in total else got
        for i, v in total.items():
            yield pd.DataFrame({"window": i, "place": np.arange(len(v)), "value": v})

    return run


def fits(rows: DataFrame, features: list[str], label: str, windows: list[tuple[dt.date, dt.date]], date: str = "feature_date", c: float | None = 1.0, rounds: int = 50, tolerance: float = 1e-9) -> list[Fit | None]:
    """A fit for each window of dates (both ends within); None without rows of both labels.

    ``rows`` are complete. ``c`` is the inverse strength of the penalty (None: none). A fit
    whose last step is below ``tolerance`` has converged; after ``rounds`` it has not.
    """
    used = rows.select(F.col(date).alias("_date"), F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]).persist()  # read once a step
    try:
        names = [f"_x{i}" for i in range(len(features))]
        by_date = sorted(((k[0], m) for k, m in models.moments(used, [*names, "_y"], "_date")), key=lambda x: x[0])
        sums = Running(by_date)
        days = np.array([d for d, _ in by_date], dtype=object)
        out: list[Fit | None] = []
        for first, last in windows:
            at = [i for i, d in enumerate(days) if first <= d <= last]
            m = sums.between(at[0], at[-1] + 1) if at else None
            if m is None or m[0, 0] < 1 or not 0 < m[0, -1] < m[0, 0]:
                out.append(None)
                continue
            mean = m[0, 1:-1] / m[0, 0]
            sd = np.sqrt(np.maximum(np.diag(m)[1:-1] / m[0, 0] - mean**2, 0.0))
            sd[sd <= 1e-12 * np.maximum(np.abs(mean), 1e-300)] = 1.0
            out.append(Fit(np.zeros(len(features) + 1), mean, sd, int(m[0, 0]), float("nan"), False, 0))
        k = len(features) + 1
        upper, penalty = np.triu_indices(k), np.diag([0.0, *[0.0 if c is None else 1 / c] * len(features)])
        for _ in range(rounds):
            state = [None if f is None or f.converged else (f.weights, f.mean, f.sd) for f in out]
            if not any(s is not None for s in state):
                break
            part = used.mapInPandas(_sums(names, "_y", "_date", windows, state), "window int, place int, value double")
            found: dict[int, np.ndarray] = {}
            for r in part.groupBy("window", "place").agg(F.sum("value").alias("value")).collect():  # windows x (features squared)
                found.setdefault(r.window, np.zeros(k + len(upper[0]) + 1))[r.place] = r.value
            for i, v in found.items():
                f = out[i]
                h = np.zeros((k, k))
                h[upper] = v[k:-1]
                h = h + np.triu(h, 1).T
                f.hessian = h
                step = np.linalg.pinv(h + penalty) @ (v[:k] - penalty @ f.weights)
                f.log_likelihood, f.rounds = float(v[-1]), f.rounds + 1
                f.weights = f.weights + step
                f.converged = bool(np.abs(step).max() < tolerance)
        return out
    finally:
        used.unpersist()


def split_windows(days: list[dt.date], dates: int = 36, share: float = 0.7) -> list[tuple[dt.date, dt.date, dt.date, dt.date, dt.date]]:
    """(date, first and last to fit on, first and last to measure on) of the ``dates`` days before each day."""
    out = []
    for i in range(dates, len(days)):
        span, cut = days[i - dates : i], int(dates * share)
        out.append((days[i], span[0], span[cut - 1], span[cut], span[-1]))
    return out


def aucs(scored: DataFrame, by: str = "window", score: str = "score", label: str = "y") -> DataFrame:
    """(by, n, n_pos, auc): positives are placed among the sorted slices of negatives, so no task sorts a window."""
    long = scored.select(by, F.lit("score").alias("figure"), F.col(score).alias("value"), F.col(label).alias("_y"))
    ladder, rungs = outside.ladders(long.where("_y = 0").drop("_y"), [by, "figure"])
    up = long.where("_y = 1").groupBy(by, "figure", "value").agg(F.count("*").alias("times"))
    placed = outside.placed(up.select(by, "times", "figure", "value", F.col("value").alias("at")), ladder, rungs, [by, "times", "at"], by)
    sums = placed.groupBy(by).agg(F.sum(F.col("times") * (F.col("below") + F.col("equal") / 2)).alias("won"), F.sum("times").alias("n_pos"), F.max("total").alias("n_neg"))
    return sums.select(by, (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos", F.try_divide("won", F.col("n_pos") * F.col("n_neg")).alias("auc"))


def rolling_auc(df: DataFrame, features: list[str], label: str = "winner", dates: int = 36, share: float = 0.7, date: str = "feature_date") -> DataFrame:
    """date, n_train, n_test, auc, converged of a fit on the first share of the ``dates`` dates before each date, measured on the rest.

    Windows of fewer than 30 rows (15 to fit, 5 to measure) or with one label only in either part are left out.
    """
    rows = df.na.drop(subset=[*features, label])
    days = sorted(r[0] for r in rows.select(date).distinct().collect())  # a row a date
    windows = split_windows(days, dates, share)
    found = fits(rows, features, label, [(w[1], w[2]) for w in windows], date)
    known = [(i, w[0], w[3], w[4], f.n, f.converged, [float(v) for v in f.own_scale()]) for i, (w, f) in enumerate(zip(windows, found, strict=True)) if f is not None and f.n >= 15]
    table = df.sparkSession.createDataFrame(known, "window int, at date, first date, last date, n_train bigint, converged boolean, w array<double>")
    each_day = table.select("window", "w", F.explode(F.array(*[F.lit(d) for d in days]) if days else F.array().cast("array<date>")).alias(date)).join(table.select("window", "first", "last"), "window").where(F.col(date).between(F.col("first"), F.col("last")))
    met = rows.select(date, F.col(label).cast("int").alias("y"), *features).join(F.broadcast(each_day.select("window", "w", date)), date)  # a row a date and window
    score = sum((F.col(c).cast("double") * F.get("w", F.lit(i + 1)) for i, c in enumerate(features)), F.get("w", F.lit(0)))
    measured = aucs(met.select("window", "y", score.alias("score")))
    return table.join(measured, "window").where("n_train >= 15 and n >= 5 and n_train + n >= 30 and auc is not null").select(F.col("at").alias(date), "n_train", F.col("n").alias("n_test"), "auc", "converged")
