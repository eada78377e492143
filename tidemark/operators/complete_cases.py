"""Sums of products by pattern of missing values: the complete cases of any subset of features.

A row's pattern says which columns it has. Sums by (pattern, date) are made in one pass; the
complete cases of a subset are the patterns that contain it, so its matrix is a sum over
those, and a selection that drops features step by step takes its complete cases anew each
time without reading a row again. The table is as large as there are patterns and dates
and stays in Spark; a subset's matrices (one a date) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import student
from . import models


class CompleteCases:
    """Matrices of (1, subset..., label) over the complete cases of a subset, by date."""

    def __init__(self, df: DataFrame, features: list[str], label: str, date: str = "feature_date"):
        if len(features) > 62:
            raise ValueError("a pattern of more than 62 columns does not fit a long")
        self.features, self.label, self.date = list(features), label, date
        columns = [*features, label]
        k = len(columns) + 1
        upper = np.triu_indices(k)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple, np.ndarray] = {}
            for batch in batches:
                x = batch[columns].to_numpy(float)
                there = np.isfinite(x)
                pattern = there[:, :-1] @ (1 << np.arange(len(features), dtype=np.int64))
                z = np.column_stack([np.ones(len(x)), np.where(there, x, 0.0)])
                days = batch[date].to_numpy()
                for (p, d), at in pd.DataFrame({"p": pattern, "d": days}).groupby(["p", "d"], sort=False).indices.items():
                    m = (z[at].T @ z[at])[upper]
                    total[p, d] = total[p, d] + m if (p, d) in total else m
            for (p, d), m in total.items():
                yield pd.DataFrame({"pattern": p, date: [d] * len(m), "place": np.arange(len(m)), "value": m})

        rows = df.where(F.col(label).isNotNull()).select(date, *[F.col(c).cast("double").alias(c) for c in columns])
        kind = df.schema[date].dataType.simpleString()
        self.table = rows.mapInPandas(sums, f"pattern long, {date} {kind}, place int, value double").groupBy("pattern", date, "place").agg(F.sum("value").alias("value")).persist()

    def close(self) -> None:
        self.table.unpersist()

    def __enter__(self) -> CompleteCases:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def by_date(self, subset: list[str]) -> list[tuple]:
        """(date, matrix of (1, subset..., label)) in order of dates, of dates with a complete case."""
        mask = sum(1 << self.features.index(c) for c in subset)
        k = len(self.features) + 2
        upper = np.triu_indices(k)
        found: dict = {}
        for r in self.table.where(F.col("pattern").bitwiseAND(F.lit(mask)) == mask).groupBy(self.date, "place").agg(F.sum("value").alias("value")).collect():
            found.setdefault(r[0], np.zeros(len(upper[0])))[r.place] = r.value
        at = [0, *[1 + self.features.index(c) for c in subset], k - 1]
        out = []
        for d in sorted(found):
            m = np.zeros((k, k))
            m[upper] = found[d]
            m = m + np.triu(m, 1).T
            out.append((d, m[np.ix_(at, at)]))
        return out

    def matrix(self, subset: list[str]) -> np.ndarray:
        return sum((m for _, m in self.by_date(subset)), np.zeros((len(subset) + 2, len(subset) + 2)))


def split(by_date: list[tuple], share: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of the first share of the dates and of the rest."""
    cut = int(len(by_date) * share)
    zero = np.zeros_like(by_date[0][1])
    return sum((m for _, m in by_date[:cut]), zero), sum((m for _, m in by_date[cut:]), zero)


def select_by_vif(cases: CompleteCases, threshold: float = 10.0) -> tuple[list[str], list[tuple[str, float]]]:
    """Drops the feature of the largest variance inflation until all are at most ``threshold``; complete cases are taken anew.

    Returns the kept features and the dropped ones with their figure. It stops below two
    features or five rows more than features. Columns that others determine count as infinite.
    """
    kept, dropped = list(cases.features), []
    while len(kept) >= 2:
        m = cases.matrix(kept)
        if m[0, 0] < len(kept) + 5:
            break
        worst = max(inflation(m, kept), key=lambda v: v[1])
        if worst[1] <= threshold:
            break
        kept.remove(worst[0])
        dropped.append(worst)
    return kept, dropped


def inflation(matrix: np.ndarray, names: list[str]) -> list[tuple[str, float]]:
    """Variance inflation without intercept, from a matrix of (1, names..., label); columns are scaled first."""
    g = matrix[1:-1, 1:-1]
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    g = g / np.outer(scale, scale)
    if len(names) > np.linalg.matrix_rank(g, tol=1e-10, hermitian=True):
        values, vectors = np.linalg.eigh(g)
        tied = (np.abs(vectors[:, values <= 1e-10]) > 1e-6).any(axis=1)
    else:
        tied = np.zeros(len(names), bool)
    inverse = np.linalg.pinv(g, hermitian=True)
    return [(name, float("inf") if tied[i] else float(inverse[i, i])) for i, name in enumerate(names)]


def fitted(by_date: list[tuple], names: list[str], share: float = 0.7) -> dict | None:
    """OLS on the first share of the dates: coefficients and figures, and R² on the rest (at least five rows)."""
    train, test = split(by_date, share) if by_date else (np.zeros((1, 1)), None)
    if train[0, 0] <= len(names) + 1:
        return None
    fit = models.ols(train, names)
    w = np.array([r[1] for r in fit["coefficients"]])
    spread = test[-1, -1] - test[0, -1] ** 2 / test[0, 0] if test[0, 0] else 0.0
    k, n = len(names), fit["n"]
    fit["r2_test"] = 1 - models.squared_error(test, w) / spread if test[0, 0] >= 5 and spread > 0 else None
    fit["n_test"] = int(test[0, 0])
    fit["f_stat"] = fit["r2"] / k / ((1 - fit["r2"]) / (n - k - 1)) if fit["r2"] < 1 else None
    fit["df"] = n - k - 1
    return fit


def multiple_regression(df: DataFrame, features: list[str], label: str = "excess_return", share: float = 0.7, threshold: float = 10.0, least: int = 50, date: str = "feature_date") -> dict:
    """The fit on all features and that on those which the variance inflation leaves, each on its own complete cases.

    Keys: full and filtered (None below ``least`` rows), features, dropped, vif_full, vif_filtered.
    """
    with CompleteCases(df, features, label, date) as cases:
        kept, dropped = select_by_vif(cases, threshold)
        out = {"features": kept, "dropped": dropped}
        for name, subset in (("full", list(features)), ("filtered", kept)):
            by_date = cases.by_date(subset)
            total = sum((m for _, m in by_date), np.zeros((len(subset) + 2, len(subset) + 2)))
            out[name] = fitted(by_date, subset, share) if total[0, 0] >= least else None
            out[f"vif_{name}"] = inflation(total, subset) if total[0, 0] else []
        return out


def coefficient_table(spark, fit: dict | None) -> DataFrame:
    """term, coefficient, std_error, t_stat, p_value, ci_low, ci_high, significant of a fit."""
    rows = [(r[0], r[1], r[2], fit["df"]) for r in fit["coefficients"]] if fit else []
    made = spark.createDataFrame(rows, "term string, coefficient double, std_error double, df int")
    t = F.try_divide("coefficient", "std_error")
    half = student.t_quantile(0.05, F.col("df")) * F.col("std_error")
    out = made.withColumns({"t_stat": t, "p_value": student.t_p_value(t, F.col("df")), "ci_low": F.col("coefficient") - half, "ci_high": F.col("coefficient") + half})
    return out.withColumn("significant", F.col("p_value") < 0.05).drop("df")
