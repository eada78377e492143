"""Walk-forward with a refit at every date, from one aggregation of the panel.

A date's sums of products are one matrix. A training set is a span of dates, so its matrix
is a difference of two running sums, and each backtest date gets its own penalised fit
without reading a row again: the panel is aggregated once, whatever the number of dates.
What reaches the driver is a matrix a date.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import TableStore, save
from . import backtest, fitted, models


def spans(dates: list[dt.date], due: dict[dt.date, dt.date], least: int, step: int = 1, window: int | None = None) -> list[tuple[int, int, int]]:
    """(test, first, end): for every ``step``-th test date its training dates first..end-1.

    ``dates`` ascend. Only dates whose label is ``due`` by the test date are trained on,
    all of them or the last ``window``; test dates with fewer than ``least`` are left out.
    """
    out, end = [], 0
    for j, at in enumerate(dates):
        while end < j and due[dates[end]] <= at:
            end += 1
        first = 0 if window is None else max(0, end - window)
        if end - first >= least:
            out.append((j, first, end))
    return out[::step]


class Running:
    """Running sums of matrices in order of dates."""

    def __init__(self, by_date: list[tuple[dt.date, np.ndarray]]):
        self.dates = [d for d, _ in by_date]
        shape = by_date[0][1].shape if by_date else (0, 0)
        self.sums = np.concatenate([np.zeros((1, *shape)), np.cumsum([m for _, m in by_date], axis=0)]) if by_date else np.zeros((1, *shape))

    def between(self, first: int, end: int) -> np.ndarray:
        return self.sums[end] - self.sums[first]


def ridge_fit(matrix: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, weights...) on the features' own scale of a ridge on features standardised by the matrix's rows."""
    n = matrix[0, 0]
    mean = matrix[0, 1:-1] / n
    variance = np.diag(matrix)[1:-1] / n - mean**2
    sd = np.where(variance > 1e-12 * np.maximum(np.diag(matrix)[1:-1] / n, 1e-300), np.sqrt(np.maximum(variance, 1e-300)), 1.0)
    w = fitted.ridge(fitted._rescaled(matrix, mean, sd), alpha)
    own = w[1:] / sd
    return np.append(w[0] - mean @ own, own)


def chosen_penalty(sums: Running, first: int, end: int, penalties: list[float], folds: int = 3) -> float:
    """The penalty of the least squared error over forward-chained blocks of the training dates."""
    block = (end - first) // (folds + 1)
    if block < 1 or len(penalties) == 1:
        return penalties[0]
    tests = [(sums.between(first, end - k * block), sums.between(end - k * block, end - (k - 1) * block)) for k in range(folds, 0, -1)]
    error = [sum(models.squared_error(test, ridge_fit(train, a)) for train, test in tests if train[0, 0]) for a in penalties]
    return penalties[int(np.argmin(error))]


def refits(panel: DataFrame, names: list[str], label: str = "excess_return", due: str = "target_date", least: int = 24, step: int = 1, window: int | None = None, penalties: list[float] = (1.0, 10.0, 100.0, 1000.0), least_rows: int | None = None) -> list[tuple]:
    """(test date, dates, rows, penalty, weights, means) of every walk-forward fit on complete rows of ``panel``.

    ``panel`` has the dates to test too; their labels may be null. One aggregation gives all sums.
    """
    dates = sorted((r[0], r[1]) for r in panel.groupBy("feature_date").agg(F.max(due)).collect())  # a row a date
    found = dict((k[0], m) for k, m in models.gram(panel, [*names, label], "feature_date"))
    zero = np.zeros((len(names) + 2, len(names) + 2))
    sums, out = Running([(d, found.get(d, zero)) for d, _ in dates]), []
    for j, first, end in spans([d for d, _ in dates], dict(dates), least, step, window):
        m = sums.between(first, end)
        if m[0, 0] < (len(names) + 2 if least_rows is None else least_rows):
            continue
        alpha = chosen_penalty(sums, first, end, list(penalties))
        out.append((dates[j][0], end - first, int(m[0, 0]), float(alpha), [float(v) for v in ridge_fit(m, alpha)], [float(v) for v in m[0, 1:-1] / m[0, 0]]))
    return out


def predictions(panel: DataFrame, fits: list[tuple], names: list[str]) -> DataFrame:
    """``panel`` rows of test dates with ``prediction`` by their date's own fit; a missing feature takes that fit's training mean."""
    table = panel.sparkSession.createDataFrame([(d, w, m) for d, _, _, _, w, m in fits], "feature_date date, _w array<double>, _m array<double>")
    joined = panel.join(F.broadcast(table), "feature_date")  # a row a test date
    value = sum((F.coalesce(F.col(c), F.get("_m", F.lit(i))) * F.get("_w", F.lit(i + 1)) for i, c in enumerate(names)), F.get("_w", F.lit(0)))
    return joined.withColumn("prediction", value).drop("_w", "_m")


def run_backtest(store: TableStore, scored: DataFrame, prices: DataFrame, benchmark: DataFrame, strategy: str, top: int, quality: float, warm_up: int, score: str = "final_score") -> DataFrame:
    """Simulates the top rows of each date, stores its metrics under a generated id and returns the stored row's frame.

    The id is a digest of the row, so a run that is repeated is stored once.
    """
    picked = backtest.select_portfolio(scored.withColumn("final_score", F.col(score)), top, quality)
    sim = backtest.simulate(picked, prices, benchmark, warm_up)
    row = backtest.metrics(sim).crossJoin(F.broadcast(sim.agg(F.min("date").alias("start_date"), F.max("next_date").alias("end_date"))))  # one row each
    save(store, "backtest_results", row.select(F.lit(strategy).alias("strategy"), F.lit(top).alias("top_n"), "*"))
    return load_backtest_results(store).where(F.col("strategy") == strategy)


def load_backtest_results(store: TableStore, strategy: str | None = None) -> DataFrame:
    """Stored results, the latest start first."""
    rows = store.read("backtest_results")
    return (rows if strategy is None else rows.where(F.col("strategy") == strategy)).orderBy(F.col("start_date").desc(), "backtest_id")
