"""The monthly run over stored tables, the state that it leaves, and what reads that state.

A run of a month has six steps. Each ends in commits that carry the step's mark for that
month, so rows and the record that they were written are one: a run that died goes on with
the first step that lacks its mark, a second run of a month finds all marks and changes
nothing. Steps read the stored tables only, which hold what was known by the month.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.panel import Panel
from ..sources.store import TableStore, save
from . import backtest, features, fitted, model_table, models, outside, scoring
from .asof import spine
from .targets import targets

STEPS = ("ingest", "features", "targets", "train", "score", "realize")
#: The keys of the stored state; its rows of a date come together.
STATE = {"peers": ["feature_date", "sector", "figure"], "ladders": ["feature_date", "figure"], "rungs": ["feature_date", "figure", "slice", "value"]}
KEYS = ["feature_date", "ticker"]


class Stopped(RuntimeError):
    """Raised after a step when a run is told to stop there."""


def save_universe(store: TableStore, universe: DataFrame, train: DataFrame, names: list[str], version: str, full: bool = True, least: int = models.LEAST) -> DataFrame:
    """Fits on ``train``, scores ``universe`` and stores model table and state; returns the scored universe."""
    save_models(store, train, names, version, full, least=least)
    rows, used = model_table.predicted(universe, read_models(store, version))
    store.write("scored_universe", scoring.scores(rows, **used), KEYS)
    scored = store.read("scored_universe")
    for name, table in outside.stored_state(scored, used).items():
        store.write(name, table, KEYS[:1])
    return scored


def save_models(store: TableStore, train: DataFrame, names: list[str], version: str, full: bool = True, mark: tuple[str, int] | None = None, least: int = models.LEAST) -> None:
    table = model_table.fit(train, names, full, least=least).withColumn("model_version", F.lit(version))
    store.insert_ignore("model_weights", table, ["model_version", "model", "term"], "weight", mark)


def read_models(store: TableStore, version: str) -> dict:
    """Weights by model and term of a stored version; nothing is fitted."""
    return model_table.weights(store.read("model_weights").where(F.col("model_version") == version))


def score_outside(store: TableStore, rows: DataFrame, version: str) -> DataFrame:
    """Scores of entities that the stored universe does not have, from its tables alone.

    ``rows`` are their features (feature_date, ticker, sector, ...) without sector-relative
    ones. A date that the store lacks gives neutral ranks.
    """
    peers, ladder, rungs = (store.read(n) for n in STATE)
    own = outside.with_sector(rows, peers)
    own = own.withColumn("data_quality_score", features.quality_score(own))
    predicted, used = model_table.predicted(own, read_models(store, version))
    return outside.scored(predicted, ladder, rungs, used)


class MonthlyRun:
    """Brings the stored tables up to a month.

    ``source`` is what the provider has; of it a run takes what was known by the month.
    ``full`` models are ridge, lasso and logistic besides the one-variable fits, which
    take ``least`` rows.
    """

    def __init__(self, store: TableStore, source: Panel, names: list[str], full: bool = True, least: int = models.LEAST):
        self.store, self.source, self.names, self.full, self.least = store, source, names, full, least
        self.spark = store.spark

    def run(self, month: dt.date, stop_after: str | None = None) -> dict:
        """Runs the steps that are not done; returns what was done or skipped, the model's version and counts."""
        report: dict = {"month": month, "done": [], "skipped": []}
        for step in STEPS:
            mark = (f"{step}:{month}", 0)
            if self.store.is_done("run_log", mark):
                report["skipped"].append(step)
            else:
                getattr(self, f"_{step}")(month, mark)
                line = self.spark.createDataFrame([(month, step, "done")], "month date, step string, state string")
                self.store.insert_ignore("run_log", line, ["month", "step"], "state", mark)
                report["done"].append(step)
            if step == stop_after:
                raise Stopped(f"{month}: stopped after {step}")
        scored = self.store.read("prediction_snapshots").where(F.col("prediction_date") == F.lit(month))
        counts = scored.agg(F.count("*").alias("n_scored"), F.max("model_version").alias("model_version"), *[F.count_if(F.col("class") == c).alias(n) for c, n in ((scoring.LABELS[0], "n_strong"), (scoring.LABELS[1], "n_watchlist"))]).first()
        return {**report, **counts.asDict()}

    def _new(self, table: str, rows: DataFrame, date: str, month: dt.date) -> DataFrame:
        """Source rows up to the month that are later than the stored ones."""
        due = rows.where(F.col(date) <= F.lit(month))
        if not self.store.exists(table):
            return due
        last = self.store.read(table).agg(F.max(date)).first()[0]
        return due.where(F.col(date) > F.lit(last)) if last else due

    def _ingest(self, month: dt.date, mark: tuple) -> None:
        save(self.store, "stocks", self.source.stocks, mark=mark)
        save(self.store, "prices_clean", self._new("prices_clean", self.source.prices, "date", month), mark=mark)
        save(self.store, "benchmark_prices", self._new("benchmark_prices", self.source.benchmark, "date", month), mark=mark)
        save(self.store, "fundamentals_clean", self._new("fundamentals_clean", self.source.fundamentals, "report_date", month), mark=mark)

    def _recent(self, table: str, tail: str, date: str) -> DataFrame:
        """What features of months not done can need: the tail that the last run left and the rows since; all rows without one."""
        rows = self.store.read(table)
        if not self.store.exists(tail):
            return rows
        kept = self.store.read(tail)
        as_of = kept.agg(F.max("as_of")).first()[0]
        return rows if as_of is None else kept.drop("as_of").unionByName(rows.where(F.col(date) > F.lit(as_of)))

    def _features(self, month: dt.date, mark: tuple) -> None:
        """Of the dates that have none, in one plan: the first run makes all, later ones theirs from the carried tails and the new rows."""
        stocks, benchmark = self.store.read("stocks"), self.store.read("benchmark_prices")
        prices, reports = self._recent("prices_clean", "price_tail", "date"), self._recent("fundamentals_clean", "report_tail", "report_date")
        dates = benchmark.select(F.col("date").alias("feature_date")).distinct()
        if self.store.exists("monthly_features"):
            dates = dates.join(self.store.read("monthly_features").select("feature_date").distinct(), "feature_date", "left_anti")
        made = features.sector_relative(features.feature_panel(stocks, prices, benchmark, reports, dates=dates))
        save(self.store, "monthly_features", made.withColumn("data_quality_score", features.quality_score(made)), order="data_quality_score", mark=mark)
        self.store.write("price_tail", features.price_tail(prices, benchmark).withColumn("as_of", F.lit(month)), ["ticker", "date"], mark)
        self.store.write("report_tail", features.report_tail(reports).withColumn("as_of", F.lit(month)), ["ticker", "fiscal_date"], mark)

    def _targets(self, month: dt.date, mark: tuple) -> None:
        """Labels whose horizon has elapsed and that are not stored."""
        keys = spine(self.store.read("benchmark_prices").select(F.col("date").alias("feature_date")).distinct(), self.store.read("stocks").select("ticker"))
        keys = keys.where(F.last_day(F.add_months("feature_date", 12)) <= F.lit(month))
        if self.store.exists("targets"):
            keys = features.missing_pairs(keys, self.store.read("targets"))
        made = targets(keys, self.store.read("prices_clean"), self.store.read("benchmark_prices"), as_of=month).where("winner is not null")
        save(self.store, "targets", made, order="excess_return", mark=mark)

    def _training(self) -> DataFrame:
        known = self.store.read("targets").select("feature_date", "ticker", "excess_return", "winner")
        return self.store.read("monthly_features").join(known, ["feature_date", "ticker"])

    def version(self, month: dt.date) -> str:
        """Names the month and what was trained on: last date, number of rows and of entities."""
        r = self._training().agg(F.max("feature_date").alias("last"), F.count("*").alias("n"), F.count_distinct("ticker").alias("k")).first()
        return f"monthly_{month}_{hashlib.md5(f'{r.last}|{r.n}|{r.k}'.encode()).hexdigest()[:8]}"

    def _train(self, month: dt.date, mark: tuple) -> None:
        version = self.version(month)
        save_models(self.store, self._training(), self.names, version, self.full, mark, self.least)
        line = self.spark.createDataFrame([(version, month)], "model_version string, trained_for date")
        save(self.store, "model_training_runs", line, mark=mark)

    def _score(self, month: dt.date, mark: tuple) -> None:
        version = self.store.read("model_training_runs").where(F.col("trained_for") == F.lit(month)).agg(F.max("model_version")).first()[0]
        now = self.store.read("monthly_features").where(F.col("feature_date") == F.lit(month))
        rows, used = model_table.predicted(now, read_models(self.store, version))
        made = scoring.scores(rows, **used)
        made = made.withColumns({"class": scoring.classify(*[F.col(c) for c in ("probability", "predicted_excess", "agreement_score", "data_quality_score")]), "label": scoring.label_of_score(F.col("final_score"))})
        made = scoring.agreement_flag(made, ["weakest"])
        self.store.upsert("scored_universe", made, KEYS, "final_score", mark)
        made = self.store.read("scored_universe").where(F.col("feature_date") == F.lit(month))  # several tables come from it
        for name, table in outside.stored_state(made, used).items():
            self.store.upsert(name, table, STATE[name], "figure", mark)
        records = fitted.snapshot_records(made, self.names, version).withColumnRenamed("feature_date", "prediction_date")
        save(self.store, "prediction_snapshots", records, order="final_score", mark=mark)

    def _realize(self, month: dt.date, mark: tuple) -> None:
        """What came of earlier predictions, where the label is new."""
        snapshots = self.store.read("prediction_snapshots").withColumnRenamed("prediction_date", "feature_date")
        if self.store.exists("realized_performance"):
            old = self.store.read("realized_performance").select(F.col("prediction_date").alias("feature_date"), "ticker")
            snapshots = snapshots.join(old, ["feature_date", "ticker"], "left_anti")
        rows = backtest.realized(snapshots.select("feature_date", "ticker", "probability", F.col("predicted_excess")), self.store.read("targets"))
        save(self.store, "realized_performance", rows.withColumnRenamed("feature_date", "prediction_date"), order="actual", mark=mark)
