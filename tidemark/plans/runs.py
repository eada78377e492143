"""Stored runs, outside entities, walk-forward refits, the table store: the registered queries and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import backtest, features, model_table, outside, refits, runs, scoring
from ..operators.model_table import OLS
from ..sources.shared import fresh_folder
from ..sources.store import TableStore
from . import panel_sql as Q
from .registry import ALL, SCORED, SIM_METRICS, SIM_SUMS, labels, load_panel, panel_features, query, relative, tidy

OUTSIDE = "NATION_7"
VERSION = "universe"
#: Both queries fit every line that two rows settle, as their SQL does; the library leaves out those of fewer than 20 rows.
TWO = 2


def _store(spark) -> TableStore:
    return TableStore(spark, fresh_folder(spark, "store"))


# --- SQL shared by the stored runs: cuts, fits, predictions, final scores


def _renamed(block: str, suffix: str) -> str:
    return re.sub(r"\b(feat|rel|dq|sc0|sc1|sc|pk)\b", rf"\1{suffix}", block)


def _fits(train: str, by: str = "") -> str:
    """One-variable fits and cuts of ``train`` (y and the five variables), one row (a ``by``)."""
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    cuts = ", ".join(f"quantile_cont({c}, 0.01) AS {c}_a, quantile_cont({c}, 0.99) AS {c}_b, avg({c}) AS {c}_m" for c in OLS)
    lines = ", ".join(f"regr_slope(y, {c}) AS {c}_s, regr_intercept(y, {c}) AS {c}_i" for c in OLS)
    return f"mt AS (SELECT {key}{cuts}, {lines} FROM {train} {group})"


def _line(c: str) -> str:
    return f"({c}_i + {c}_s * coalesce(CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, {c}_b), {c}_a) END, {c}_m, 0.0::DOUBLE))"


_each = ", ".join(f"{_line(c)} AS p_{c}" for c in OLS)
_weakest = "least(" + ", ".join(f"p_{c}" for c in OLS) + ")"
_mean = "(" + " + ".join(f"p_{c}" for c in OLS) + f") / {len(OLS)}"
_agree = "(" + " + ".join(f"(p_{c} >= 0)::INT" for c in OLS) + f") * 100.0::DOUBLE / {len(OLS)}"


def _final(name: str, source: str) -> str:
    """``name``: ``source`` (components and predictions) with the final score, to an even second digit at ties."""
    return f"""{name}_1 AS (SELECT *, {_mean} AS predicted_excess, {_weakest} AS weakest, {_agree} AS agreed FROM {source}),
{name}_2 AS (SELECT *, {Q.score("predicted_excess")} AS excess_ranked FROM {name}_1),
{name}_3 AS (SELECT *, round((data_quality_score * 0.10::DOUBLE + 50.0::DOUBLE * 0.35::DOUBLE + excess_ranked * 0.25::DOUBLE + agreed * 0.15::DOUBLE + risk_score * 0.10::DOUBLE + valuation_score * 0.05::DOUBLE) * 1e8)::BIGINT AS units FROM {name}_2),
{name} AS (SELECT *, (units // 1000000 + (2 * (units % 1000000) > 1000000 OR (2 * (units % 1000000) = 1000000 AND (units // 1000000) % 2 <> 0))::BIGINT) / 100.0::DOUBLE AS total_score FROM {name}_3)"""


_class = "CASE WHEN predicted_excess >= 0.02::DOUBLE AND agreed >= 55 AND data_quality_score >= 60 THEN 'Watchlist candidate' WHEN predicted_excess <= -0.10::DOUBLE OR data_quality_score < 40 THEN 'Weak / avoid' ELSE 'Neutral' END"

# --- G13, G14, F34: an entity from outside

PLACED = ["risk_score", "valuation_score", "momentum_score", "fundamental_score", "data_quality_score", "excess_score", "agreement_score", "predicted_excess", "weakest", "final_score", "percentile"]


@query(
    Q.query(
        *SCORED,
        Q.TARGETS,
        f"feat_u AS (SELECT * FROM feat WHERE ticker <> '{OUTSIDE}')",
        _renamed(Q.RELATIVE, "_u"),
        _renamed(Q.QUALITY, "_u"),
        _renamed(Q.SCORES, "_u"),
        "tr AS (SELECT f.*, excess_return AS y FROM feat_u f JOIN tg USING (feature_date, ticker) WHERE winner IS NOT NULL)",
        _fits("tr"),
        f"a0 AS (SELECT sc.*, {_each} FROM sc, mt)",
        _final("al", "a0"),
        f"u0 AS (SELECT sc_u.*, {_each} FROM sc_u, mt)",
        _final("un", "u0"),
        f"""pl AS (SELECT e.feature_date, 1 + count(*) FILTER (u.total_score >= e.total_score) AS rank, count(*) + 1 AS n FROM al e JOIN un u ON u.feature_date = e.feature_date WHERE e.ticker = '{OUTSIDE}' GROUP BY 1)""",
        select=f"""SELECT feature_date, ticker, round(risk_score, 6) AS risk_score, round(valuation_score, 6) AS valuation_score, round(momentum_score, 6) AS momentum_score, round(fundamental_score, 6) AS fundamental_score, round(data_quality_score, 6) AS data_quality_score,
          round(excess_ranked, 6) AS excess_score, round(agreed, 6) AS agreement_score, round(predicted_excess, 6) AS predicted_excess, round(weakest, 6) AS weakest, total_score AS final_score, round(rank / n, 6) AS percentile, rank, {_class} AS class, weakest > 0 AS would_pass
          FROM al JOIN pl USING (feature_date) WHERE ticker = '{OUTSIDE}'""",
    )
)
def g13_outside_entity(spark, sf_dir):
    """One nation is withheld; the others are fitted, scored and stored; it is scored from the tables."""
    p, store = load_panel(spark, sf_dir), _store(spark)
    store.write("monthly_features", relative_of(p, p.stocks.where(F.col("ticker") != OUTSIDE)), runs.KEYS)
    universe = store.read("monthly_features")
    train = universe.join(labels(p).where("winner is not null").select("feature_date", "ticker", "excess_return", "winner"), ["feature_date", "ticker"])
    runs.save_universe(store, universe, train, list(OLS), VERSION, full=False, least=TWO)
    return tidy(runs.score_outside(store, own_features(p, OUTSIDE), VERSION).select("feature_date", "ticker", *PLACED, "rank", "class", "would_pass"))


def relative_of(p, stocks):
    made = features.sector_relative(features.feature_panel(stocks, p.prices, p.benchmark, p.fundamentals))
    return made.withColumn("data_quality_score", features.quality_score(made))


def own_features(p, ticker: str):
    """Features of one entity from its own rows and the benchmark."""
    mine = lambda df: df.where(F.col("ticker") == ticker)
    return features.feature_panel(mine(p.stocks), mine(p.prices), p.benchmark, mine(p.fundamentals))


# --- S43: two months, one of them interrupted and resumed, then run again


@query(
    Q.query(
        *SCORED,
        Q.TARGETS,
        "mths AS (SELECT date AS m FROM bench ORDER BY date DESC LIMIT 2)",
        "tr AS (SELECT m, f.*, excess_return AS y FROM mths, feat f JOIN tg USING (feature_date, ticker) WHERE winner IS NOT NULL AND target_date <= m)",
        _fits("tr", "m"),
        f"a0 AS (SELECT sc.*, {_each} FROM sc JOIN mt ON sc.feature_date = mt.m)",
        _final("al", "a0"),
        "fl AS (SELECT *, greatest(1, round_even(count(*) OVER (PARTITION BY feature_date) * 0.3::DOUBLE, 0)::INT) AS k, row_number() OVER (PARTITION BY feature_date ORDER BY CASE WHEN data_quality_score >= 60 THEN weakest END DESC NULLS LAST, ticker) AS place FROM al)",
        select=f"""SELECT feature_date AS prediction_date, ticker, round(predicted_excess, 6) AS predicted_excess, round(weakest, 6) AS weakest, round(excess_ranked, 6) AS excess_score, round(agreed, 6) AS agreement_score, round(data_quality_score, 6) AS data_quality_score, total_score AS final_score, {_class} AS class,
          (data_quality_score >= 60 AND weakest IS NOT NULL AND place <= k)::INT AS flag, 12::BIGINT AS n_steps FROM fl""",
    )
)
def s43_monthly_runs(spark, sf_dir):
    """The snapshots after two months' runs; the second dies after its training, is resumed and run once more."""
    p, store = load_panel(spark, sf_dir), _store(spark)
    months = sorted(r.date for r in p.benchmark.select("date").distinct().collect())[-2:]  # a row a month
    monthly = runs.MonthlyRun(store, p, list(OLS), full=False, least=TWO)
    for month in months:
        try:
            monthly.run(month, stop_after="train" if month == months[-1] else None)
        except runs.Stopped:
            monthly.run(month)
    monthly.run(months[-1])
    steps = store.read("run_log").agg(F.count("*").alias("n_steps"))
    made = store.read("prediction_snapshots").crossJoin(F.broadcast(steps))  # one row
    return tidy(made.select("prediction_date", "ticker", "predicted_excess", "weakest", "excess_score", "agreement_score", "data_quality_score", "final_score", "class", "flag", "n_steps"))


# --- K03, K04: merges in a store


@query(
    """WITH base AS (SELECT o_orderkey AS k, o_custkey AS who, round(o_totalprice, 2) AS total FROM orders WHERE o_orderdate::DATE < DATE '1998-01-01'),
late AS (SELECT o_orderkey AS k, o_custkey AS who, -round(o_totalprice, 2) AS total FROM orders WHERE o_orderkey % 7 = 0),
added AS (SELECT o_orderkey AS k, o_custkey AS who, round(o_totalprice, 2) AS total FROM orders)
SELECT k, who, total FROM late UNION ALL SELECT k, who, total FROM base WHERE k NOT IN (SELECT k FROM late)
UNION ALL SELECT k, who, total FROM added WHERE k NOT IN (SELECT k FROM late) AND k NOT IN (SELECT k FROM base)"""
)
def k03_merged_files(spark, sf_dir):
    """A stored table after an upsert, an insert of what is new, a repeated batch and a compaction."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("who"), F.round("o_totalprice", 2).alias("total"), F.to_date("o_orderdate").alias("day"))
    store, late = _store(spark), orders.where("k % 7 = 0").withColumn("total", -F.col("total")).drop("day")
    store.write("orders", orders.where("day < date'1998-01-01'").drop("day"), ["k"])
    store.upsert("orders", late, ["k"], "total", ("late", 1))
    store.insert_ignore("orders", orders.drop("day"), ["k"], "total")
    store.upsert("orders", late.withColumn("total", F.lit(0.0)), ["k"], "total", ("late", 1))  # that batch again: its mark is there
    store.compact("orders", 1 << 20)
    return store.read("orders")


# --- B06, B22, S19: walk-forward refits, saved results

ONE, PENALTY, LEAST = "twelve_month_momentum", 10.0, 24


def _walk(window: str) -> str:
    return f"""SELECT '{window}' AS form, t.feature_date, tr.feature_date AS trained, tr.x, tr.y FROM ds t JOIN ds d ON d.due <= t.feature_date AND d.feature_date < t.feature_date
      JOIN wf tr ON tr.feature_date = d.feature_date{" WHERE d.nth > t.n_due - 36" if window == "rolling" else ""}"""


@query(
    Q.query(
        *ALL,
        Q.TARGETS,
        f"wf AS (SELECT feature_date, ticker, {ONE} AS x, excess_return AS y FROM feat JOIN tg USING (feature_date, ticker) WHERE {ONE} IS NOT NULL AND excess_return IS NOT NULL)",
        "d0 AS (SELECT feature_date, max(target_date) AS due FROM tg GROUP BY 1), d1 AS (SELECT *, row_number() OVER (ORDER BY feature_date) AS nth FROM d0)",
        "ds AS (SELECT a.*, (SELECT count(*) FROM d1 b WHERE b.due <= a.feature_date AND b.feature_date < a.feature_date) AS n_due FROM d1 a)",
        f"tw AS ({_walk('expanding')} UNION ALL {_walk('rolling')})",
        "wm AS (SELECT form, feature_date, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sd, avg(y) AS my FROM tw GROUP BY 1, 2)",
        f"wb AS (SELECT form, feature_date, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(sd) AS sd, sum((x - mx) / sd * (y - my)) / (any_value(n) + {PENALTY}::DOUBLE) AS b FROM tw JOIN wm USING (form, feature_date) GROUP BY 1, 2)",
        select=f"SELECT form, feature_date, least(n_due, CASE form WHEN 'rolling' THEN 36 ELSE n_due END)::BIGINT AS n_dates, n AS n_rows, round(b / sd, 8) AS slope, round(my - mx * b / sd, 8) AS intercept FROM wb JOIN ds USING (feature_date) WHERE n_due >= {LEAST}",
    )
)
def b06_walk_forward_refits(spark, sf_dir):
    """Expanding and rolling refits at every date, of one feature so that SQL can follow."""
    p, rows = load_panel(spark, sf_dir), []
    panel = panel_features(p).select("feature_date", "ticker", ONE).join(labels(p).select("feature_date", "ticker", "target_date", "excess_return"), ["feature_date", "ticker"])
    for form, window in (("expanding", None), ("rolling", 36)):
        rows += [(form, d, k, n, w[1], w[0]) for d, k, n, _, w, _ in refits.refits(panel, [ONE], least=LEAST, window=window, penalties=[PENALTY])]
    return tidy(spark.createDataFrame(rows, "form string, feature_date date, n_dates bigint, n_rows bigint, slope double, intercept double"), 8)


@query(Q.query(*SCORED, Q.SIM, SIM_SUMS, select=f"SELECT 'top 5 by score' AS strategy, 5 AS top_n, (SELECT min(date) FROM sim) AS start_date, (SELECT max(next_date) FROM sim) AS end_date, 1::BIGINT AS n_stored, {SIM_METRICS} FROM one, dd"))
def b22_saved_backtest(spark, sf_dir):
    """A backtest that is run twice is stored once and read back."""
    p, store = load_panel(spark, sf_dir), _store(spark)
    scored = scoring.scores(relative(p))
    for _ in range(2):
        stored = refits.run_backtest(store, scored, p.prices, p.benchmark, "top 5 by score", 5, 20.0, 24)
    counted = stored.withColumn("n_stored", F.lit(store.read("backtest_results").count()))
    return tidy(counted.drop("backtest_id"))


@query()
def b22_walk_forward_ridge(spark, sf_dir):
    """Ridge on all features, refitted every month on the labels known by then; top five, stored, read back."""
    p, store = load_panel(spark, sf_dir), _store(spark)
    names = [c for c in Q.FEATURE_NAMES if not c.startswith("five_year")]
    panel = relative(p).join(labels(p).select("feature_date", "ticker", "target_date", "excess_return"), ["feature_date", "ticker"])
    scored = refits.predictions(panel, refits.refits(panel, names), names)
    return tidy(refits.run_backtest(store, scored, p.prices, p.benchmark, "ridge walk-forward", 5, 20.0, 0, "prediction").drop("backtest_id"))
