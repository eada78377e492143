"""The registered queries and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, backtest, complete_cases, features, models, newton, scoring, stats, targets
from ..sources.panel import Panel
from ..sources.panel import materialised_panel as load_panel
from ..sources.store import insert_ignore, upsert
from ..streaming.events import windowed
from . import panel_sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def tidy(df: DataFrame, digits: int = 6, amounts: tuple = ()) -> DataFrame:
    """Doubles rounded, NaN as null: what the comparison with SQL looks at."""
    exact = lambda c: F.round(F.col(c), 8) if c in amounts else F.col(c)
    return df.select(*[F.round(S.clean(exact(c)), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def panel_features(p: Panel, carry: list[str] | None = None) -> DataFrame:
    return features.feature_panel(p.stocks, p.prices, p.benchmark, p.fundamentals, carry or [])


def relative(p: Panel) -> DataFrame:
    made = features.sector_relative(panel_features(p))
    return made.withColumn("data_quality_score", features.quality_score(made))


def labels(p: Panel) -> DataFrame:
    keys = asof.spine(p.benchmark.select(F.col("date").alias("feature_date")), p.stocks.select("ticker"))
    return targets.targets(keys, p.prices, p.benchmark)


def long(p: Panel) -> DataFrame:
    return stats.long_form(panel_features(p).join(labels(p).select("feature_date", "ticker", "excess_return"), ["feature_date", "ticker"]), Q.IC_FEATURES)


def picks(p: Panel) -> DataFrame:
    return backtest.select_portfolio(scoring.scores(relative(p)), 5, 20.0)


def simulation(p: Panel) -> DataFrame:
    return backtest.simulate(picks(p), p.prices, p.benchmark)


def snapshots(p: Panel) -> DataFrame:
    """Predictions of a simple rule: probability from the score, excess from momentum."""
    made = scoring.scores(relative(p))
    return made.select("feature_date", "ticker", "sector", "final_score", "data_quality_score", (F.col("final_score") / 100).alias("probability"), (F.coalesce("twelve_month_momentum", F.lit(0.0)) / 4).alias("predicted_excess"), F.col("risk_score"))


SNAP = "sn AS (SELECT feature_date, ticker, sector, final_score, data_quality_score, final_score / 100 AS probability, coalesce(twelve_month_momentum, 0.0::DOUBLE) / 4 AS predicted_excess, risk_score FROM sc)"
BUCKET = "CASE WHEN probability IS NULL THEN 'Unknown' WHEN probability < 0.40::DOUBLE THEN '< 0.40 (Low)' WHEN probability < 0.50::DOUBLE THEN '0.40–0.50' WHEN probability < 0.60::DOUBLE THEN '0.50–0.60' WHEN probability < 0.70::DOUBLE THEN '0.60–0.70' WHEN probability < 0.80::DOUBLE THEN '0.70–0.80' ELSE '≥ 0.80 (High)' END"
REAL = f"""rz0 AS (SELECT s.*, round_even(stock_return, 8) - round_even(benchmark_return, 8) AS actual, {BUCKET} AS bucket FROM sn s JOIN tg USING (feature_date, ticker) WHERE winner IS NOT NULL),
rz AS (SELECT *, (actual > 0)::INT AS winner_actual, (probability >= 0.5)::INT AS winner_predicted, ((actual > 0) = (probability >= 0.5))::INT AS correct, predicted_excess - actual AS return_error FROM rz0)"""
ALL = (Q.PRICE, Q.REPORTS, Q.FEATURES)
SCORED = (*ALL, Q.RELATIVE, Q.QUALITY, Q.SCORES)
ACC = "count(*) AS n, sum(correct)::BIGINT AS n_correct, round(avg(correct), 6) AS hit_rate, round(avg(actual), 6) AS mean_actual, round(avg(probability), 6) AS mean_probability, round(avg(return_error), 6) AS mean_error"

# --- features, J06-J17, F01-F38


@query(Q.query(*SCORED, Q.SIM, select=Q.rounded("date, next_date, n_held, hit", ["portfolio_return", "benchmark_return", "excess_return"], "sim")))
def slice0_top_n_returns(spark, sf_dir):
    """Score, top N, next-period return: the whole path from orders to a simulation."""
    return tidy(simulation(load_panel(spark, sf_dir)))


@query(Q.query(select=Q.rounded("ticker, date", ["adjusted_close", "volume", "monthly_return"], "prices")))
def s04_prices(spark, sf_dir):
    return tidy(load_panel(spark, sf_dir).prices, amounts=Q.AMOUNTS)


@query(Q.query(select=Q.rounded("ticker, fiscal_date, fiscal_period, report_date", ["eps", "roe", "debt_to_equity", "operating_margin"], "funds WHERE report_date <= DATE '1998-06-30' AND fiscal_date >= DATE '1996-01-01'")))
def s08_reports_known_at(spark, sf_dir):
    known = load_panel(spark, sf_dir).fundamentals.where("report_date <= date'1998-06-30' and fiscal_date >= date'1996-01-01'")
    return tidy(known.select("ticker", "fiscal_date", "fiscal_period", "report_date", "eps", "roe", "debt_to_equity", "operating_margin"))


TICKERS = [f"NATION_{k}" for k in range(25)]  # nation has 25 rows by definition of the schema


@query(Q.query(select="SELECT date, " + ", ".join(f"round(max(CASE WHEN ticker = '{t}' THEN monthly_return END), 6) AS {t.lower()}" for t in TICKERS) + " FROM prices WHERE monthly_return IS NOT NULL GROUP BY date"))
def s06_returns_matrix(spark, sf_dir):
    wide = load_panel(spark, sf_dir).prices.where(F.col("monthly_return").isNotNull()).groupBy("date").pivot("ticker", TICKERS).agg(F.first("monthly_return"))
    return tidy(wide.select("date", *[F.col(n).alias(n.lower()) for n in TICKERS]))


@query(Q.query(Q.PRICE, select=Q.rounded("ticker, date", Q.FEATURE_NAMES[:11], "pf")))
def f01_price_features(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return tidy(features.price_features(p.prices, p.benchmark).select("ticker", "date", *features.PRICE_FEATURES))


@query(Q.query(Q.REPORTS, select=Q.rounded("ticker, known_from, n_known, last_report", ["ttm_eps", "ttm_revenue", "ttm_net_income", "ttm_free_cash_flow", "roe", "eps_growth_acceleration", "revenue_growth_acceleration"], "rf", 4)))
def j07_reports_point_in_time(spark, sf_dir):
    made = features.report_features(load_panel(spark, sf_dir).fundamentals)
    return tidy(made.select("ticker", "known_from", "n_known", "last_report", "ttm_eps", "ttm_revenue", "ttm_net_income", "ttm_free_cash_flow", "roe", "eps_growth_acceleration", "revenue_growth_acceleration"), 4)


@query(Q.query(*ALL, select=Q.rounded("feature_date, ticker, sector, staleness_days::INT AS staleness_days", ["adjusted_close", *Q.FEATURE_NAMES], "feat", 5)))
def f13_feature_panel(spark, sf_dir):
    return tidy(panel_features(load_panel(spark, sf_dir)), 5, Q.AMOUNTS)


RELATIVES = ["sector_relative_pe", "sector_relative_ps", "sector_relative_momentum", "sector_relative_fcf_yield", "peer_momentum_zscore", "peer_valuation_zscore"]


@query(Q.query(*ALL, Q.RELATIVE, Q.QUALITY, select=Q.rounded("feature_date, ticker", [*RELATIVES, "data_quality_score"], "dq", 5)))
def f21_sector_relative_quality(spark, sf_dir):
    return tidy(relative(load_panel(spark, sf_dir)).select("feature_date", "ticker", *RELATIVES, "data_quality_score"), 5)


SCALED = Q.FEATURE_NAMES
_win = ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, quantile_cont({c}, 0.99) OVER d), quantile_cont({c}, 0.01) OVER d) END, 6) AS {c}" for c in SCALED)
_std = ", ".join(f"round(CASE WHEN stddev_samp({c}) OVER d > 0 THEN ({c} - avg({c}) OVER d) / stddev_samp({c}) OVER d END, 5) AS {c}" for c in SCALED)
_mm = ", ".join(f"round(CASE WHEN max({c}) OVER d = min({c}) OVER d THEN 0.5::DOUBLE ELSE ({c} - min({c}) OVER d) / (max({c}) OVER d - min({c}) OVER d) END, 6) AS {c}" for c in SCALED)


@query(Q.query(*ALL, select=f"SELECT feature_date, ticker, {_win} FROM feat WINDOW d AS (PARTITION BY feature_date)"))
def f25_winsorized(spark, sf_dir):
    return tidy(features.winsorize(panel_features(load_panel(spark, sf_dir)), SCALED).select("feature_date", "ticker", *SCALED))


@query(Q.query(*ALL, select=f"SELECT feature_date, ticker, {_std} FROM feat WINDOW d AS (PARTITION BY feature_date)"))
def f28_standardized(spark, sf_dir):
    return tidy(features.standardize(panel_features(load_panel(spark, sf_dir)), SCALED).select("feature_date", "ticker", *SCALED), 5)


@query(Q.query(*ALL, select=f"SELECT feature_date, ticker, {_mm} FROM feat WINDOW d AS (PARTITION BY feature_date)"))
def f29_minmax(spark, sf_dir):
    return tidy(features.minmax(panel_features(load_panel(spark, sf_dir)), SCALED).select("feature_date", "ticker", *SCALED))


@query(Q.query(*ALL, select=" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, round(min({c}), 5) AS low, round(quantile_cont({c}, 0.25), 5) AS p25, round(median({c}), 5) AS p50, round(quantile_cont({c}, 0.75), 5) AS p75, round(max({c}), 5) AS high, round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 5) AS pct_missing FROM feat" for c in SCALED)))
def f30_feature_stats(spark, sf_dir):
    return tidy(features.feature_stats(panel_features(load_panel(spark, sf_dir)), SCALED), 5)


@query(Q.query(select="SELECT b.date AS feature_date, s.ticker FROM stocks s CROSS JOIN bench b WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.ticker = s.ticker AND p.date = b.date)"))
def j14_missing_pairs(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    wanted = asof.spine(p.benchmark.select(F.col("date").alias("feature_date")), p.stocks.select("ticker"))
    return features.missing_pairs(wanted, p.prices.withColumnRenamed("date", "feature_date"))


# --- labels, T01-T06


@query(Q.query(Q.TARGETS, select=Q.rounded("feature_date, ticker, target_date, winner", ["stock_return", "benchmark_return", "excess_return"], "tg")))
def t02_targets(spark, sf_dir):
    return tidy(labels(load_panel(spark, sf_dir)))


@query(Q.query(Q.TARGETS, select="SELECT count(*) AS total, count(winner) AS labelled, count(*) - count(winner) AS pending, round(avg(winner), 6) AS winner_rate, round(avg(excess_return), 6) AS mean_excess, round(stddev_samp(excess_return), 6) AS std_excess, round(median(excess_return), 6) AS median_excess, round(min(excess_return), 6) AS min_excess, round(max(excess_return), 6) AS max_excess, count(DISTINCT feature_date) AS n_dates, count(DISTINCT ticker) AS n_tickers FROM tg"))
def t05_target_summary(spark, sf_dir):
    return tidy(targets.target_summary(labels(load_panel(spark, sf_dir))))


@query(Q.query(Q.TARGETS, select="SELECT sector, count(*) AS n, round(avg(winner), 6) AS winner_rate, round(avg(excess_return), 6) AS mean_excess, round(stddev_samp(excess_return), 6) AS std_excess FROM tg JOIN stocks USING (ticker) WHERE winner IS NOT NULL GROUP BY sector"))
def t06_winner_rate_by_sector(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return tidy(targets.winner_rate_by_sector(labels(p), p.stocks))


# --- statistics, C01-C11

IC = (*ALL, Q.TARGETS, Q.LONG, Q.IC)


@query(Q.query(*IC, select="SELECT feature, feature_date, n, round(ic, 6) AS ic FROM ic"))
def c03_monthly_ic(spark, sf_dir):
    return tidy(stats.monthly_ic(long(load_panel(spark, sf_dir))))


@query(Q.query(*IC, select="SELECT feature, count(ic) AS n_months, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS std_ic, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) AS t_stat FROM ic GROUP BY feature HAVING count(ic) >= 12"))
def c04_ic_summary(spark, sf_dir):
    return tidy(stats.ic_summary(stats.monthly_ic(long(load_panel(spark, sf_dir)))))


@query(Q.query(*IC, "ro AS (SELECT feature, CASE WHEN count(ic) OVER w = 36 THEN avg(ic) OVER w END AS r FROM ic WINDOW w AS (PARTITION BY feature ORDER BY feature_date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW))", select="SELECT feature, count(*) AS n_windows, round(avg((r > 0)::INT), 6) AS pct_positive FROM ro WHERE r IS NOT NULL GROUP BY feature"))
def c05_ic_stability(spark, sf_dir):
    return tidy(stats.ic_stability(stats.monthly_ic(long(load_panel(spark, sf_dir)))))


@query(
    Q.query(
        *ALL,
        Q.TARGETS,
        Q.LONG,
        "qn AS (SELECT *, count(*) OVER (PARTITION BY feature, feature_date) AS n FROM lf), qe AS (SELECT *, list_sort(list_distinct(quantile_cont(x, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) OVER (PARTITION BY feature, feature_date))) AS e FROM qn WHERE n >= 10), qb AS (SELECT *, 1 + len(list_filter(e[2:len(e) - 1], lambda v: v < x - abs(x) * 1e-12::DOUBLE)) AS bucket FROM qe), qm AS (SELECT feature, feature_date, bucket, avg(y) AS m, count(*) AS n FROM qb GROUP BY 1, 2, 3), qo AS (SELECT feature, bucket, avg(m) AS mean_return, sum(n)::BIGINT AS n FROM qm GROUP BY 1, 2)",
        select="SELECT feature, bucket::INT AS bucket, round(mean_return, 6) AS mean_return, n, round(mean_return - first(mean_return) OVER (PARTITION BY feature ORDER BY bucket), 6) AS spread FROM qo",
    )
)
def c06_quintiles(spark, sf_dir):
    return tidy(stats.quintiles(long(load_panel(spark, sf_dir))))


@query(Q.query(*ALL, Q.TARGETS, Q.LONG, select="SELECT feature, count(*) AS n, round(corr(x, y), 6) AS r FROM lf GROUP BY feature HAVING count(*) >= 10"))
def c01_pooled_correlation(spark, sf_dir):
    return tidy(stats.pooled(long(load_panel(spark, sf_dir))))


@query(
    "WITH p AS (SELECT n_name AS feature, (n_nationkey + 1) / 200.0::DOUBLE AS p_value FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS k, count(*) OVER () AS m FROM p)"
    " SELECT feature, p_value, round(least(p_value * m, 1), 6) AS bonferroni, round(least(min(p_value * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS bh FROM r"
)
def c07_corrections(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("feature"), ((F.col("n_nationkey") + 1) / 200.0).alias("p_value"))
    return tidy(stats.corrected(p))


@query()
def c09_correlation_report(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    panel = panel_features(p).join(labels(p).select("feature_date", "ticker", "excess_return"), ["feature_date", "ticker"])
    return stats.correlation_report(panel, Q.IC_FEATURES)


# --- models, M01-M29

LF = (*ALL, Q.TARGETS, Q.LONG)
_simple = "fit AS (SELECT feature, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM lf GROUP BY feature HAVING count(*) >= 20), fs AS (SELECT *, sqrt((1 - r2) * syy / (n - 2) / sxx) AS std_error FROM fit)"


@query(Q.query(*LF, _simple, select="SELECT feature, n, round(slope, 6) + 0.0::DOUBLE AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(std_error, 6) AS std_error, round(slope / std_error, 6) AS t_stat, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2, round(r2 * (n - 2) / (1 - r2), 6) AS f_stat, round(slope * sqrt(sxx / syy), 6) AS std_slope FROM fs"))
def m02_simple_regressions(spark, sf_dir):
    return tidy(models.simple_regressions(long(load_panel(spark, sf_dir))).drop("p_value", "ci_low", "ci_high"))


@query(
    Q.query(
        *LF,
        _simple,
        "rs AS (SELECT feature, y - (intercept + slope * x) AS e FROM lf JOIN fit USING (feature)), mo AS (SELECT feature, e, avg(e) OVER (PARTITION BY feature) AS m FROM rs), ag AS (SELECT feature, count(*)::DOUBLE AS n, avg(e) AS mean, stddev_samp(e) AS std, min(e) AS low, max(e) AS high, avg(pow(e - m, 2)) AS m2, avg(pow(e - m, 3)) AS m3, avg(pow(e - m, 4)) AS m4, avg((e > 0)::INT) AS pct_positive FROM mo GROUP BY feature)",
        select="SELECT feature, round(mean, 5) + 0.0::DOUBLE AS mean, round(std, 5) AS std, round(low, 5) AS low, round(high, 5) AS high, round(m3 / pow(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2), 5) AS skew, round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6), 5) AS kurtosis, round(pct_positive, 5) AS pct_positive FROM ag",
    )
)
def m05_residual_stats(spark, sf_dir):
    rows = long(load_panel(spark, sf_dir))
    return tidy(models.residual_stats(models.residuals(rows, models.simple_regressions(rows))), 5).withColumn("mean", F.col("mean") + 0.0)


@query(
    Q.query(
        *LF,
        "dl AS (SELECT feature, feature_date, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM lf GROUP BY 1, 2), rw AS (SELECT feature, feature_date, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy, count(*) OVER w AS k FROM dl WINDOW w AS (PARTITION BY feature ORDER BY feature_date ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING))",
        select="SELECT feature, feature_date, n::BIGINT AS n, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 4) + 0.0::DOUBLE AS slope FROM rw WHERE k = 36 AND n >= 15",
    )
)
def m06_rolling_slopes(spark, sf_dir):
    return tidy(models.rolling_slopes(long(load_panel(spark, sf_dir))), 4)


@query(Q.query(Q.TARGETS, "ds AS (SELECT feature_date, row_number() OVER (ORDER BY feature_date) - 1 < floor(count(*) OVER () * 0.7::DOUBLE) AS is_train FROM (SELECT DISTINCT feature_date FROM tg))", select="SELECT is_train, count(*) AS n, count(winner) AS n_labelled FROM tg JOIN ds USING (feature_date) GROUP BY is_train"))
def m01_time_split(spark, sf_dir):
    return models.time_split(labels(load_panel(spark, sf_dir))).groupBy("is_train").agg(F.count("*").alias("n"), F.count("winner").alias("n_labelled"))


#: The features that models are fitted on together. With those over five years, of which this panel has few, fewer
#: complete rows are left than a fit asks for; m10 selects from all.
MODEL_FEATURES = [c for c in Q.FEATURE_NAMES if not c.startswith("five_year")]


def with_labels(p: Panel) -> DataFrame:
    return panel_features(p).join(labels(p).select("feature_date", "ticker", "excess_return", "winner"), ["feature_date", "ticker"]).where("winner is not null")


def labelled(p: Panel) -> DataFrame:
    return with_labels(p).na.drop(subset=MODEL_FEATURES)


@query()
def m10_vif_selection(spark, sf_dir):
    """Features dropped by variance inflation one by one, complete cases taken anew, and what is left."""
    fit = complete_cases.multiple_regression(with_labels(load_panel(spark, sf_dir)), Q.FEATURE_NAMES)
    rows = [(c, float(v), k) for k, (c, v) in enumerate(fit["dropped"], 1)] + [(c, float(v), None) for c, v in fit["vif_filtered"]]
    return spark.createDataFrame(rows, "feature string, vif double, dropped int")


@query()
def m11_multiple_regression(spark, sf_dir):
    """The fit on what is left, with t tests and intervals, and R² on the later dates."""
    fit = complete_cases.multiple_regression(with_labels(load_panel(spark, sf_dir)), MODEL_FEATURES)["filtered"]
    figures = [F.lit(fit[c] if fit else None).cast("double").alias(c) for c in ("n", "n_test", "r2", "adj_r2", "r2_test", "f_stat", "aic", "bic")]
    return complete_cases.coefficient_table(spark, fit).select("*", *figures)


@query()
def m14_logistic(spark, sf_dir):
    """Features up to an inflation of 20, fitted on the earlier dates, measured on the later ones."""
    frame = with_labels(load_panel(spark, sf_dir))
    with complete_cases.CompleteCases(frame, MODEL_FEATURES, "winner") as cases:
        names, _ = complete_cases.select_by_vif(cases, 20.0)
    split = models.time_split(frame.na.drop(subset=names))
    train = split.where("is_train").select(F.lit(0).alias("_all"), *names, "winner")
    fit = newton.fits(train, names, "winner", [(0, 0)], "_all")[0]
    w = fit.own_scale() if fit else [0.0] * (len(names) + 1)
    test = split.where("not is_train").withColumn("p", 1 / (1 + F.exp(-models.linear(names, w))))
    hit = F.col("p") >= 0.5
    cells = test.agg(*[F.count_if(a & (F.col("winner") == y)).alias(n) for n, a, y in (("tn", ~hit, 0), ("fp", hit, 0), ("fn", ~hit, 1), ("tp", hit, 1))])
    measured = models.classification_metrics(test).crossJoin(F.broadcast(cells))  # one row each
    return measured.select("*", F.lit(len(names)).alias("n_features"), F.lit(fit.n if fit else 0).cast("bigint").alias("n_train"), F.lit(bool(fit and fit.converged)).alias("converged"))


PRED = "pr AS (SELECT probability AS p, winner FROM sn JOIN tg USING (feature_date, ticker) WHERE winner IS NOT NULL)"


def predicted(p: Panel) -> DataFrame:
    return snapshots(p).join(labels(p).where("winner is not null").select("feature_date", "ticker", "winner"), ["feature_date", "ticker"]).withColumnRenamed("probability", "p")


@query(
    Q.query(
        *SCORED,
        SNAP,
        Q.TARGETS,
        PRED,
        "ct AS (SELECT count(*) AS n, count(*) FILTER (p >= 0.5 AND winner = 1) AS tp, count(*) FILTER (p >= 0.5 AND winner = 0) AS fp, count(*) FILTER (p < 0.5 AND winner = 1) AS fn, count(*) FILTER (p < 0.5 AND winner = 0) AS tn, -avg(CASE WHEN winner = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll, avg(pow(winner - p, 2)) AS brier FROM pr), rk2 AS (SELECT winner, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM pr), au AS (SELECT (sum(r) FILTER (winner = 1) - count(*) FILTER (winner = 1) * (count(*) FILTER (winner = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (winner = 1) * count(*) FILTER (winner = 0))::DOUBLE AS auc FROM rk2)",
        select="SELECT n, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(auc, 6) AS auc, round(ll, 6) AS log_loss, round(brier, 6) AS brier FROM ct, au",
    )
)
def m16_classification_metrics(spark, sf_dir):
    return tidy(models.classification_metrics(predicted(load_panel(spark, sf_dir))))


@query(Q.query(*SCORED, SNAP, Q.TARGETS, PRED, "ag AS (SELECT p, count(*) FILTER (winner = 1) AS a, count(*) FILTER (winner = 0) AS b FROM pr GROUP BY p)", select="SELECT round(p, 6) AS threshold, round(sum(b) OVER w / sum(b) OVER (), 6) AS fpr, round(sum(a) OVER w / sum(a) OVER (), 6) AS tpr FROM ag WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def m18_roc_curve(spark, sf_dir):
    return tidy(models.roc_curve(predicted(load_panel(spark, sf_dir))))


# --- scoring, G01-G16, P15-P27

PARTS = ["risk_score", "valuation_score", "momentum_score", "fundamental_score", "data_quality_score", "final_score"]


@query(Q.query(*SCORED, select=Q.rounded("feature_date, ticker", PARTS, "sc", 4)))
def g09_scores(spark, sf_dir):
    return tidy(scoring.scores(relative(load_panel(spark, sf_dir))).select("feature_date", "ticker", *PARTS), 4)


#: The warnings of a row, joined.
WARNED = (
    "array_to_string(list_filter([CASE WHEN {quality} < 40 THEN 'Most inputs are missing: ' || floor({quality} + 0.5)::INT || ' of 100' WHEN {quality} < 60 THEN 'Many inputs are missing: ' || floor({quality} + 0.5)::INT || ' of 100' END, "
    "CASE WHEN {p} IS NULL THEN 'No model gave a probability; one half is assumed' END, CASE WHEN {agree} < 40 THEN 'The models contradict one another: ' || floor({agree} + 0.5)::INT || ' of 100' END, CASE WHEN {risk} < 30 THEN 'Among the riskiest of its date' END], lambda m: m IS NOT NULL), '; ')"
)


@query(
    Q.query(
        *SCORED,
        SNAP,
        select="SELECT feature_date, ticker, CASE WHEN probability >= 0.6::DOUBLE AND predicted_excess >= 0.05::DOUBLE AND risk_score >= 70 AND data_quality_score >= 75 THEN 'Strong candidate' WHEN probability >= 0.5::DOUBLE AND predicted_excess >= 0.02::DOUBLE AND risk_score >= 55 AND data_quality_score >= 60 THEN 'Watchlist candidate' WHEN probability <= 0.4::DOUBLE OR predicted_excess <= -0.1::DOUBLE OR data_quality_score < 40 THEN 'Weak / avoid' ELSE 'Neutral' END AS class, CASE WHEN final_score >= 70 THEN 'Strong candidate' WHEN final_score >= 55 THEN 'Watchlist candidate' WHEN final_score < 35 THEN 'Weak / avoid' ELSE 'Neutral' END AS label, " + WARNED.format(quality="data_quality_score", p="probability", agree="risk_score", risk="risk_score") + " AS warnings FROM sn",
    )
)
def p16_classes(spark, sf_dir):
    s = snapshots(load_panel(spark, sf_dir))
    p, x, risk, dq = (F.col(c) for c in ("probability", "predicted_excess", "risk_score", "data_quality_score"))
    return s.select("feature_date", "ticker", scoring.classify(p, x, risk, dq).alias("class"), scoring.label_of_score(F.col("final_score")).alias("label"), F.array_join(scoring.warnings(dq, p, risk, risk), "; ").alias("warnings"))


@query(
    Q.query(
        *SCORED,
        "fl AS (SELECT feature_date, ticker, data_quality_score, least(momentum_score, fundamental_score, valuation_score) AS w, greatest(1, round_even(count(*) OVER (PARTITION BY feature_date) * 0.3::DOUBLE, 0)::INT) AS n FROM sc)",
        select="SELECT feature_date, ticker, (data_quality_score >= 30 AND row_number() OVER (PARTITION BY feature_date ORDER BY CASE WHEN data_quality_score >= 30 THEN round(w, 6) END DESC NULLS LAST, ticker) <= n)::INT AS flag FROM fl",
    )
)
def g11_agreement_flag(spark, sf_dir):
    s = scoring.scores(relative(load_panel(spark, sf_dir)))
    names = ["momentum_score", "fundamental_score", "valuation_score"]
    return scoring.agreement_flag(s.withColumns({c: F.round(c, 6) for c in names}), names, quality=30.0).select("feature_date", "ticker", "flag")


@query(Q.query("up AS (SELECT ticker, count(*) FILTER (monthly_return > 0) AS k FROM prices GROUP BY 1), rk AS (SELECT ticker, row_number() OVER (ORDER BY md5('1997-05' || ticker), ticker) AS place, k, avg(k) OVER () AS m FROM up)", select="SELECT ticker, place, place > 10 AS substitute FROM rk WHERE k >= m ORDER BY place LIMIT 10"))
def g15_refilled_draw(spark, sf_dir):
    """Ten entities by the month's digests; those that rose in fewer months than the mean fail the check and the next ones take their place."""
    prices = load_panel(spark, sf_dir).prices.groupBy("ticker").agg(F.count_if(F.col("monthly_return") > 0).alias("k"))
    mean = prices.agg(F.avg("k").alias("m"))
    able = prices.crossJoin(F.broadcast(mean)).where("k >= m")  # one row
    return scoring.draw_refilled(prices.select("ticker"), able.select("ticker"), "1997-05", 10)


@query("SELECT n_name AS ticker, md5('1997-05' || n_name) AS digest FROM nation ORDER BY 2, 1 LIMIT 10")
def g15_monthly_draw(spark, sf_dir):
    pool = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("ticker"))
    return scoring.draw(pool, "1997-05", 10).select("ticker", F.md5(F.concat(F.lit("1997-05"), "ticker").cast("binary")).alias("digest"))


# --- evaluation and backtest, B01-B24


@query(Q.query(*SCORED, Q.SIM, select="SELECT date, round(ln(product(1 + portfolio_return) OVER w), 6) AS log_portfolio, round(ln(product(1 + benchmark_return) OVER w), 6) AS log_benchmark, round(ln(product(1 + portfolio_return) OVER w / product(1 + benchmark_return) OVER w), 6) AS log_ratio FROM sim WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def b11_growth(spark, sf_dir):
    grown = backtest.growth(simulation(load_panel(spark, sf_dir)))
    return tidy(grown.select("date", *[F.ln(c).alias(f"log_{c}") for c in ("portfolio", "benchmark", "ratio")]))


SIM_SUMS = "gw AS (SELECT date, product(1 + portfolio_return) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM sim), dd AS (SELECT min(d) AS max_drawdown FROM (SELECT g / max(g) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS d FROM gw)), one AS (SELECT count(*) AS n_months, product(1 + portfolio_return) - 1 AS total_return, product(1 + benchmark_return) - 1 AS benchmark_total_return, pow(product(1 + portfolio_return), 12.0::DOUBLE / count(*)) - 1 AS annual_return, pow(product(1 + benchmark_return), 12.0::DOUBLE / count(*)) - 1 AS benchmark_annual_return, stddev_samp(portfolio_return) * sqrt(12) AS volatility, stddev_samp(CASE WHEN portfolio_return < 0 THEN portfolio_return END) * sqrt(12) AS downside_volatility, pow(product(1 + excess_return), 12.0::DOUBLE / count(*)) - 1 AS annual_excess, stddev_samp(excess_return) * sqrt(12) AS tracking_error, avg((portfolio_return > benchmark_return)::INT) AS hit_rate FROM sim)"
SIM_METRICS = (
    "n_months, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in ("total_return", "benchmark_total_return", "annual_return", "benchmark_annual_return", "volatility", "downside_volatility", "annual_excess", "tracking_error", "hit_rate", "max_drawdown"))
    + ", round(annual_return / volatility, 6) AS sharpe, round(annual_return / downside_volatility, 6) AS sortino, round(annual_excess / tracking_error, 6) AS information_ratio, round(annual_return / nullif(abs(max_drawdown), 0), 6) AS calmar"
)


@query(Q.query(*SCORED, Q.SIM, SIM_SUMS, select=f"SELECT {SIM_METRICS} FROM one, dd"))
def b21_metrics(spark, sf_dir):
    return tidy(backtest.metrics(simulation(load_panel(spark, sf_dir))))


@query(Q.query(*SCORED, Q.SIM, select="SELECT date, round(CASE WHEN count(*) OVER w = 12 THEN (product(1 + portfolio_return) OVER w - 1) / (stddev_samp(portfolio_return) OVER w * sqrt(12)) END, 5) AS rolling_sharpe, round(CASE WHEN count(*) OVER w = 12 THEN avg((portfolio_return > benchmark_return)::INT) OVER w END, 5) AS rolling_hit_rate FROM sim WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"))
def b19_rolling(spark, sf_dir):
    return tidy(backtest.rolling(simulation(load_panel(spark, sf_dir))), 5)


@query(Q.query(*SCORED, Q.SIM, "yr AS (SELECT year(date) AS year, count(*) AS n_months, product(1 + portfolio_return) - 1 AS portfolio, product(1 + benchmark_return) - 1 AS benchmark, sum(hit)::BIGINT AS hits FROM sim GROUP BY 1)", select="SELECT year::INT AS year, n_months, round(portfolio, 6) AS portfolio, round(benchmark, 6) AS benchmark, hits, round(1000 * product(1 + portfolio) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value_of_1000, n_months < 10 AS partial FROM yr"))
def b23_by_year(spark, sf_dir):
    return tidy(backtest.by_year(simulation(load_panel(spark, sf_dir))))


@query(Q.query(*SCORED, Q.SIM, select="SELECT pk.sector, count(*) AS n_picks, round(avg(p.monthly_return), 6) AS mean_return, round(avg((p.monthly_return > b.monthly_return)::INT), 6) AS hit_rate FROM pk JOIN cal c ON pk.feature_date = c.date JOIN prices p ON p.ticker = pk.ticker AND p.date = c.next_date JOIN bench b ON b.date = c.next_date WHERE p.monthly_return IS NOT NULL AND b.monthly_return IS NOT NULL GROUP BY 1"))
def b10_by_sector(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return tidy(backtest.by_sector(picks(p), p.prices, p.benchmark))


@query(Q.query(*SCORED, select="SELECT feature_date, string_agg(ticker, ', ' ORDER BY place) AS tickers FROM pk GROUP BY feature_date"))
def b24_picks_history(spark, sf_dir):
    return backtest.picks_history(picks(load_panel(spark, sf_dir)))


@query(Q.query("ds AS (SELECT date AS d, row_number() OVER (ORDER BY date) - 1 AS i FROM bench)", select="SELECT t.d AS test_date, count(*) AS n_train, min(r.d) AS first_train, max(r.d) AS last_train FROM ds t JOIN ds r ON r.i < t.i AND r.i >= t.i - 36 WHERE t.i >= 24 AND (t.i - 24) % 3 = 0 GROUP BY 1"))
def b06_walk_forward(spark, sf_dir):
    return backtest.walk_forward(load_panel(spark, sf_dir).benchmark.select(F.col("date").alias("feature_date")), 24, 3, 36)


@query(Q.query(*SCORED, SNAP, Q.TARGETS, REAL, select=Q.rounded("feature_date, ticker, bucket, winner_actual, winner_predicted, correct", ["actual", "return_error"], "rz")))
def b01_realized(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return tidy(backtest.realized(snapshots(p), labels(p)).select("feature_date", "ticker", "bucket", "winner_actual", "winner_predicted", "correct", "actual", "return_error"))


@query(Q.query(*SCORED, SNAP, Q.TARGETS, REAL, select=f"SELECT bucket, {ACC} FROM rz GROUP BY bucket"))
def b04_accuracy_by_bucket(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return tidy(backtest.accuracy(backtest.realized(snapshots(p), labels(p)), "bucket"))


@query(Q.query(*SCORED, SNAP, Q.TARGETS, REAL, select=f"SELECT {ACC} FROM rz"))
def b02_accuracy(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return tidy(backtest.accuracy(backtest.realized(snapshots(p), labels(p))))


@query(Q.query(*SCORED, SNAP, Q.TARGETS, REAL, "mm AS (SELECT feature_date, avg(correct) AS monthly FROM rz GROUP BY 1)", select="SELECT feature_date, round(monthly, 6) AS monthly, round(avg(monthly) OVER (ORDER BY feature_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS rolling FROM mm"))
def b05_rolling_hit_rate(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return tidy(backtest.rolling_hit_rate(backtest.realized(snapshots(p), labels(p))))


# --- scalars, readers, sinks, presentation, streams


@query(
    "WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_totalprice AS v FROM orders) SELECT o_orderkey, last_day(d) AS month_end, last_day(d - INTERVAL 6 MONTH) AS half_year_ago, last_day(last_day(d) + INTERVAL 12 MONTH) AS target, ((year(DATE '2001-12-31') * 12 + 12) - (year(d) * 12 + month(d)))::INT AS months_left, 'Q' || quarter(d) AS quarter, CASE WHEN quarter(d) = 4 THEN 90 ELSE 45 END AS lag_days,"
    " round(v / nullif(o_orderkey % 7, 0), 6) AS divided, round((v - 1000) / 1000, 6) AS change, round(CASE WHEN v > 0 THEN pow(v / 1000, 0.2::DOUBLE) - 1 END, 6) AS growth, CASE WHEN v / 1000 <= 500 THEN round(v / 1000, 6) END AS pe, round(least(greatest(v, 5000), 100000), 6) AS clamped, CASE WHEN v / 500000 < 0.4::DOUBLE THEN '< 0.40 (Low)' WHEN v / 500000 < 0.5::DOUBLE THEN '0.40–0.50' WHEN v / 500000 < 0.6::DOUBLE THEN '0.50–0.60' WHEN v / 500000 < 0.7::DOUBLE THEN '0.60–0.70' WHEN v / 500000 < 0.8::DOUBLE THEN '0.70–0.80' ELSE '≥ 0.80 (High)' END AS bucket, strftime(d, '%b %Y') AS label FROM o"
)
def p01_scalars(spark, sf_dir):
    """P01-P03, P05-P15, P29 over every order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))
    d, v = F.col("d"), F.col("v")
    return tidy(
        o.select(
            "o_orderkey",
            F.last_day(d).alias("month_end"),
            S.months_ago(d, 6).alias("half_year_ago"),
            S.target_date(F.last_day(d)).alias("target"),
            S.calendar_months_between(d, F.lit("2001-12-31").cast("date")).alias("months_left"),
            S.quarter_label(d).alias("quarter"),
            S.report_lag_days(d).alias("lag_days"),
            S.safe_divide(v, F.col("o_orderkey") % 7).alias("divided"),
            S.pct_change(v, F.lit(1000.0)).alias("change"),
            S.cagr(F.lit(1000.0), v, 5).alias("growth"),
            S.clip_pe(v / 1000).alias("pe"),
            S.clamp(v, 5000.0, 100000.0).alias("clamped"),
            S.probability_bucket(v / 500000).alias("bucket"),
            F.date_format(d, "MMM yyyy").alias("label"),
        )
    )


@query(
    "WITH d AS (SELECT c_custkey, o_orderdate, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders JOIN customer ON o_custkey = c_custkey) SELECT c_custkey, o_orderdate::DATE AS day, o_totalprice FROM d WHERE k = 1"
)
def s16_latest_per_key(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderdate", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r"))
    return last.join(c, "c_custkey").select("c_custkey", F.to_date("r.o_orderdate").alias("day"), F.col("r.o_totalprice").alias("o_totalprice"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def s21_most_recent(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(500)


@query("SELECT o_orderpriority AS severity, o_orderstatus AS issue_type, count(*) AS n FROM orders GROUP BY 1, 2")
def s22_issue_counts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("severity"), F.col("o_orderstatus").alias("issue_type")).agg(F.count("*").alias("n"))


_batch = "b AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal, 1 AS seq FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_name || '+', c_acctbal + 2, 2 FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT -c_custkey - 1, 'new', 0.0, 3 FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT -c_custkey - 1, 'newer', 1.0, 4 FROM customer WHERE c_custkey % 10 = 0)"


def _customers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A target and a batch in which some keys stand twice; ``seq`` is the order of arrival."""
    target = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")
    changed = lambda every, mark, more, seq: target.where(f"c_custkey % {every} = 0").select("c_custkey", F.concat("c_name", F.lit(mark)).alias("c_name"), (F.col("c_acctbal") + more).alias("c_acctbal"), F.lit(seq).alias("seq"))
    added = lambda every, name, value, seq: target.where(f"c_custkey % {every} = 0").select((-F.col("c_custkey") - 1).alias("c_custkey"), F.lit(name).alias("c_name"), F.lit(value).alias("c_acctbal"), F.lit(seq).alias("seq"))
    return target, changed(3, "*", 1, 1).unionByName(changed(6, "+", 2, 2)).unionByName(added(5, "new", 0.0, 3)).unionByName(added(10, "newer", 1.0, 4))


@query(f"WITH {_batch}, f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY seq) = 1) SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal FROM customer UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 6) FROM f WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def k01_insert_ignore(spark, sf_dir):
    return tidy(insert_ignore(*_customers(spark, sf_dir), ["c_custkey"], "seq"))


@query(f"WITH {_batch}, f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY seq DESC) = 1) SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM b) UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 6) FROM f")
def k02_upsert(spark, sf_dir):
    return tidy(upsert(*_customers(spark, sf_dir), ["c_custkey"], "seq"))


@query(Q.query("f AS (SELECT max(d) AS d FROM (SELECT ticker, min(date) AS d FROM prices GROUP BY 1)), g AS (SELECT ticker, arg_min(adjusted_close, date) AS p0 FROM prices, f WHERE date >= d GROUP BY 1)", select="SELECT p.ticker, p.date, round(100 * adjusted_close / p0, 6) AS rebased FROM prices p JOIN g USING (ticker), f WHERE p.date >= f.d"))
def u13_rebased(spark, sf_dir):
    prices = load_panel(spark, sf_dir).prices.select("ticker", "date", "adjusted_close")
    start = prices.groupBy("ticker").agg(F.min("date").alias("d")).agg(F.max("d").alias("d"))
    since = prices.join(F.broadcast(start), F.col("date") >= F.col("d"))  # one row
    return tidy(since.withColumn("p0", F.first("adjusted_close").over(Window.partitionBy("ticker").orderBy("date"))).select("ticker", "date", (100 * F.col("adjusted_close") / F.col("p0")).alias("rebased")))


@query("WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) / (hi - lo) * 20)::INT + 1, 20) AS bin, count(*) AS n FROM orders, r GROUP BY 1")
def u15_histogram(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_totalprice")
    r = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    at = F.floor((F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20).cast("int") + 1
    return o.crossJoin(F.broadcast(r)).groupBy(F.least(at, F.lit(20)).alias("bin")).agg(F.count("*").alias("n"))  # r: one row


@query(Q.query(*SCORED, select="SELECT feature_date, sector, count(*) AS n, round(avg(final_score), 5) AS mean_score, count(*) FILTER (data_quality_score < 60)::BIGINT AS n_low, count(*) FILTER (data_quality_score >= 90)::BIGINT AS n_high FROM sc GROUP BY 1, 2"))
def u05_sector_overview(spark, sf_dir):
    s = scoring.scores(relative(load_panel(spark, sf_dir)))
    return tidy(s.groupBy("feature_date", "sector").agg(F.count("*").alias("n"), F.avg("final_score").alias("mean_score"), F.count_if(F.col("data_quality_score") < 60).alias("n_low"), F.count_if(F.col("data_quality_score") >= 90).alias("n_high")), 5)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def e01_windowed_events(spark, sf_dir):
    return tidy(windowed(spark.read.parquet(f"{sf_dir}/events.parquet")), 4)


@query("SELECT event_id, key, (props ->> ('$.' || key)) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def p23_json_pairs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
