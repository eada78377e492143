"""Fitted models, scores with predictions, snapshots, backfill: the registered queries and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, fitted, models, newton, scoring, signals, stats, targets
from . import panel_sql as Q
from .registry import ALL, LF, MODEL_FEATURES, SCORED, SNAP, WARNED, _simple, labelled, labels, load_panel, long, panel_features, query, relative, snapshots, tidy
from .screens import FROM, SOME

_some = ", ".join(f"'{t}'" for t in SOME)
FIVE = ["current_pe_ratio", "five_year_eps_growth", "five_year_revenue_growth", "five_year_price_gain", "twelve_month_momentum"]
_filled = " UNION ALL ".join(f"SELECT feature_date, ticker, '{c}' AS feature, coalesce({c}, median({c}) OVER (PARTITION BY feature_date), 0.0::DOUBLE) AS x FROM feat" for c in FIVE)


@query(Q.query(*LF, _simple, f"fx AS ({_filled})", select="SELECT feature_date, ticker, feature, round(intercept + slope * x, 5) AS prediction FROM fx JOIN fit USING (feature)"))
def m08_applied_fits(spark, sf_dir):
    """Five one-variable fits, applied with the date's median for missing values."""
    p = load_panel(spark, sf_dir)
    fits = models.simple_regressions(long(p).where(F.col("feature").isin(FIVE)))
    return tidy(models.apply_simple(panel_features(p), fits, FIVE), 5)


@query(
    Q.query(
        *LF,
        _simple,
        "rt AS (SELECT feature, slope AS ridge_coef FROM fs WHERE feature <> 'roe'), lt AS (SELECT feature, CASE WHEN abs(slope / std_error) >= 2 THEN slope ELSE 0.0::DOUBLE END AS lasso_coef, abs(slope / std_error) >= 2 AS selected FROM fs WHERE feature <> 'beta'), bo AS (SELECT coalesce(rt.feature, lt.feature) AS feature, ridge_coef, coalesce(lasso_coef, 0.0::DOUBLE) AS lasso_coef, coalesce(selected, false) AS selected FROM rt FULL JOIN lt ON rt.feature = lt.feature)",
        select="SELECT feature, round(ridge_coef, 6) + 0.0::DOUBLE AS ridge_coef, round(lasso_coef, 6) + 0.0::DOUBLE AS lasso_coef, selected, CASE WHEN lasso_coef = 0 THEN 'Lasso zeroed' WHEN ridge_coef > 0 AND lasso_coef > 0 THEN 'Both positive' WHEN ridge_coef < 0 AND lasso_coef < 0 THEN 'Both negative' ELSE 'Sign disagree' END AS agreement FROM bo",
    )
)
def m25_comparison(spark, sf_dir):
    """Two coefficient tables with different features, joined in full."""
    fits = models.simple_regressions(long(load_panel(spark, sf_dir)))
    clear = F.abs(F.col("t_stat")) >= 2
    second = fits.where("feature != 'beta'").select("feature", F.when(clear, F.col("slope")).otherwise(0.0).alias("coefficient"), clear.alias("selected"))
    first = fits.where("feature != 'roe'").select("feature", F.col("slope").alias("coefficient"))
    return tidy(fitted.compared(first, second)).withColumns({c: F.col(c) + 0.0 for c in ("ridge_coef", "lasso_coef")})


@query()
def m12_actual_vs_predicted(spark, sf_dir):
    return tidy(fitted.actual_vs_predicted(labelled(load_panel(spark, sf_dir)), MODEL_FEATURES))


@query()
def m13_rolling_r_squared(spark, sf_dir):
    return spark.createDataFrame(fitted.rolling_r_squared(labelled(load_panel(spark, sf_dir)), MODEL_FEATURES), "feature_date date, n bigint, r2 double, adj_r2 double")


@query()
def m15_logit_table(spark, sf_dir):
    table, _ = fitted.logit_table(labelled(load_panel(spark, sf_dir)), MODEL_FEATURES)
    return spark.createDataFrame(table, "term string, coefficient double, std_error double, z double, p_value double, low double, high double, odds_ratio double")


@query()
def m15_logit_figures(spark, sf_dir):
    """Log-likelihood, pseudo R², AIC and BIC of that fit, and whether it converged."""
    _, f = fitted.logit_table(labelled(load_panel(spark, sf_dir)), MODEL_FEATURES)
    names = ("log_likelihood", "null_log_likelihood", "pseudo_r2", "aic", "bic")
    return spark.createDataFrame([(f["n"], *[f.get(c) for c in names], f["converged"])], "n bigint, " + ", ".join(f"{c} double" for c in names) + ", converged boolean")


@query()
def m21_rolling_auc(spark, sf_dir):
    return newton.rolling_auc(labelled(load_panel(spark, sf_dir)), MODEL_FEATURES)


@query()
def m26_lasso_path(spark, sf_dir):
    return spark.createDataFrame(fitted.lasso_path(labelled(load_panel(spark, sf_dir)), MODEL_FEATURES), "penalty double, feature string, coefficient double")


@query(
    Q.query(
        *SCORED,
        "mp AS (SELECT feature_date, ticker, final_score / 100 AS p, coalesce(twelve_month_momentum, 0.0::DOUBLE) / 4 AS x, six_month_momentum AS l FROM sc)",
        select=f"SELECT feature_date, ticker, round(least(greatest(p * 100, 0.0::DOUBLE), 100.0::DOUBLE), 4) AS probability_score, round({Q.score('x')}, 4) AS excess_score, round(((p >= 0.5)::INT + (x >= 0)::INT + coalesce((l >= 0)::INT, 0)) * 100.0::DOUBLE / 3, 4) AS agreement_score FROM mp",
    )
)
def g02_model_scores(spark, sf_dir):
    """Components from predictions of three models (here simple rules)."""
    p = load_panel(spark, sf_dir)
    third = panel_features(p).select("feature_date", "ticker", F.col("six_month_momentum").alias("third"))
    rows = snapshots(p).select("feature_date", "ticker", "data_quality_score", "probability", "predicted_excess").join(third, ["feature_date", "ticker"])
    made = scoring.scores(rows, "probability", "predicted_excess", ("probability", "predicted_excess", "third"))
    return tidy(made.select("feature_date", "ticker", "probability_score", "excess_score", "agreement_score"), 4)


@query()
def g10_scored_by_models(spark, sf_dir):
    """Models fitted on labels that had elapsed at the last date of the panel score that date."""
    p = load_panel(spark, sf_dir)
    made, last = relative(p), p.benchmark.agg(F.max("date").alias("last"))
    known = labels(p).crossJoin(F.broadcast(last)).where("target_date <= last and winner is not null").select("feature_date", "ticker", "excess_return", "winner")  # one row
    train = made.join(known, ["feature_date", "ticker"])
    now = made.crossJoin(F.broadcast(last)).where("feature_date = last").drop("last")
    s = fitted.scored_by_models(now, train, MODEL_FEATURES)
    return tidy(s.select("feature_date", "ticker", "probability", "ridge_prediction", "lasso_prediction", "probability_score", "excess_score", "agreement_score", "final_score", "class", "label"))


FROZEN = Q.FEATURE_NAMES
_frozen = ", ".join(f"round({c}, 6) AS {c}, round(CASE WHEN stddev_samp({c}) OVER d > 0 THEN ({c} - avg({c}) OVER d) / stddev_samp({c}) OVER d END, 5) AS z_{c}" for c in FROZEN)
_n_frozen = " + ".join(f"({c} IS NOT NULL)::INT" for c in FROZEN)
_warned = WARNED.format(quality="data_quality_score", p="NULL::DOUBLE", agree="agreement_score", risk="risk_score")


@query(Q.query(*SCORED, select=f"SELECT feature_date, ticker, {_frozen}, ({_n_frozen})::INT AS n_features, {_warned} AS warnings, round(final_score, 2) AS final_score FROM sc WINDOW d AS (PARTITION BY feature_date)"))
def k12_snapshot_records(spark, sf_dir):
    """Frozen features and standardised features read back from their JSON, with the warnings."""
    s = scoring.scores(relative(load_panel(spark, sf_dir))).withColumn("probability", F.lit(None).cast("double"))
    records = fitted.snapshot_records(s, FROZEN, "v1")
    read = lambda c, of: F.get_json_object(of, f"$.{c}").cast("double")
    values = [x for c in FROZEN for x in (F.round(read(c, "features_json"), 6).alias(c), F.round(read(c, "standardized_json"), 5).alias(f"z_{c}"))]
    return records.select("feature_date", "ticker", *values, F.size(F.json_object_keys("features_json")).alias("n_features"), F.array_join("warnings", "; ").alias("warnings"), F.round("final_score", 2).alias("final_score"))


@query(Q.query(*ALL, Q.RELATIVE, select=f"SELECT feature_date, ticker, round(sector_relative_momentum, 6) AS sector_relative_momentum, round(peer_momentum_zscore, 6) AS peer_momentum_zscore FROM rel WHERE feature_date >= DATE '{FROM}' AND ticker IN ({_some})"))
def f32_backfill(spark, sf_dir):
    panel = panel_features(load_panel(spark, sf_dir))
    stored = panel.where((F.col("feature_date") >= F.lit(FROM).cast("date")) & ~F.col("ticker").isin(SOME)).select("feature_date", "ticker")
    return tidy(fitted.backfilled(panel, stored).select("feature_date", "ticker", "sector_relative_momentum", "peer_momentum_zscore"))


@query()
def m22_regularised(spark, sf_dir):
    """Fifty penalties, five forward-chained folds of rows."""
    train = models.time_split(labelled(load_panel(spark, sf_dir))).where("is_train")
    rows = []
    for name, fit in (("ridge", fitted.ridge_of), ("lasso", fitted.lasso_of)):
        alpha, w, _ = fit(train, MODEL_FEATURES)
        rows += [(name, alpha, c, float(v)) for c, v in zip(["intercept", *MODEL_FEATURES], w, strict=True)]
    return spark.createDataFrame(rows, "model string, alpha double, term string, coefficient double")



# --- M02, P21, M29


@query()
def m02_inference(spark, sf_dir):
    """P-values, 95% intervals and R² on the later dates of the one-variable fits."""
    rows = long(load_panel(spark, sf_dir))
    fits = models.simple_regressions(rows).join(models.held_out_r_squared(rows), "feature", "left")
    return tidy(fits.select("feature", "n", "slope", "p_value", "ci_low", "ci_high", "r2", "r2_test", (F.col("p_value") < 0.05).alias("significant")))


_halves = "hd AS (SELECT feature, feature_date, row_number() OVER (PARTITION BY feature ORDER BY feature_date) - 1 < floor(count(*) OVER (PARTITION BY feature) * 0.7::DOUBLE) AS tr FROM (SELECT DISTINCT feature, feature_date FROM lf)), hl AS (SELECT lf.*, tr FROM lf JOIN hd USING (feature, feature_date)), hf AS (SELECT feature, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM hl WHERE tr GROUP BY 1 HAVING count(*) >= 20), ht AS (SELECT feature, avg(y) AS m, count(*) AS n_test FROM hl WHERE NOT tr GROUP BY 1 HAVING count(*) >= 10)"


@query(Q.query(*LF, _halves, select="SELECT feature, any_value(n_test) AS n_test, round(1 - sum(pow(y - a - b * x, 2)) / sum(pow(y - m, 2)), 5) AS r2_test FROM hl JOIN hf USING (feature) JOIN ht USING (feature) WHERE NOT tr GROUP BY feature"))
def m02_held_out(spark, sf_dir):
    """R² of the later dates by fits on the earlier ones, from sums by date."""
    rows = long(load_panel(spark, sf_dir))
    w = Window.partitionBy("feature")
    days = rows.select("feature", "feature_date").distinct().withColumn("test", F.row_number().over(w.orderBy("feature_date")) - 1 >= F.floor(F.count("*").over(w) * 0.7))
    n = rows.join(days.where("test"), ["feature", "feature_date"]).groupBy("feature").agg(F.count("*").alias("n_test"))
    return tidy(models.held_out_r_squared(rows).join(n, "feature").select("feature", "n_test", "r2_test"), 5)


SHOWN = [c for c in (*Q.FEATURE_NAMES, "sector_relative_pe", "sector_relative_momentum", "peer_momentum_zscore", "peer_valuation_zscore")]
_rules = ", ".join("('{}', {}, [{}], [{}])".format(f, str(side == signals.ABOVE).lower(), ", ".join(f"{b!r}::DOUBLE" for b in bounds), ", ".join(f"'{x}'" for x in texts)) for f, (side, bounds, texts) in signals.RULES.items())


@query(
    Q.query(
        *ALL,
        Q.RELATIVE,
        f"sg AS (SELECT * FROM (VALUES {_rules}) t(f, above, bounds, labels))",
        "sv AS (" + " UNION ALL ".join(f"SELECT feature_date, ticker, '{c}' AS feature, {c} AS value FROM rel" for c in SHOWN) + ")",
        select="SELECT feature_date, ticker, feature, CASE WHEN value IS NULL OR f IS NULL OR isnan(value) OR isinf(value) THEN '—' ELSE labels[1 + len(list_filter(bounds, lambda b: CASE WHEN above THEN b >= value ELSE b <= value END))] END AS signal FROM sv LEFT JOIN sg ON f = feature",
    )
)
def p21_signals(spark, sf_dir):
    """The verdict on every feature of every entity and date."""
    rows = relative(load_panel(spark, sf_dir)).select("feature_date", "ticker", *SHOWN).unpivot(["feature_date", "ticker"], SHOWN, "feature", "value")
    return signals.signalled(rows, signals.rule_table(spark)).drop("value")


@query()
def m29_model_comparison(spark, sf_dir):
    """OLS, ridge and lasso side by side on the earlier and the later dates."""
    table, _ = fitted.model_comparison(labelled(load_panel(spark, sf_dir)), MODEL_FEATURES)
    return spark.createDataFrame(table, "model string, penalty double, n_train bigint, n_test bigint, r2_train double, r2_test double, rmse_train double, rmse_test double, gap double, n_used int")


@query()
def m25_ridge_and_lasso(spark, sf_dir):
    """The coefficients of both penalised fits side by side."""
    _, pairs = fitted.model_comparison(labelled(load_panel(spark, sf_dir)), MODEL_FEATURES)
    both = spark.createDataFrame(pairs, "feature string, r double, c double")
    return fitted.compared(both.select("feature", F.col("r").alias("coefficient")), both.select("feature", F.col("c").alias("coefficient"), (F.col("c") != 0).alias("selected")))


# --- what was reached by no query


@query(Q.query(Q.TARGETS, select="SELECT feature_date, ticker, target_date, CASE WHEN target_date <= m THEN round(stock_return, 6) END AS stock_return, CASE WHEN target_date <= m THEN round(benchmark_return, 6) END AS benchmark_return, CASE WHEN target_date <= m THEN winner END AS winner FROM tg, (SELECT max(date) AS m FROM bench)"))
def t04_filled_labels(spark, sf_dir):
    """Labels known at the end of 1997, filled with those that have elapsed by the last date."""
    p = load_panel(spark, sf_dir)
    keys = asof.spine(p.benchmark.select(F.col("date").alias("feature_date")), p.stocks.select("ticker"))
    last = p.benchmark.agg(F.max("date")).first()[0]
    then, now = (targets.targets(keys, p.prices, p.benchmark, as_of=d) for d in (dt.date(1997, 12, 31), last))
    return tidy(targets.fill_elapsed(then, now).select("feature_date", "ticker", "target_date", "stock_return", "benchmark_return", "winner"))


@query(Q.query(select="SELECT day, (SELECT min(date) FROM bench WHERE date > day) AS date FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)"))
def j12_first_after(spark, sf_dir):
    """The first benchmark date strictly after each day."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("day"))
    return asof.first_after(load_panel(spark, sf_dir).benchmark.select("date"), days, "date", "day")


@query(Q.query(*LF, Q.IC, select="SELECT feature, feature_date, round(CASE WHEN count(ic) OVER w = 36 THEN avg(ic) OVER w END, 6) AS rolling_ic FROM ic WINDOW w AS (PARTITION BY feature ORDER BY feature_date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)"))
def u18_rolling_ic(spark, sf_dir):
    """Mean information coefficient of the last 36 months."""
    return tidy(stats.rolling_ic(stats.monthly_ic(long(load_panel(spark, sf_dir)))))


@query(Q.query(*SCORED, SNAP, select="SELECT feature_date, ticker, (probability >= 0.5 AND predicted_excess >= 0 AND risk_score >= 60 AND data_quality_score >= 60)::INT AS flag FROM sn"))
def g12_flag_by_models(spark, sf_dir):
    """The agreement flag where no one-variable fits are at hand."""
    s = snapshots(load_panel(spark, sf_dir))
    return s.select("feature_date", "ticker", scoring.flag_by_models(*[F.col(c) for c in ("probability", "predicted_excess", "risk_score", "data_quality_score")]).alias("flag"))
