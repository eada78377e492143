"""Readers, cleaning, model outputs and screens: the registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest, cleaning, features, readers, scoring, stats
from ..functions.scalars import quantile_bucket
from ..sources.store import append_log, backfill, watchlist_changed
from . import panel_sql as Q
from .registry import ALL, IC, REAL, SCORED, SNAP, TICKERS, labels, load_panel, long, panel_features, predicted, query, relative, snapshots, tidy

FROM, TO = "1994-01-31", "1996-12-31"
SOME = ["NATION_3", "NATION_7", "NATION_11"]
_some = ", ".join(f"'{t}'" for t in SOME)
CLASS = "CASE WHEN probability >= 0.6::DOUBLE AND predicted_excess >= 0.05::DOUBLE AND risk_score >= 70 AND data_quality_score >= 75 THEN 'Strong candidate' WHEN probability >= 0.5::DOUBLE AND predicted_excess >= 0.02::DOUBLE AND risk_score >= 55 AND data_quality_score >= 60 THEN 'Watchlist candidate' WHEN probability <= 0.4::DOUBLE OR predicted_excess <= -0.1::DOUBLE OR data_quality_score < 40 THEN 'Weak / avoid' ELSE 'Neutral' END"
CL = f"cl AS (SELECT *, {CLASS} AS class FROM sn)"
CLASSED = (*SCORED, SNAP, CL)


def classed(p):
    s = snapshots(p)
    return s.withColumn("class", scoring.classify(*[F.col(c) for c in ("probability", "predicted_excess", "risk_score", "data_quality_score")]))


@query(Q.query(select="SELECT ticker, sector, shares_outstanding_m FROM stocks WHERE shares_outstanding_m::INT % 2 = 0"))
def s02_active_stocks(spark, sf_dir):
    stocks = load_panel(spark, sf_dir).stocks.withColumn("is_active", 1 - F.col("shares_outstanding_m").cast("int") % 2)
    return readers.active(stocks).drop("is_active").orderBy("ticker")


@query(Q.query(select=f"SELECT date, round(adjusted_close, 4) AS adjusted_close FROM prices WHERE ticker = 'NATION_3' AND date BETWEEN DATE '{FROM}' AND DATE '{TO}'"))
def s05_price_series(spark, sf_dir):
    return tidy(readers.rows_of(load_panel(spark, sf_dir).prices, "date", ["NATION_3"], FROM, TO).select("date", "adjusted_close"), 4)


@query(Q.query(select=f"SELECT date, round(monthly_return, 6) AS monthly_return FROM bench WHERE date >= DATE '{FROM}' AND monthly_return IS NOT NULL"))
def s07_benchmark_returns(spark, sf_dir):
    return tidy(readers.rows_of(load_panel(spark, sf_dir).benchmark, "date", start=FROM).where("monthly_return is not null").select("date", "monthly_return"))


@query(Q.query(*ALL, select=f"SELECT ticker, sector, feature_date, round(return_1m, 6) AS return_1m, round(roe, 6) AS roe FROM feat WHERE feature_date = DATE '{TO}' AND ticker IN ({_some})"))
def s09_features_at(spark, sf_dir):
    """An exact date overrides the range; the sector is carried."""
    return tidy(readers.rows_of(panel_features(load_panel(spark, sf_dir)), "feature_date", SOME, start=FROM, at=TO).select("ticker", "sector", "feature_date", "return_1m", "roe"))


@query(Q.query(select="SELECT DISTINCT date AS feature_date FROM bench"))
def s10_feature_dates(spark, sf_dir):
    return load_panel(spark, sf_dir).benchmark.select(F.col("date").alias("feature_date")).distinct().orderBy("feature_date")


@query(Q.query(Q.TARGETS, select=f"SELECT feature_date, ticker, winner, round(excess_return, 6) AS excess_return FROM tg WHERE winner IS NOT NULL AND feature_date BETWEEN DATE '{FROM}' AND DATE '{TO}'"))
def s13_labelled_targets(spark, sf_dir):
    done = labels(load_panel(spark, sf_dir)).where("winner is not null")
    return tidy(readers.rows_of(done, "feature_date", start=FROM, end=TO).select("feature_date", "ticker", "winner", "excess_return"))


@query(Q.query(*SCORED, SNAP, select=f"SELECT feature_date, ticker, round(final_score, 2) AS final_score FROM sn WHERE ticker IN ({_some})"))
def s15_prediction_snapshots(spark, sf_dir):
    rows = readers.rows_of(snapshots(load_panel(spark, sf_dir)), "feature_date", SOME).select("feature_date", "ticker", "final_score")
    return tidy(readers.newest(rows, "feature_date", "final_score"), 2)


@query(Q.query(*SCORED, SNAP, Q.TARGETS, REAL, select=f"SELECT feature_date, ticker, correct, round(actual, 6) AS actual FROM rz WHERE ticker IN ({_some}) AND feature_date >= DATE '{FROM}'"))
def s17_realized_of(spark, sf_dir):
    """The history of some entities."""
    p = load_panel(spark, sf_dir)
    return tidy(readers.rows_of(backtest.realized(snapshots(p), labels(p)), "feature_date", SOME, start=FROM).select("feature_date", "ticker", "correct", "actual"))


@query("SELECT o_orderkey, o_orderstatus, o_orderdate::DATE AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def s20_latest_run(spark, sf_dir):
    """Logs by time, newest first; the newest alone."""
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderstatus")
    return readers.newest(runs, "day", n=1)


@query("SELECT event_type, max(event_id) AS last_id, max(ts) AS last_ts FROM events GROUP BY 1")
def u17_cache_keys(spark, sf_dir):
    """S23, U17."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.max("event_id").alias("last_id"), F.max("ts").alias("last_ts"))


@query("WITH o AS (SELECT o_custkey, o_totalprice > 200000 AS big FROM orders) SELECT c_custkey, coalesce((SELECT max('Gold') FROM o WHERE o.o_custkey = c_custkey AND big), 'Core') AS category FROM customer")
def k10_backfilled(spark, sf_dir):
    """A correlated update as a join."""
    rich = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), F.lit("Gold").alias("category"))
    target = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.lit(None).cast("string").alias("category"))
    return backfill(target, rich, "c_custkey", "category", "Core").select("c_custkey", "category")


@query("SELECT n_name AS ticker, n_nationkey AS added_at, CASE WHEN n_nationkey % 5 = 2 THEN 'changed' ELSE 'old' END AS note FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 UNION ALL SELECT 'NEW', 100, 'first' UNION ALL SELECT 'NATION_1', 101, 'added'")
def k11_watchlist(spark, sf_dir):
    """Additions by cleaned ticker, removals, changed notes."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("ticker"), F.col("n_nationkey").alias("added_at"))
    added = spark.createDataFrame([(" new ", 100, "first"), ("NEW", 102, "second"), ("nation_1", 101, "added"), ("NATION_2", 103, "there")], "ticker string, added_at int, note string")
    watched = n.where("added_at % 2 = 0").withColumn("note", F.lit("old"))
    removed, notes = n.where("added_at % 3 = 0"), n.where("added_at % 5 = 2").select(F.lower("ticker").alias("ticker"), F.lit("changed").alias("note"))
    return readers.newest(watchlist_changed(watched, added, removed, notes), "added_at")


@query("SELECT n_nationkey AS id, n_name AS ticker, NULL::VARCHAR AS issue FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def k05_quality_log(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("ticker"))
    return append_log(log, spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("issue")))


@query("SELECT o_custkey, month_end FROM (SELECT o_custkey, last, last_day(unnest(generate_series(date_trunc('month', first), last, INTERVAL 1 MONTH)))::DATE AS month_end FROM (SELECT o_custkey, min(o_orderdate::DATE) AS first, max(o_orderdate::DATE) AS last FROM orders GROUP BY 1)) WHERE month_end <= last")
def p09_month_ends(spark, sf_dir):
    """The month ends between each customer's first and last order."""
    day = F.to_date("o_orderdate")
    ends = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return ends.select("o_custkey", F.explode(readers.month_ends(F.col("first"), F.col("last"))).alias("month_end"))


@query("SELECT o_orderkey, (o_orderdate::DATE + 45)::DATE AS later, least(o_orderdate::DATE, DATE '1995-06-30') AS first, greatest(o_orderdate::DATE, DATE '1995-06-30') AS last, try_cast(('1995-' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '-28') AS DATE) IS NOT NULL AS valid FROM orders")
def p11_dates(spark, sf_dir):
    o, mark = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("d")), F.to_date(F.lit("1995-06-30"))
    text = F.concat(F.lit("1995-"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.lit("-28"))
    return o.select("o_orderkey", F.date_add("d", 45).alias("later"), F.least("d", mark).alias("first"), F.greatest("d", mark).alias("last"), readers.valid_date(text).alias("valid"))


@query(Q.query(*IC, select="SELECT feature, feature_date, CASE WHEN round(ic, 9) > 0 THEN 'Positive' ELSE 'Negative' END || ' relationship. ' || CASE WHEN n < 20 THEN 'Not significant after multiple-testing correction' WHEN abs(round(ic, 9)) < 0.02 THEN 'Very weak signal — likely noise' WHEN abs(round(ic, 9)) < 0.05 THEN 'Weak signal — modest value' WHEN abs(round(ic, 9)) < 0.10 THEN 'Moderate signal — worth including' ELSE 'Strong signal — high predictive value' END || '.' AS reading FROM ic"))
def p19_interpreted(spark, sf_dir):
    return stats.monthly_ic(long(load_panel(spark, sf_dir))).select("feature", "feature_date", readers.interpreted(F.round("ic", 9), F.col("n") >= 20).alias("reading"))


@query(Q.query(*CLASSED, select="SELECT feature_date, ticker, round(conf, 4) AS confidence, CASE WHEN conf >= 90 THEN 'high' WHEN conf >= 70 THEN 'solid' WHEN conf >= 50 THEN 'fair' ELSE 'low' END AS tier FROM (SELECT feature_date, ticker, 35 * (final_score >= 55)::INT + CASE class WHEN 'Strong candidate' THEN 25 WHEN 'Watchlist candidate' THEN 10 ELSE 0 END + 15 * least(data_quality_score / 100, 1) + 15 * least(risk_score / 100, 1) + CASE WHEN predicted_excess > 0.10 THEN 10 WHEN predicted_excess > 0.05 THEN 7 WHEN predicted_excess > 0 THEN 3 ELSE 0 END AS conf FROM cl)"))
def p20_research_confidence(spark, sf_dir):
    """P20, P27."""
    s = classed(load_panel(spark, sf_dir))
    score = readers.research_confidence((F.col("final_score") >= 55).cast("int"), F.col("class"), F.col("data_quality_score"), F.col("risk_score"), F.col("predicted_excess"))
    return s.select("feature_date", "ticker", F.round(score, 4).alias("confidence"), readers.confidence_tier(score).alias("tier"))


@query("SELECT event_id, try_cast((props ->> '$.k') AS DOUBLE) AS k, try_cast((props ->> '$.none') AS DOUBLE) AS nothing FROM events")
def p22_json_numbers(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", readers.json_number(F.col("props"), "k").alias("k"), readers.json_number(F.col("props"), "none").alias("nothing"))


SCREEN = "JOIN feat USING (feature_date, ticker)"


@query(Q.query(*CLASSED, select=f"SELECT cl.feature_date, cl.ticker FROM cl JOIN feat f ON f.feature_date = cl.feature_date AND f.ticker = cl.ticker WHERE coalesce(final_score, 0) >= 45 AND (current_pe_ratio IS NULL OR current_pe_ratio <= 60) AND class IN ('Neutral', 'Watchlist candidate', 'Strong candidate') AND cl.sector IN ('ASIA', 'EUROPE', 'REGION_1', 'REGION_2') AND coalesce(data_quality_score, 0) >= 30"))
def p24_screened(spark, sf_dir):
    """P24-P26."""
    p = load_panel(spark, sf_dir)
    rows = classed(p).join(panel_features(p).select("feature_date", "ticker", "current_pe_ratio"), ["feature_date", "ticker"])
    return readers.screened(rows, 45.0, 60.0, ["Neutral", "Watchlist candidate", "Strong candidate"], ["ASIA", "EUROPE", "REGION_1", "REGION_2"], 30.0).select("feature_date", "ticker")


@query(Q.query(*SCORED, SNAP, select="SELECT feature_date, ticker, round(least(greatest(predicted_excess, -0.5), 1.0), 6) AS predicted_excess, round(least(probability, 0.99), 6) AS probability FROM sn"))
def p28_capped(spark, sf_dir):
    return tidy(readers.capped(snapshots(load_panel(spark, sf_dir)).select("feature_date", "ticker", "predicted_excess", "probability")))


#: Sectors of the payout table that the regions stand for; the last region has one that the table lacks.
SECTORS = {"AFRICA": "Consumer Staples", "AMERICA": "Energy", "ASIA": "Financials", "EUROPE": "Technology", "MIDDLE EAST": "Materials"}
_payout = " ".join(f"WHEN '{r}' THEN {readers.PAYOUT.get(s, readers.OTHER_PAYOUT)!r}::DOUBLE" for r, s in SECTORS.items())


@query(Q.query(*ALL, select=f"SELECT feature_date, ticker, round(CASE WHEN ttm_eps > 0 AND adjusted_close > 0 THEN ttm_eps * CASE sector {_payout} END / adjusted_close END, 8) AS dividend_yield FROM sm"))
def p31_dividend_yield(spark, sf_dir):
    """The price over earnings gives the trailing earnings back."""
    f = panel_features(load_panel(spark, sf_dir), carry=["ttm_eps"])
    return tidy(f.select("feature_date", "ticker", readers.dividend_yield(F.create_map(*[F.lit(x) for pair in SECTORS.items() for x in pair])[F.col("sector")], F.col("ttm_eps"), F.col("adjusted_close")).alias("dividend_yield")), 8)


@query(Q.query(select=f"SELECT round(arg_min(adjusted_close, date) FILTER (date >= DATE '{FROM}') * 0 + arg_max(adjusted_close, date) FILTER (date <= DATE '{TO}') / arg_min(adjusted_close, date) FILTER (date >= DATE '{FROM}') - 1, 6) AS total_return FROM bench"))
def j10_benchmark_between(spark, sf_dir):
    return tidy(readers.return_between(load_panel(spark, sf_dir).benchmark, FROM, TO))


DAILY = "d AS (SELECT o_custkey AS ticker, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 13 = 0 THEN -1.0 ELSE o_totalprice END END AS p, o_orderkey % 1000 AS v, o_orderkey FROM orders WHERE o_orderkey % 11 <> 0 OR true), u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY ticker, day ORDER BY o_orderkey) = 1), mo AS (SELECT ticker, last_day(day)::DATE AS date, arg_max(p, day) AS adjusted_close, arg_max(v, day)::DOUBLE AS volume FROM u GROUP BY 1, 2), sp AS (SELECT ticker, last_day(unnest(generate_series(date_trunc('month', min(date))::DATE, date_trunc('month', max(date))::DATE, INTERVAL 1 MONTH)))::DATE AS date FROM mo GROUP BY 1), fu AS (SELECT sp.ticker, sp.date, adjusted_close, volume, last_value(adjusted_close IGNORE NULLS) OVER (PARTITION BY sp.ticker ORDER BY sp.date) AS known FROM sp LEFT JOIN mo USING (ticker, date)), st AS (SELECT ticker, date, adjusted_close, volume, known / nullif(lag(known) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS monthly_return, CASE WHEN adjusted_close IS NULL THEN 'missing' WHEN adjusted_close <= 0 THEN 'suspect' ELSE 'ok' END AS data_quality_flag FROM fu)"


def _daily(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = F.when(F.col("o_orderkey") % 11 != 0, F.when(F.col("o_orderkey") % 13 == 0, -1.0).otherwise(F.col("o_totalprice")))
    rows = o.select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date"), price.alias("adjusted_close"), (F.col("o_orderkey") % 1000).alias("volume"), "o_orderkey")
    return cleaning.standardize_prices(rows.groupBy("ticker", "date").agg(F.min_by(F.struct("adjusted_close", "volume"), "o_orderkey").alias("r")).select("ticker", "date", "r.*"))


@query(f"WITH {DAILY} SELECT ticker, date, round(adjusted_close, 4) AS adjusted_close, volume, round(monthly_return, 6) AS monthly_return, data_quality_flag FROM st")
def f35_standardized_prices(spark, sf_dir):
    """F35, S39, S42, X07."""
    return tidy(_daily(spark, sf_dir).withColumn("adjusted_close", F.round("adjusted_close", 4)))


@query(f"WITH {DAILY} SELECT ticker, count(*) AS n, count(*) FILTER (adjusted_close IS NULL) AS n_missing, count(*) FILTER (adjusted_close <= 0) AS n_not_positive, count(*) FILTER (abs(monthly_return) > 0.8) AS n_extreme, count(date) - count(DISTINCT date) AS n_repeated_dates FROM st GROUP BY 1")
def f37_validated_prices(spark, sf_dir):
    return cleaning.validate_prices(_daily(spark, sf_dir))


@query(Q.query("e AS (SELECT *, count(monthly_return) OVER (PARTITION BY ticker) AS k FROM prices)", select="SELECT date, " + ", ".join(f"round(max(CASE WHEN ticker = '{t}' THEN monthly_return END), 6) AS {t.lower()}" for t in TICKERS) + " FROM e WHERE k >= 12 AND monthly_return IS NOT NULL GROUP BY date"))
def f38_returns_matrix(spark, sf_dir):
    wide = cleaning.returns_matrix(load_panel(spark, sf_dir).prices, TICKERS)
    return tidy(wide.select("date", *[F.col(n).alias(n.lower()) for n in TICKERS]))


_cuts = ", ".join(f"quantile_cont({c}, 0.01) AS {c}_a, quantile_cont({c}, 0.99) AS {c}_b" for c in Q.IC_FEATURES)


@query(Q.query(*ALL, f"ct AS (SELECT {_cuts} FROM feat WHERE feature_date < DATE '1996-01-01')", select="SELECT feature_date, ticker, " + ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, {c}_b), {c}_a) END, 6) AS {c}" for c in Q.IC_FEATURES) + " FROM feat, ct"))
def f34_clipped_to_training(spark, sf_dir):
    made = panel_features(load_panel(spark, sf_dir)).select("feature_date", "ticker", *Q.IC_FEATURES)
    return tidy(cleaning.clipped_to_training(made, Q.IC_FEATURES, "feature_date < date'1996-01-01'"))


@query(Q.query(*IC, select="SELECT feature_date, " + ", ".join(f"round(max(CASE WHEN feature = '{c}' THEN ic END), 6) AS {c}" for c in Q.IC_FEATURES) + " FROM ic GROUP BY 1"))
def c10_ic_heatmap(spark, sf_dir):
    return tidy(readers.ic_heatmap(stats.monthly_ic(long(load_panel(spark, sf_dir))), Q.IC_FEATURES))


@query(Q.query(*IC, select="SELECT feature, feature_date, n, round(ic, 6) AS ic FROM ic WHERE month(feature_date) = 12"))
def c11_december_ic(spark, sf_dir):
    return tidy(stats.monthly_ic(long(load_panel(spark, sf_dir)).where(F.month("feature_date") == 12)))


PR = "pr AS (SELECT feature_date, ticker, probability AS p, winner, predicted_excess, excess_return FROM sn JOIN tg USING (feature_date, ticker) WHERE winner IS NOT NULL)"


def _buckets(q: int) -> str:
    cuts = ", ".join(f"{i / q!r}" for i in range(q + 1))
    return f"pe AS (SELECT list_distinct(quantile_cont(p, [{cuts}])) AS e FROM pr), pb AS (SELECT pr.*, 1 + len(list_filter(list_sort(e)[2:len(e) - 1], lambda v: v < p - abs(p) * 1e-12::DOUBLE)) AS bucket FROM pr, pe)"


@query(Q.query(*SCORED, SNAP, Q.TARGETS, PR, _buckets(10), select="SELECT bucket::INT AS bucket, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(winner), 6) AS win_rate, round(abs(avg(p) - avg(winner)), 6) AS gap FROM pb GROUP BY 1"))
def m17_calibration(spark, sf_dir):
    rows = predicted(load_panel(spark, sf_dir)).withColumn("bucket", quantile_bucket(F.col("p"), 10))
    return tidy(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("winner").alias("win_rate"), F.abs(F.avg("p") - F.avg("winner")).alias("gap")))


@query(Q.query(*SCORED, SNAP, Q.TARGETS, PR, _buckets(5), select="SELECT bucket::INT AS bucket, count(*) AS n, round(avg(winner), 6) AS win_rate FROM pb GROUP BY 1"))
def m28_win_rate_by_quintile(spark, sf_dir):
    rows = predicted(load_panel(spark, sf_dir)).withColumn("bucket", quantile_bucket(F.col("p"), 5))
    return tidy(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("winner").alias("win_rate")))


@query(Q.query(*SCORED, SNAP, Q.TARGETS, PR, "er AS (SELECT *, excess_return - predicted_excess AS e, avg(excess_return) OVER () AS m FROM pr)", select="SELECT count(*) AS n, round(1 - sum(e * e) / sum((excess_return - m) * (excess_return - m)), 6) AS r2, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg((sign(predicted_excess) = sign(excess_return))::INT), 6) AS hit_rate FROM er"))
def m24_regression_metrics(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    rows = snapshots(p).join(labels(p).where("winner is not null").select("feature_date", "ticker", "excess_return"), ["feature_date", "ticker"])
    y, e = F.col("excess_return"), F.col("excess_return") - F.col("predicted_excess")
    total = F.var_pop(y) * F.count(y)
    return tidy(rows.agg(F.count("*").alias("n"), (1 - F.sum(e * e) / total).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((F.signum("predicted_excess") == F.signum("excess_return")).cast("int")).alias("hit_rate")))


@query(Q.query(*CLASSED, Q.TARGETS, REAL, select="SELECT class, count(*) AS n, round(avg(correct), 6) AS hit_rate, round(avg(winner_actual), 6) AS winner_rate, round(avg(actual), 6) AS mean_actual, round(avg(rz.probability), 6) AS mean_probability, round(avg(rz.final_score), 6) AS mean_score FROM rz LEFT JOIN (SELECT feature_date, ticker, class FROM cl) USING (feature_date, ticker) GROUP BY class"))
def b03_accuracy_by_class(spark, sf_dir):
    p = load_panel(spark, sf_dir)
    return tidy(readers.accuracy_by_class(backtest.realized(snapshots(p), labels(p)), classed(p).select("feature_date", "ticker", "class")))


@query(Q.query(*ALL, select="SELECT ticker, " + ", ".join(f"round(arg_max({c}, feature_date), 5) AS {c}" for c in Q.IC_FEATURES) + " FROM feat GROUP BY ticker"))
def u01_last_known(spark, sf_dir):
    """U01, U02."""
    return tidy(readers.last_known(panel_features(load_panel(spark, sf_dir)), "ticker", "feature_date", Q.IC_FEATURES), 5)


@query(Q.query(*CLASSED, select="SELECT feature_date, class, count(*) AS n, round(avg(final_score), 7) AS mean_score, round(max(final_score), 7) AS best, CASE class WHEN 'Strong candidate' THEN 0 WHEN 'Watchlist candidate' THEN 1 WHEN 'Weak / avoid' THEN 3 ELSE 2 END AS place FROM cl GROUP BY feature_date, class"))
def u06_classes_by_date(spark, sf_dir):
    """U03, U04, U06, U07."""
    s = classed(load_panel(spark, sf_dir)).groupBy("feature_date", "class").agg(F.count("*").alias("n"), F.avg("final_score").alias("mean_score"), F.max("final_score").alias("best"))
    return tidy(s.withColumn("place", readers.class_rank(F.col("class"))).orderBy("feature_date", "place"), 7)


@query(Q.query(*CLASSED, select="SELECT count(*) AS n, count(DISTINCT feature_date) AS n_dates, count(DISTINCT ticker) AS n_tickers, count(*) FILTER (class = 'Strong candidate') AS n_strong, max(feature_date) AS last_date FROM cl"))
def u08_archive_header(spark, sf_dir):
    s = classed(load_panel(spark, sf_dir))
    return s.agg(F.count("*").alias("n"), F.count_distinct("feature_date").alias("n_dates"), F.count_distinct("ticker").alias("n_tickers"), F.count_if(F.col("class") == "Strong candidate").alias("n_strong"), F.max("feature_date").alias("last_date"))


@query(Q.query(*ALL, select="SELECT ticker, feature_date, (" + " + ".join(f"({c} IS NULL)::INT" for c in Q.FEATURE_NAMES) + ") AS n_missing FROM feat"))
def u09_missing_features(spark, sf_dir):
    return readers.missing_counts(panel_features(load_panel(spark, sf_dir)), Q.FEATURE_NAMES)


@query(Q.query(*ALL, select=" UNION ALL ".join(f"SELECT ticker, '{c}' AS feature, {c} IS NOT NULL AS there FROM feat WHERE feature_date = DATE '{TO}'" for c in Q.FEATURE_NAMES)))
def u10_availability(spark, sf_dir):
    return readers.availability(readers.rows_of(panel_features(load_panel(spark, sf_dir)), "feature_date", at=TO), Q.FEATURE_NAMES)


@query(Q.query(*SCORED, SNAP, select=f"SELECT ticker, round(probability, 4) AS probability FROM (SELECT * FROM sn WHERE feature_date = DATE '{TO}' ORDER BY final_score DESC, ticker LIMIT 5) UNION ALL SELECT 'CUSTOM', 0.515"))
def u14_top_and_custom(spark, sf_dir):
    """The best of a date, joined by a row of one's own."""
    s = readers.rows_of(snapshots(load_panel(spark, sf_dir)), "feature_date", at=TO)
    top = s.orderBy(F.col("final_score").desc(), "ticker").limit(5).select("ticker", "probability")
    own = spark.createDataFrame([("CUSTOM", 0.515)], "ticker string, probability double")
    return tidy(top.unionByName(own), 4).orderBy(F.col("probability").desc(), "ticker")


@query("SELECT r_name AS sector, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def g16_pool_summary(spark, sf_dir):
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("sector")).agg(F.count("*").alias("n"))  # five regions
