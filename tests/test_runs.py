"""Stored runs, outside entities, walk-forward refits and merges in time against plain Python."""

import datetime as dt
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, features, fitted, model_table, models, outside, refits, runs, scoring
from tidemark.sources.panel import Panel, with_returns
from tidemark.sources.store import TableStore


def end(k):
    y, m = divmod(k + 1, 12)
    return dt.date(2010 + y, m + 1, 1) - dt.timedelta(days=1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(11)
    names = [f"T{k}" for k in range(9)]
    stocks = spark.createDataFrame([(t, "AB"[k % 2], 10.0 + k) for k, t in enumerate(names)], "ticker string, sector string, shares_outstanding_m double")
    prices = [(t, end(k), 50 + 10 * rng.random() + k * (j - 4) * 0.1, 100.0 * rng.random()) for j, t in enumerate(names) for k in range(44) if (j, k) != (3, 20)]
    bench = [(end(k), 100 + 5 * rng.random()) for k in range(44)]
    reports = []
    for t in names:
        for q in range(14):
            fiscal = end(3 * q + 2)
            reports.append((t, fiscal, f"Q{q % 4 + 1}", fiscal + dt.timedelta(days=45), 100 * rng.random(), 5 * rng.random() - 0.5, rng.random(), 1 + rng.random(), rng.random(), rng.random(), rng.random(), rng.random(), rng.random()))
    p = with_returns(spark.createDataFrame(prices, "ticker string, date date, adjusted_close double, volume double"), "ticker").persist()
    b = with_returns(spark.createDataFrame(bench, "date date, adjusted_close double").withColumn("benchmark_ticker", F.lit("ALL")), "benchmark_ticker").persist()
    f = spark.createDataFrame(reports, "ticker string, fiscal_date date, fiscal_period string, report_date date, revenue double, eps double, net_income double, equity double, total_debt double, free_cash_flow double, roe double, debt_to_equity double, operating_margin double").persist()
    return Panel({"stocks": lambda: stocks, "prices": lambda: p, "benchmark": lambda: b, "fundamentals": lambda: f})


NAMES = ["twelve_month_momentum", "return_1m", "volatility_3m", "current_pe_ratio"]


def relative(panel, stocks):
    made = features.sector_relative(features.feature_panel(stocks, panel.prices, panel.benchmark, panel.fundamentals))
    return made.withColumn("data_quality_score", features.quality_score(made))


def as_rows(df, names):
    return {(r.feature_date, r.ticker): [None if r[c] is None else round(r[c], 7) if isinstance(r[c], float) else r[c] for c in names] for r in df.collect()}


def test_an_outside_entity_is_scored_as_within_the_universe_and_nothing_is_fitted(spark, panel, tmp_path, monkeypatch):
    store, own = TableStore(spark, str(tmp_path)), "T4"
    universe = relative(panel, panel.stocks.where(F.col("ticker") != own))
    rng = F.hash("ticker", "feature_date") % 100 / 100.0
    train = universe.withColumns({"excess_return": rng, "winner": (rng > 0).cast("int")})
    scored = runs.save_universe(store, universe, train, NAMES, "v")
    w = runs.read_models(store, "v")
    assert {"ridge", "lasso", "logit", "fill", "low", "high"} <= set(w) and len(w["ridge"]) == 5
    whole, used = model_table.predicted(relative(panel, panel.stocks), w)
    want = scoring.scores(whole, **used).where(F.col("ticker") == own)
    beaten = {}
    for r in scored.collect():
        beaten.setdefault(r.feature_date, []).append(r.final_score)

    def refuse(*_, **__):
        raise AssertionError("a fit ran")

    for module, names in ((model_table, ["fit"]), (models, ["logistic", "simple_regressions", "gram"]), (fitted, ["ridge_of", "lasso_of", "penalised"]), (scoring, ["scores"])):
        for name in names:
            monkeypatch.setattr(module, name, refuse)
    mine = lambda df: df.where(F.col("ticker") == own)
    rows = features.feature_panel(mine(panel.stocks), mine(panel.prices), panel.benchmark, mine(panel.fundamentals))
    got = runs.score_outside(store, rows, "v")
    names = ["sector_relative_pe", "sector_relative_fcf_yield", "peer_momentum_zscore", "peer_valuation_zscore", "probability", "ridge", "lasso", "weakest", "probability_score", "excess_score", "agreement_score", "risk_score", "valuation_score", "momentum_score", "fundamental_score", "final_score"]
    found = as_rows(got, names)
    wanted = as_rows(want, names)
    assert [(k, n, a, b) for k, row in found.items() for n, a, b in zip(names, row, wanted[k], strict=True) if a != b] == []
    assert len(found) == len(wanted) == 44
    for r in got.collect():
        assert r.rank == 1 + sum(s >= r.final_score for s in beaten[r.feature_date]) and r.percentile == pytest.approx(r["rank"] / 9)


def test_a_line_through_few_rows_is_fitted_where_the_caller_asks_for_it(spark, panel, tmp_path):
    universe = relative(panel, panel.stocks)
    y = F.hash("ticker", "feature_date") % 100 / 100.0
    train = universe.withColumns({"excess_return": y, "winner": (y > 0).cast("int")})
    few = [tuple(r) for r in train.where("current_pe_ratio is not null").orderBy("feature_date", "ticker").select("feature_date", "ticker").limit(4).collect()]
    kept = [(F.col("feature_date") == d) & (F.col("ticker") == t) for d, t in few]
    train = train.withColumn("current_pe_ratio", F.when(kept[0] | kept[1] | kept[2] | kept[3], F.col("current_pe_ratio"))).withColumn("five_year_price_gain", F.lit(1.0)).persist()
    points = np.array([(r[0], r[1]) for r in train.where("current_pe_ratio is not null").select("current_pe_ratio", "excess_return").collect()])
    assert len(points) == 4
    store = TableStore(spark, str(tmp_path))
    runs.save_universe(store, universe, train, NAMES, "two", full=False, least=2)
    w = runs.read_models(store, "two")
    slope, intercept = np.polyfit(points[:, 0], points[:, 1], 1)
    assert w["ols_current_pe_ratio"] == {"intercept": pytest.approx(intercept), "current_pe_ratio": pytest.approx(slope)}
    assert "ols_five_year_price_gain" not in w  # one value settles no line
    plain = model_table.weights(model_table.fit(train, NAMES, full=False))
    assert "ols_current_pe_ratio" not in plain and "ols_twelve_month_momentum" in plain
    train.unpersist()


def test_ladders_place_values_among_ties_and_beyond_the_ends(spark):
    rng = random.Random(2)
    values = [float(rng.randint(0, 30)) for _ in range(500)]
    long = spark.createDataFrame([("d", "f", v) for v in values], "feature_date string, figure string, value double")
    ladder, rungs = outside.ladders(long, ["feature_date", "figure"], 8)
    asked = [-1.0, 0.0, 3.5, 15.0, 30.0, 31.0, None]
    rows = spark.createDataFrame([("d", str(k), "f", v) for k, v in enumerate(asked)], "feature_date string, ticker string, figure string, value double")
    got = {r.ticker: (r.below, r.equal, r.total) for r in outside.placed(rows, ladder, rungs, ["feature_date", "ticker"]).collect()}
    assert got == {str(k): ((sum(x < v for x in values), values.count(v), 500) if v is not None else (0, 0, 500)) for k, v in enumerate(asked)}


def state(store):
    out = {}
    for name in ("monthly_features", "targets", "model_weights", "prediction_snapshots", "realized_performance", "peers", "rungs", "run_log"):
        rows = store.read(name)
        out[name] = sorted((str([round(x, 9) if isinstance(x, float) else x for x in r if not isinstance(x, list)]) for r in rows.drop("snapshot_id").collect()))
    return out


def test_a_run_that_dies_anywhere_ends_like_one_that_does_not(spark, panel, tmp_path):
    months = [end(42), end(43)]
    whole, broken = (TableStore(spark, str(tmp_path / n)) for n in ("whole", "broken"))
    for m in months:
        report = runs.MonthlyRun(whole, panel, NAMES, full=False).run(m)
        assert report["done"] == list(runs.STEPS) and report["n_scored"] == 9 and report["model_version"].startswith(f"monthly_{m}_")
        if m == months[0]:
            shutil.copytree(whole.folder, broken.folder)  # the state after the first month
    for step in ("ingest", "train"):
        with pytest.raises(runs.Stopped):
            runs.MonthlyRun(broken, panel, NAMES, full=False).run(months[1], stop_after=step)
    late = runs.MonthlyRun(broken, panel, NAMES, full=False)
    late._train = None  # done already: a step whose mark is there is not called
    assert late.run(months[1])["done"] == ["score", "realize"]
    versions = {t: broken.version(t).number for t in ("prediction_snapshots", "monthly_features", "run_log")}
    again = runs.MonthlyRun(broken, panel, NAMES, full=False).run(months[1])
    assert again["done"] == [] and {t: broken.version(t).number for t in versions} == versions
    assert state(broken) == state(whole)
    assert whole.read("monthly_features").select("feature_date").distinct().count() == 44


def test_a_run_of_a_month_fits_lines_of_few_rows_where_it_is_told_to(spark, panel, tmp_path):
    store = TableStore(spark, str(tmp_path))
    months = MonthlyFew(store, panel, NAMES, full=False, least=2)
    with pytest.raises(runs.Stopped):
        months.run(end(43), stop_after="train")
    w = model_table.weights(store.read("model_weights"))
    assert {"ols_current_pe_ratio", "ols_twelve_month_momentum"} <= set(w)


class MonthlyFew(runs.MonthlyRun):
    """A run that knows four price-earnings ratios."""

    def _training(self):
        rows = super()._training()
        first = rows.where("current_pe_ratio is not null").orderBy("feature_date", "ticker").limit(4).select("feature_date", "ticker", F.col("current_pe_ratio").alias("kept"))
        return rows.join(first, ["feature_date", "ticker"], "left").drop("current_pe_ratio").withColumnRenamed("kept", "current_pe_ratio")


def test_features_from_carried_tails_equal_those_of_the_whole_history(spark, panel, tmp_path, monkeypatch):
    monkeypatch.setattr(features, "PRICE_ROWS", 14)  # the longest look back that this panel's dates can have but the five-year one
    monkeypatch.setattr(features, "COMMON_ROWS", 24)
    once, monthly = (TableStore(spark, str(tmp_path / n)) for n in ("once", "monthly"))
    for store, months in ((once, [43]), (monthly, [37, 38, 43])):
        for k in months:
            with pytest.raises(runs.Stopped):
                runs.MonthlyRun(store, panel, NAMES, full=False).run(end(k), stop_after="features")
    whole, carried = ({tuple(r)[:2]: [round(x, 9) if isinstance(x, float) else x for x in tuple(r)[2:]] for r in s.read("monthly_features").collect()} for s in (once, monthly))
    assert whole == carried and len(whole) == 44 * 9
    assert monthly.read("price_tail").count() == 24 * 9  # beta's common dates reach farthest back
    recent = runs.MonthlyRun(monthly, panel, NAMES)._recent("prices_clean", "price_tail", "date")
    assert recent.count() == 24 * 9 and monthly.read("report_tail").count() == 14 * 9


def test_a_step_that_dies_between_its_tables_is_finished(spark, panel, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path))
    real = runs.save

    def dies(s, table, *a, **k):
        if table == "benchmark_prices":
            raise OSError("lost")
        return real(s, table, *a, **k)

    monkeypatch.setattr(runs, "save", dies)
    with pytest.raises(OSError):
        runs.MonthlyRun(store, panel, NAMES, full=False).run(end(30), stop_after="ingest")
    monkeypatch.setattr(runs, "save", real)
    with pytest.raises(runs.Stopped):
        runs.MonthlyRun(store, panel, NAMES, full=False).run(end(30), stop_after="ingest")
    assert store.read("benchmark_prices").count() == 31 and store.read("prices_clean").count() == 31 * 9 - 1


def test_refits_equal_a_ridge_of_each_dates_own_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        for t in range(5):
            x = rng.normal(size=2)
            y = float(x[0] - 0.5 * x[1] + rng.normal() * 0.2)
            rows.append((end(k), f"T{t}", float(x[0]), None if rng.random() < 0.1 else float(x[1]), end(k + 12), None if k > 27 else y))
    df = spark.createDataFrame(rows, "feature_date date, ticker string, a double, b double, target_date date, excess_return double")
    for window, step in ((None, 1), (12, 3)):
        got = refits.refits(df, ["a", "b"], least=10, window=window, step=step, penalties=[7.0])
        tests = [k for k in range(40) if min(k - 11, window or 99) >= 10][::step]
        assert [g[0] for g in got] == [end(k) for k in tests]
        for k, (_, n_dates, n, _, w, means) in zip(tests, got, strict=True):
            span = range(max(0, k - 11 - window) if window else 0, k - 11)
            own = np.array([r[2:4] + (r[5],) for r in rows if r[0] in {end(i) for i in span} and None not in r], float)
            x, y = own[:, :2], own[:, 2]
            z = (x - x.mean(0)) / x.std(0)
            b = np.linalg.solve(z.T @ z + 7 * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
            assert (n_dates, n) == (len(span), len(own)) and np.allclose(w, [y.mean() - x.mean(0) @ b, *b]) and np.allclose(means, x.mean(0))
    scored = {(r.feature_date, r.ticker): r.prediction for r in refits.predictions(df, got, ["a", "b"]).collect()}
    for d, _, _, _, w, m in got:
        for r in (r for r in rows if r[0] == d):
            assert scored[d, r[1]] == pytest.approx(w[0] + w[1] * r[2] + w[2] * (m[1] if r[3] is None else r[3]))
    assert refits.refits(df.limit(0), ["a", "b"]) == []


def test_the_penalty_is_the_one_of_the_least_error_over_blocks(spark):
    rng = np.random.default_rng(8)
    mats = []
    for k in range(24):
        x = np.column_stack([np.ones(6), rng.normal(size=(6, 4)), rng.normal(size=6)])
        mats.append((end(k), x.T @ x))
    assert refits.chosen_penalty(refits.Running(mats), 0, 24, [0.01, 1.0, 1e6]) == 1e6  # noise: shrink all
    assert refits.chosen_penalty(refits.Running(mats), 0, 2, [5.0, 1.0]) == 5.0  # too few dates for blocks


def test_merges_in_time_equal_a_search(spark):
    rng = random.Random(9)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    left = [(rng.choice(["a", "b", "c", None]), day(rng.randint(0, 200)), k) for k in range(120)] + [("a", None, 900)]
    history = [(k, day(d), float(d) if rng.random() < 0.9 else None) for k in ("a", "b", "z") for d in rng.sample(range(200), 25)] + [(None, day(50), 1.0)]
    l_df, h_df = spark.createDataFrame(left, "key string, at date, n int"), spark.createDataFrame(history, "key string, date date, v double")
    got = {r.n: (r.date, r.v) for r in asof.backward(l_df, h_df, "key", "at", "date").collect()}
    near = {r.n: r.w for r in asof.nearest(l_df, h_df, "key", "at", "date", "v", "w", 10).collect()}
    common = {r.n: r.w for r in asof.nearest(l_df, h_df.where("key = 'a'").drop("key"), None, "at", "date", "v", "w", 10).collect()}
    for key, at, n in left:
        past = [h for h in history if key is not None and at and h[0] == key and h[1] <= at]
        assert got[n] == (max(past, key=lambda h: h[1])[1:] if past else (None, None))

        def best(k, at=at):
            close = [h for h in history if h[0] == k and h[2] is not None and at and abs((h[1] - at).days) <= 10]
            return min(close, key=lambda h: (abs((h[1] - at).days), -h[1].toordinal()))[2] if close else None

        assert near[n] == (best(key) if key else None)
        assert common[n] == best("a")
    marks = [day(k) for k in (0, 3, 7, 7, 20)]
    after = {r["mark"]: r["d"] for r in asof.first_after(spark.createDataFrame([(day(k),) for k in (3, 7, 9)], "d date"), spark.createDataFrame([(m,) for m in marks], "mark date"), "d", "mark").collect()}
    assert after == {day(0): day(3), day(3): day(7), day(7): day(9), day(20): None}


def test_known_reports_equal_a_search_when_they_come_out_of_order(spark):
    rng = random.Random(10)
    rows = [(t, end(3 * q), end(3 * q) + dt.timedelta(days=rng.choice([30, 45, 300, 700])), float(q)) for t in "ab" for q in range(20)]
    df = spark.createDataFrame(rows, "key string, fiscal_date date, report_date date, eps double")
    got = {(r.key, r.known_from): (r.n_known, r.last_report, [x.eps for x in r.q]) for r in asof.known_at_reports(df, "key", 4).collect()}
    want = {}
    for t, d in {(r[0], r[2]) for r in rows}:
        known = [r for r in rows if r[0] == t and r[2] <= d]
        want[t, d] = (len(known), d, [r[3] for r in sorted(known, key=lambda r: r[1], reverse=True)[:4]])
    assert got == want


def test_no_pairs_and_no_lost_tables_in_the_plans(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["t02_targets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Cross", "") and "fundamentals" not in plan
    dates = entry.queries()["s10_feature_dates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "fundamentals" not in dates and "lineitem" not in dates
