"""Complete cases by pattern, inflation, regressions, logistic windows, t tests and signals against plain Python."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import student
from tidemark.operators import complete_cases, fitted, models, newton, signals

NAMES = ["a", "b", "c", "d"]


def day(k):
    return dt.date(2000 + k // 12, k % 12 + 1, 1)


@pytest.fixture(scope="module")
def frame():
    draw = np.random.default_rng(21)
    rows = []
    for k in range(50):
        for t in range(7):
            a, b, e = draw.normal(size=3)
            x = [a, b * 4, 3 * a + 0.1 * e, None if k < 20 or draw.random() < 0.3 else draw.normal()]
            x[1] = None if draw.random() < 0.15 else x[1]
            y = 0.5 * a - 0.05 * b + draw.normal() * 0.4
            rows.append((day(k), f"T{t}", *[None if v is None else float(v) for v in x], float(y), int(y > 0)))
    return pd.DataFrame(rows, columns=["feature_date", "ticker", *NAMES, "excess_return", "winner"])


@pytest.fixture(scope="module")
def panel(spark, frame):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in frame.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, "feature_date date, ticker string, a double, b double, c double, d double, excess_return double, winner int").repartition(5)


def vif_of(x, i):
    others = np.delete(x, i, 1)
    rest = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
    return (x[:, i] ** 2).sum() / (rest**2).sum()


def test_matrices_are_those_of_each_subsets_complete_cases(panel, frame):
    with complete_cases.CompleteCases(panel, NAMES, "excess_return") as cases:
        for subset in (NAMES, ["a"], ["d", "b"], ["c", "a"]):
            own = frame.dropna(subset=subset)
            z = np.column_stack([np.ones(len(own)), own[subset], own["excess_return"]]).astype(float)
            assert np.allclose(cases.matrix(subset), z.T @ z)
            assert [d for d, _ in cases.by_date(subset)] == sorted(own["feature_date"].unique())


def test_inflation_drops_one_by_one_on_new_complete_cases(panel, frame):
    kept, dropped = list(NAMES), []
    while len(kept) >= 2:
        x = frame[kept].dropna().to_numpy(float)
        v = [vif_of(x, i) for i in range(len(kept))]
        if max(v) <= 10:
            break
        dropped.append((kept.pop(int(np.argmax(v))), max(v)))
    fit = complete_cases.multiple_regression(panel, NAMES)
    assert fit["features"] == kept and [d[0] for d in fit["dropped"]] == [d[0] for d in dropped] and dropped
    assert np.allclose([d[1] for d in fit["dropped"]], [d[1] for d in dropped])
    own = frame.dropna(subset=kept)
    days = sorted(own["feature_date"].unique())
    early = own["feature_date"].isin(days[: int(len(days) * 0.7)])
    z = lambda part: np.column_stack([np.ones(len(part)), part[kept]]).astype(float)
    w = np.linalg.lstsq(z(own[early]), own[early]["excess_return"], rcond=None)[0]
    test = own[~early]
    left = ((test["excess_return"] - z(test) @ w) ** 2).sum() / ((test["excess_return"] - test["excess_return"].mean()) ** 2).sum()
    got = fit["filtered"]
    assert np.allclose([r[1] for r in got["coefficients"]], w) and got["r2_test"] == pytest.approx(1 - left) and got["n_test"] == len(test)
    table = {r.term: r for r in complete_cases.coefficient_table(panel.sparkSession, got).collect()}
    for name, b, se, t, p in got["coefficients"]:
        r = table[name]
        assert r.p_value == pytest.approx(p, abs=1e-9) and r.ci_low < b < r.ci_high and r.t_stat == pytest.approx(t) and r.ci_high - b == pytest.approx(1.99 * se, rel=0.02)


def test_columns_that_others_determine_are_infinite():
    x = np.random.default_rng(1).normal(size=(30, 3))
    z = np.column_stack([np.ones(30), x, x[:, 0] + x[:, 1], x[:, 0]])
    got = dict(complete_cases.inflation(z.T @ z, ["p", "q", "r", "s"]))
    assert math.isinf(got["p"]) and math.isinf(got["s"]) and got["r"] < 2


def test_empty_and_short_tables(panel):
    assert complete_cases.multiple_regression(panel.limit(0), NAMES)["filtered"] is None
    assert complete_cases.multiple_regression(panel.where("ticker = 'T1'").limit(20), NAMES)["full"] is None
    assert complete_cases.coefficient_table(panel.sparkSession, None).count() == 0
    assert newton.rolling_auc(panel.limit(0), NAMES).count() == 0
    assert fitted.model_comparison(panel.limit(0), NAMES) == ([], [])


def test_windows_fitted_together_equal_fits_of_each(panel, frame):
    rows = panel.na.drop(subset=["a", "b"])
    windows = [(day(0), day(20)), (day(5), day(30)), (day(48), day(49)), (day(90), day(95))]
    got = newton.fits(rows, ["a", "b"], "winner", windows, c=1.0)
    assert got[3] is None
    for (first, last), f in zip(windows[:3], got, strict=False):
        own = frame.dropna(subset=["a", "b"])
        own = own[(own["feature_date"] >= first) & (own["feature_date"] <= last)]
        x, y = own[["a", "b"]].to_numpy(float), own["winner"].to_numpy(float)
        z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
        slope = z.T @ (y - 1 / (1 + np.exp(-z @ f.weights))) - np.array([0, *f.weights[1:]])
        assert f.converged and f.n == len(own) and np.abs(slope).max() < 1e-7
        assert np.allclose(f.own_scale()[0] + x @ f.own_scale()[1:], z @ f.weights)
        p = 1 / (1 + np.exp(-z @ f.weights))
        assert f.log_likelihood == pytest.approx((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
    assert not newton.fits(rows, ["a", "b"], "winner", windows[:1], rounds=1)[0].converged


def test_aucs_equal_counts_over_pairs(spark):
    draw = np.random.default_rng(3)
    rows = [(w, float(draw.integers(0, 40)), int(draw.random() < 0.3 + 0.2 * w)) for w in range(3) for _ in range(300)]
    got = {r.window: r for r in newton.aucs(spark.createDataFrame(rows, "window int, score double, y int")).collect()}
    for w in range(3):
        pos, neg = ([s for v, s, y in rows if v == w and y == k] for k in (1, 0))
        assert got[w].auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)) and got[w].n == 300


def test_models_side_by_side(panel, frame):
    table, pairs = fitted.model_comparison(panel, ["a", "b"])
    own = frame.dropna(subset=["a", "b"])
    days = sorted(own["feature_date"].unique())
    early = own["feature_date"].isin(days[: int(len(days) * 0.7)])
    for name, alpha, n, m, r2, r2_test, rmse, _, gap, used in table:
        assert (n, m) == (early.sum(), (~early).sum()) and gap == pytest.approx(r2 - r2_test)
        if name == "ols":
            z = np.column_stack([np.ones(len(own)), own[["a", "b"]]]).astype(float)
            w = np.linalg.lstsq(z[early], own["excess_return"][early], rcond=None)[0]
            e = own["excess_return"] - z @ w
            assert rmse == pytest.approx(math.sqrt((e[early] ** 2).mean())) and alpha is None and used == 2
            assert r2_test == pytest.approx(1 - (e[~early] ** 2).sum() / ((own["excess_return"][~early] - own["excess_return"][~early].mean()) ** 2).sum())
    assert [p[0] for p in pairs] == ["a", "b"] and len(table) == 3


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 10, 0.07338803), (0.5, 3, 0.65144796), (12.7062047, 1, 0.05), (0.0, 5, 1.0), (1.96, 100000, 0.0499985), (-2.2281389, 10, 0.05)])
def test_t_tests_as_expressions(spark, t, df, p):
    row = spark.createDataFrame([(t, df)], "t double, v int").select(student.t_p_value(F.col("t"), F.col("v")).alias("p"), student.t_quantile(0.05, F.col("v")).alias("q")).first()
    assert row.p == pytest.approx(p, rel=1e-5)
    tabulated = {1: 12.7062, 3: 3.18245, 5: 2.57058, 10: 2.22814, 100000: 1.95999}
    assert row.q == pytest.approx(tabulated[df], rel=1e-5)


def test_signals_take_the_first_rule_and_dash_the_rest(spark):
    rows = [("return_1m", 0.08, "✅ Positive"), ("return_1m", 0.0800001, "✅ Strong momentum"), ("return_1m", 0.0, "🔴 Negative"), ("current_pe_ratio", 15.0, "⚠️ Moderate P/E"), ("current_pe_ratio", 14.9, "✅ Low P/E"), ("current_pe_ratio", 500.0, "🔴 Very high P/E"), ("unknown", 1.0, "—"), ("roe", None, "—"), ("roe", float("nan"), "—"), ("roe", float("inf"), "—"), ("roe", -3.0, "🔴 Negative ROE")]
    made = signals.signalled(spark.createDataFrame(rows, "feature string, value double, want string"), signals.rule_table(spark))
    assert made.where("signal != want").count() == 0 and made.count() == len(rows)
    assert all(len(t) == len(b) + 1 and list(b) == sorted(b, reverse=side == signals.ABOVE) for side, b, t in signals.RULES.values())


def test_a_fit_does_not_depend_on_the_scale_of_its_columns():
    draw = np.random.default_rng(6)
    x = draw.normal(size=(80, 3))
    y = x @ [1.0, -1.0, 0.5] + draw.normal(size=80) * 0.1
    for scale in ([1.0, 1.0, 1.0], [1e10, 1e-3, 1.0]):
        z = np.column_stack([np.ones(80), x * scale, y])
        fit = models.ols(z.T @ z, ["p", "q", "r"])
        assert fit["r2"] > 0.98 and np.allclose([r[1] for r in fit["coefficients"]][1:] * np.array(scale), [1.0, -1.0, 0.5], atol=0.05)
