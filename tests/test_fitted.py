import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fitted, models, newton

NAMES = ["a", "b", "c"]


def day(k):
    return dt.date(2000 + k // 12, k % 12 + 1, 1)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    out = []
    for k in range(48):
        for t in range(6):
            x = draw.normal(size=3) * [1, 5, 0.2]
            y = 0.4 * x[0] - 0.02 * x[1] + draw.normal() * 0.5
            out.append((day(k), f"T{t}", *map(float, x), float(y), int(y > 0)))
    return out


@pytest.fixture(scope="module")
def panel(spark, rows):
    return spark.createDataFrame(rows, "feature_date date, ticker string, a double, b double, c double, excess_return double, winner int").repartition(5)


def arrays(rows):
    return np.array([r[2:5] for r in rows]), np.array([r[5] for r in rows]), np.array([r[6] for r in rows])


def test_ridge_takes_the_penalty_that_a_search_over_folds_of_rows_takes(panel, rows):
    x, y, _ = arrays(rows)  # made in the order of (date, ticker)
    z = (x - x.mean(0)) / x.std(0)
    block = len(y) // 6
    starts = [len(y) - (5 - f) * block for f in range(5)]

    def fit(z, y, alpha):
        b = np.linalg.solve((z - z.mean(0)).T @ (z - z.mean(0)) + alpha * np.eye(3), (z - z.mean(0)).T @ (y - y.mean()))
        return y.mean() - z.mean(0) @ b, b

    quality = []
    for alpha in fitted.PENALTIES:
        scores = []
        for s in starts:
            w0, b = fit(z[:s], y[:s], alpha)
            t = y[s : s + block]
            scores.append(1 - ((t - w0 - z[s : s + block] @ b) ** 2).sum() / ((t - t.mean()) ** 2).sum())
        quality.append(np.mean(scores))
    best, _, w = fitted.ridge_of(panel, NAMES)
    assert best == fitted.PENALTIES[int(np.argmax(quality))]
    w0, b = fit(z, y, best)
    assert np.allclose(w, [w0, *b])


def test_lasso_meets_its_optimality_conditions(panel, rows):
    x, y, _ = arrays(rows)
    z = (x - x.mean(0)) / x.std(0)
    alpha, own, w = fitted.lasso_of(panel, NAMES)
    slope = z.T @ (y - w[0] - z @ w[1:]) / len(y)
    for s, b in zip(slope, w[1:], strict=True):
        assert abs(s) <= alpha + 1e-8 if b == 0 else abs(s - alpha * np.sign(b)) < 1e-8
    assert np.allclose(own[0] + x @ own[1:], w[0] + z @ w[1:])
    path = fitted.lasso_path(panel, NAMES)
    assert len(path) == 3 * 40 and all(b == 0 for a, _, b in path if a > 5)


def test_fits_without_rows_are_empty(panel):
    none = panel.where("false")
    assert (fitted.ridge_of(none, NAMES)[1] == 0).all()
    assert fitted.lasso_path(none, NAMES) == [] and fitted.rolling_r_squared(none, NAMES) == []
    assert newton.rolling_auc(none, NAMES).count() == 0 and fitted.logit_table(none, NAMES)[0] == []
    assert fitted.actual_vs_predicted(none, NAMES).count() == 0


def test_comparison_keeps_features_of_either_model(spark):
    r = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("c", 2.0)], "feature string, coefficient double")
    c = spark.createDataFrame([("a", 0.5, True), ("b", 0.1, True), ("d", 0.2, True)], "feature string, coefficient double, selected boolean")
    got = {x.feature: (x.lasso_coef, x.selected, x.agreement) for x in fitted.compared(r, c).collect()}
    assert got == {"a": (0.5, True, "Both positive"), "b": (0.1, True, "Sign disagree"), "c": (0.0, False, "Lasso zeroed"), "d": (0.2, True, "Sign disagree")}


def test_actual_and_predicted_equal_least_squares(panel, rows):
    x, y, _ = arrays(rows)
    design = np.column_stack([np.ones(len(y)), x])
    want = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    got = {(r.feature_date, r.ticker): (r.predicted, r.residual) for r in fitted.actual_vs_predicted(panel, NAMES).collect()}
    for r, p in zip(rows, want, strict=True):
        assert np.allclose(got[r[0], r[1]], (p, r[5] - p))


def test_rolling_r_squared_equals_fits_of_each_run(panel, rows):
    x, y, _ = arrays(rows)
    got = fitted.rolling_r_squared(panel, NAMES)
    assert [g[0] for g in got] == [day(k) for k in range(36, 48)]
    for k, (_, n, r2, _) in zip(range(36, 48), got, strict=True):
        part = slice((k - 36) * 6, k * 6)
        design = np.column_stack([np.ones(n), x[part]])
        e = y[part] - design @ np.linalg.lstsq(design, y[part], rcond=None)[0]
        assert abs(r2 - (1 - e @ e / ((y[part] - y[part].mean()) ** 2).sum())) < 1e-9


def one_logit(x, y):
    """Means, deviations and weights of a penalised fit of one window, on standardised features."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    penalty, w = np.diag([0.0, *[1.0] * x.shape[1]]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
    return mean, sd, w


def test_rolling_auc_equals_a_count_over_pairs(panel, rows):
    x, _, won = arrays(rows)
    got = {r.feature_date: r for r in newton.rolling_auc(panel, NAMES).collect()}
    assert set(got) == {day(k) for k in range(36, 48)}
    k = 40
    low, cut, high = (k - 36) * 6, (k - 36 + 25) * 6, k * 6
    mean, sd, w = one_logit(x[low:cut], won[low:cut])
    p, y = w[0] + ((x[cut:high] - mean) / sd) @ w[1:], won[cut:high]
    pairs = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    assert abs(got[day(k)].auc - np.mean(pairs)) < 1e-12 and got[day(k)].n_train == cut - low


def test_logit_table_is_at_the_maximum_and_has_its_curvature(panel, rows):
    x, _, y = arrays(rows)
    table, figures = fitted.logit_table(panel, NAMES)
    z = np.column_stack([np.ones(len(y)), x])
    b = np.array([t[1] for t in table])
    p = 1 / (1 + np.exp(-z @ b))
    assert figures["converged"] and np.abs(z.T @ (y - p)).max() < 1e-6
    assert np.allclose([t[2] for t in table], np.sqrt(np.diag(np.linalg.inv((z * (p * (1 - p))[:, None]).T @ z))))
    ll = (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    assert abs(figures["log_likelihood"] - ll) < 1e-8 and abs(figures["bic"] - (4 * np.log(len(y)) - 2 * ll)) < 1e-8


def test_running_sums_hold_over_slices_and_ties_of_cuts(spark):
    at = spark.range(1000).select((F.col("id") * 7919 % 1000 / 1000).alias("p"), F.lit(1).alias("neg"), (F.col("id") % 3).alias("pos"))
    got = models.running(at, "p", ["neg", "pos"], slices=16).orderBy("p").collect()
    before = np.cumsum([0, *[r.pos for r in got]])[:-1]
    assert [r.before_neg for r in got] == list(range(1000)) and [r.before_pos for r in got] == before.tolist()
    assert {(r.total_neg, r.total_pos) for r in got} == {(1000, 999)}


def test_scoring_uses_models_only_with_enough_rows(panel):
    ready = panel.withColumns({"data_quality_score": F.lit(80.0), "sector": F.lit("s")})
    few = fitted.scored_by_models(ready, panel.limit(49), NAMES)
    assert few.where("probability is not null or agreement_score != 50 or excess_score != 50").count() == 0
    many = fitted.scored_by_models(ready, panel, NAMES)
    assert many.where("probability is null or agreement_score not in (0, 100) and abs(agreement_score - 50) not between 16.6 and 16.7").count() == 0
    assert many.select("feature_date", "ticker").distinct().count() == ready.count()
    records = fitted.snapshot_records(many, NAMES, "v1").where("feature_date = date'2001-01-01'")
    one = records.select(F.get_json_object("features_json", "$.a").cast("double").alias("a"), "feature_date", "ticker").join(panel.withColumnRenamed("a", "want"), ["feature_date", "ticker"])
    assert one.count() == 6 and one.where("abs(a - want) > 1e-12").count() == 0
    assert models.gram(ready, NAMES)[0][1][0, 0] == 288
