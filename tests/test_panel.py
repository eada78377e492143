import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import scalars as S
from tidemark.operators import asof, fitted, models, stats
from tidemark.sources.store import TableStore, insert_ignore, upsert
from tidemark.streaming.events import upsert_stream

SF = "/root/testdata/sf0.001"


def d(text):
    return dt.date.fromisoformat(text)


def test_nearest_takes_the_later_date_on_a_tie_and_stops_at_15_days(spark):
    history = spark.createDataFrame([("A", d("2020-01-10"), 1.0), ("A", d("2020-01-20"), 2.0), ("A", d("2020-03-01"), 3.0)], "ticker string, date date, p double")
    asked = spark.createDataFrame([("A", d("2020-01-15")), ("A", d("2020-02-14")), ("A", d("2020-02-15"))], "ticker string, at date")
    got = {r.at: r.v for r in asof.nearest(asked, history, "ticker", "at", "date", "p", "v").collect()}
    assert got == {d("2020-01-15"): 2.0, d("2020-02-14"): None, d("2020-02-15"): 3.0}


def test_reports_known_at_a_date_go_by_fiscal_date_and_ignore_later_ones(spark):
    rows = [("A", d("2020-03-31"), d("2020-05-15"), 1.0), ("A", d("2019-12-31"), d("2020-06-01"), 9.0)]
    schema = "ticker string, fiscal_date date, report_date date, eps double"
    known = {r.known_from: [q.eps for q in r.q] for r in asof.known_at_reports(spark.createDataFrame(rows, schema), "ticker", 4).collect()}
    assert known == {d("2020-05-15"): [1.0], d("2020-06-01"): [1.0, 9.0]}
    later = spark.createDataFrame([*rows, ("A", d("2020-06-30"), d("2020-08-15"), 5.0)], schema)
    again = {r.known_from: [q.eps for q in r.q] for r in asof.known_at_reports(later, "ticker", 4).collect()}
    assert {k: again[k] for k in known} == known


def test_ranks_average_ties_and_skip_nulls(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", 3.0), ("g", None)], "g string, x double")
    assert sorted(x for (x,) in df.select(S.percent_rank_average(F.col("x"), "g")).collect() if x is not None) == [0.5, 0.5, 1.0]


def test_quantile_buckets_drop_repeated_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 1, 1, 2, 3, 4, 5, 6, 7)], "x double").withColumn("g", F.lit(1))
    assert [b for (b,) in df.orderBy("x").select(S.quantile_bucket(F.col("x"), 5, "g")).collect()] == [1, 1, 1, 1, 2, 2, 3, 3, 4, 4]


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 10, 0.07338803), (0.5, 3, 0.65145), (12.706205, 1, 0.05)])
def test_t_p_values(t, df, p):
    assert math.isclose(stats.t_p_value(t, df), p, rel_tol=1e-4)


def test_linear_models_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = 0.5 + x @ [1.0, -2.0, 0.0] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    matrix = models.gram(df, ["a", "b", "c", "y"])[0][1]
    fit = models.ols(matrix, ["a", "b", "c"])
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert np.allclose([r[1] for r in fit["coefficients"]], want)
    assert np.allclose(fitted.ridge(matrix, 1e-9), want, atol=1e-6)
    assert abs(fitted.lasso(matrix, 0.05)[3]) < 1e-9
    assert all(v >= 1 for _, v in models.vif(matrix, ["a", "b", "c"]))


def test_upserts_keep_or_replace_and_the_store_reads_the_last_version(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(k, f"{k}-{n}", n) for n in range(9) for k in range(2, 500)], "k int, v string, n int").repartition(7)
    kept, replaced = ({r.k: r.v for r in f(old, new, ["k"], "n").collect()} for f in (insert_ignore, upsert))
    assert kept == {1: "a", 2: "b", **{k: f"{k}-0" for k in range(3, 500)}}
    assert replaced == {1: "a", **{k: f"{k}-8" for k in range(2, 500)}}
    store = TableStore(spark, str(tmp_path / "store"))
    store.write("t", old)
    for _ in range(2):
        store.upsert("t", new.where("k < 4"), ["k"], "n")
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "a"), (2, "2-8"), (3, "3-8")]
    assert store.health(["t"]).first().rows == 3


def test_a_stream_upserts_each_batch_once(spark, tmp_path):
    spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 1)], "k int, v string, at int").write.parquet(str(tmp_path / "in"))
    store = TableStore(spark, str(tmp_path / "store"))
    stream = upsert_stream(spark.readStream.schema("k int, v string, at int").parquet(str(tmp_path / "in")), store, "t", ["k"], "at", str(tmp_path / "checkpoint"))
    stream.processAllAvailable()
    stream.stop()
    assert store.read("t").count() == 2


@pytest.mark.parametrize("name", ["f01_price_features", "t02_targets", "k02_upsert", "p01_scalars", "c07_corrections"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    rows = sorted((tuple(map(str, r)) for r in got.select(*names).collect()), key=str)
    expected = sorted((tuple(map(str, r)) for r in want.fetchall()), key=str)
    assert [[x.replace(" 00:00:00", "") for x in r] for r in rows] == [[x.replace(" 00:00:00", "") for x in r] for r in expected]


def test_entry_has_rows(spark):
    assert entry.entry(spark).take(1)


def test_price_scan_and_feature_panel_return_every_column_they_make(spark):
    assert "adjusted_close" in entry.queries()["s04_prices"](spark, SF).columns
    assert {"adjusted_close", "market_cap"} <= set(entry.queries()["f13_feature_panel"](spark, SF).columns)


def test_returns_matrix_and_scaling_cover_all_tickers_and_features(spark):
    matrix = entry.queries()["s06_returns_matrix"](spark, SF)
    assert set(matrix.columns) == {"date", *[f"nation_{k}" for k in range(25)]}
    for name in ("f25_winsorized", "f28_standardized", "f29_minmax"):
        assert len(entry.queries()[name](spark, SF).columns) == 2 + 24
