"""The table store: merges of touched files, writers side by side, marks, care, savers."""

import threading

from pyspark.sql import functions as F

from tidemark.sources.store import TableStore, save, with_id


def names(store, table):
    return {r.file for r in store.files(table).collect()}


def rows_of(store, table):
    return {r.k: r.v for r in store.read(table).collect()}


def numbers(spark, low, high, tag, parts=4):
    return spark.range(low, high, 1, parts).select(F.col("id").alias("k"), F.concat(F.lit(tag), F.col("id").cast("string")).alias("v"), F.lit(1).alias("n"))


def test_a_merge_leaves_files_without_its_keys_alone(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = TableStore(spark, str(tmp_path))
        store.write("t", numbers(spark, 0, 4000, "a"), ["k"])
        first = names(store, "t")
        assert len(first) == 4
        store.upsert("t", numbers(spark, 10, 20, "b"), ["k"], "n")
        kept = names(store, "t") & first
        assert len(kept) == 3
        store.insert_ignore("t", numbers(spark, 3990, 4010, "c"), ["k"], "n")
        assert kept < names(store, "t") and len(names(store, "t") & first) == 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = rows_of(store, "t")
    assert got == {k: f"{'b' if 10 <= k < 20 else 'a' if k < 4000 else 'c'}{k}" for k in range(4010)}
    assert {r.k: r.v for r in store.read("t", 1).collect()} == {k: f"a{k}" for k in range(4000)}
    before = store.files("t").count()
    store.compact("t", 500)
    assert rows_of(store, "t") == got and store.files("t").count() < before
    assert store.expire("t", older_than=0) > 0
    assert rows_of(store, "t") == got and store._numbers("t") == [4]
    assert store.health(["t"]).first().rows == 4010


def test_two_writers_lose_nothing(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("t", numbers(spark, 0, 100, "a"), ["k"])
    jobs = [(store.upsert, numbers(spark, 0, 50, "b", 1)), (store.upsert, numbers(spark, 40, 60, "b", 1)), (store.insert_ignore, numbers(spark, 90, 120, "c", 1)), (store.insert_ignore, numbers(spark, 110, 130, "c", 1))]
    failed = []

    def work(how, batch):
        try:
            how("t", batch, ["k"], "n")
        except Exception as e:  # noqa: BLE001  reported below
            failed.append(e)

    threads = [threading.Thread(target=work, args=j) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and len(store._numbers("t")) == 5
    assert store.read("t").count() == 130
    assert rows_of(store, "t") == {k: f"{'b' if k < 60 else 'a' if k < 100 else 'c'}{k}" for k in range(130)}


def test_a_planned_change_is_made_anew_when_its_files_are_gone(spark, tmp_path):
    store, other = TableStore(spark, str(tmp_path)), TableStore(spark, str(tmp_path))
    store.write("t", numbers(spark, 0, 10, "a"), ["k"])
    publish, calls = store._publish, []

    def late(name, v):
        if not calls:  # another writer comes between plan and commit
            other.upsert("t", numbers(spark, 0, 5, "x"), ["k"], "n")
        calls.append(v.number)
        return publish(name, v)

    store._publish = late
    store.upsert("t", numbers(spark, 3, 12, "y"), ["k"], "n")
    assert calls == [2, 3]
    assert rows_of(store, "t") == {k: f"{'x' if k < 3 else 'y'}{k}" for k in range(12)}


def test_a_mark_is_done_once(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    for k, tag in ((1, "a"), (1, "b"), (2, "c"), (0, "d")):
        store.upsert("t", numbers(spark, 0, 3, tag), ["k"], "n", mark=("s", k))
    assert set(rows_of(store, "t").values()) == {"c0", "c1", "c2"}
    assert store.is_done("t", ("s", 2)) and not store.is_done("t", ("s", 3)) and not store.is_done("t", ("other", 0))


def test_null_keys_missing_columns_and_empty_batches(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    batch = spark.createDataFrame([(1, "a", 1), (None, "b", 1), (None, "b", 2)], "k bigint, v string, n int")
    store.upsert("t", batch, ["k"], "n")
    store.upsert("t", batch.limit(0), ["k"], "n")
    store.insert_ignore("t", batch.drop("v").where("k is null"), ["k"], "n")
    store.upsert("t", batch.where("k = 1").select("k", "n", F.lit(5).alias("more")), ["k"], "n")
    assert sorted(map(tuple, store.read("t").collect()), key=str) == sorted([(1, None, 1), (None, "b", 1), (None, "b", 2), (None, None, 1), (None, None, 2)], key=str)


def test_savers_replace_ignore_and_fill_ids(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    price = lambda p: spark.createDataFrame([("A", "2020-01-31", p)], "ticker string, date string, adjusted_close double")
    for table, want in (("prices_clean", 2.0), ("benchmark_prices", 1.0)):
        for p in (1.0, 2.0):
            save(store, table, price(p) if table == "prices_clean" else price(p).withColumnRenamed("ticker", "benchmark_ticker"))
        assert [r.adjusted_close for r in store.read(table).collect()] == [want]
    runs = spark.createDataFrame([("s", 1.0, None), ("s", 2.0, "own"), ("s", 1.0, "")], "strategy string, total double, backtest_id string")
    for _ in range(2):
        save(store, "backtest_results", runs)
    ids = sorted(r.backtest_id for r in store.read("backtest_results").collect())
    assert len(ids) == 2 and ids[1] == "own" and len(ids[0]) == 36 and ids[0][14] == "5"
    assert with_id(runs.drop("backtest_id"), "backtest_id").where("backtest_id rlike '^[0-9a-f-]{36}$'").count() == 3
