"""The panel: entities, month-end prices, a benchmark and quarterly reports.

On a star schema of orders a nation is an entity, its region the sector, its mean order
value the price. Each table is one aggregation of the facts, so what the operators see
is small whatever the size of the facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import quarter_label, report_lag_days
from .shared import fresh_folder


class Panel:
    """The four tables; each is made, and written where ``written`` says so, when it is first asked for."""

    def __init__(self, make: dict[str, Callable[[], DataFrame]]):
        self._make, self._made = make, {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make[name]()
        return self._made[name]

    @property
    def stocks(self) -> DataFrame:
        return self._table("stocks")

    @property
    def prices(self) -> DataFrame:
        return self._table("prices")

    @property
    def benchmark(self) -> DataFrame:
        return self._table("benchmark")

    @property
    def fundamentals(self) -> DataFrame:
        return self._table("fundamentals")


def with_returns(prices: DataFrame, *key: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy("date")
    return prices.withColumn("monthly_return", F.try_divide("adjusted_close", F.lag("adjusted_close").over(w)) - 1)


def facts(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """How each table is aggregated from the facts.

    Prices and the benchmark share one table, ``monthly``: sums of amounts by nation and
    month (orders of no known nation under null). Reports alone read the line items.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def customers() -> DataFrame:
        # nation and region have 25 and 5 rows by definition of the schema.
        nations = F.broadcast(read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("ticker"), F.col("r_name").alias("sector")))
        return read("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "ticker", "sector")

    def placed(how: str, *columns: str) -> DataFrame:
        orders = read("orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), *columns)
        return orders.join(customers().select("c_custkey", "ticker"), F.col("o_custkey") == F.col("c_custkey"), how)

    def stocks() -> DataFrame:
        return customers().groupBy("ticker", "sector").agg(F.count("*").cast("double").alias("shares_outstanding_m"))

    def monthly() -> DataFrame:
        amount = F.col("o_totalprice").cast("decimal(18,2)")
        return placed("left", "o_totalprice").groupBy("ticker", F.last_day("day").alias("date")).agg(F.sum(amount).alias("amount"), F.count("o_totalprice").alias("n"), F.count("*").alias("orders"))

    def fundamentals() -> DataFrame:
        quarter_end = F.last_day(F.add_months(F.trunc("day", "quarter"), 2))
        lines = read("lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").join(placed("inner", "o_orderkey").select("o_orderkey", "ticker", quarter_end.alias("fiscal_date")), F.col("l_orderkey") == F.col("o_orderkey"))
        return _reported(lines)

    return {"stocks": stocks, "monthly": monthly, "fundamentals": fundamentals}


def _reported(lines: DataFrame) -> DataFrame:
    """Quarterly figures from line items with ticker and fiscal_date."""
    price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    reports = lines.groupBy("ticker", "fiscal_date").agg(
        F.sum(price * (1 - discount)).alias("revenue"),
        F.sum("l_quantity").alias("units"),
        F.sum(price * discount).alias("net_income"),
        (F.sum(price) * 2).alias("equity"),
        (F.sum(price * tax) * 5).alias("total_debt"),
        F.sum(price * (F.lit(0.1) - discount + tax)).alias("free_cash_flow"),
    )
    return reports.select(
        "ticker",
        "fiscal_date",
        quarter_label(F.col("fiscal_date")).alias("fiscal_period"),
        F.date_add("fiscal_date", report_lag_days(F.col("fiscal_date"))).alias("report_date"),
        "revenue",
        (F.col("net_income") / F.col("units")).alias("eps"),
        "net_income",
        "equity",
        "total_debt",
        "free_cash_flow",
        (4 * F.col("net_income") / F.col("equity")).alias("roe"),
        (F.col("total_debt") / F.col("equity")).alias("debt_to_equity"),
        (F.col("net_income") / F.col("revenue")).alias("operating_margin"),
    )


def materialised_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """The panel as written tables, so that a plan that needs one often reads the facts once.

    A table is written when a query first asks for it: what reads prices alone never reads
    line items. The folder is the query's own and stays, since the query's rows are read later.
    """
    make, folder, kept = facts(spark, sf_dir), [], {}

    def written(name: str) -> DataFrame:
        if name not in kept:
            if not folder:
                folder.append(fresh_folder(spark, "panel"))
            df = make[name]()
            df.write.parquet(f"{folder[0]}/{name}")
            kept[name] = spark.read.schema(df.schema).parquet(f"{folder[0]}/{name}")
        return kept[name]

    def mean() -> Column:
        """From exact sums, whatever the order of the rows."""
        return F.sum("amount").cast("double") / F.sum("n")

    def prices() -> DataFrame:
        own = written("monthly").where("ticker is not null").groupBy("ticker", "date").agg(mean().alias("adjusted_close"), F.sum("orders").cast("double").alias("volume"))
        return with_returns(own, "ticker")

    def benchmark() -> DataFrame:
        return with_returns(written("monthly").groupBy("date").agg(mean().alias("adjusted_close")).withColumn("benchmark_ticker", F.lit("ALL")), "benchmark_ticker")

    return Panel({"stocks": lambda: written("stocks"), "fundamentals": lambda: written("fundamentals"), "prices": prices, "benchmark": benchmark})


SQL = """
stocks AS (SELECT n_name AS ticker, r_name AS sector, count(*)::DOUBLE AS shares_outstanding_m
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
placed AS (SELECT o_orderkey, o_totalprice, o_orderdate::DATE AS day, n_name AS ticker
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
px AS (SELECT ticker, last_day(day) AS date, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE / count(o_totalprice) AS adjusted_close, count(*)::DOUBLE AS volume FROM placed GROUP BY 1, 2),
prices AS (SELECT *, adjusted_close / lag(adjusted_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS monthly_return FROM px),
bx AS (SELECT last_day(o_orderdate::DATE) AS date, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE / count(o_totalprice) AS adjusted_close FROM orders GROUP BY 1),
bench AS (SELECT *, adjusted_close / lag(adjusted_close) OVER (ORDER BY date) - 1 AS monthly_return FROM bx),
raw_funds AS (SELECT ticker, last_day(date_trunc('quarter', day)::DATE + INTERVAL 2 MONTH)::DATE AS fiscal_date,
           sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_quantity) AS units, sum(l_extendedprice * l_discount) AS net_income,
           sum(l_extendedprice) * 2 AS equity, sum(l_extendedprice * l_tax) * 5 AS total_debt,
           sum(l_extendedprice * (0.1::DOUBLE - l_discount + l_tax)) AS free_cash_flow
           FROM lineitem JOIN placed ON l_orderkey = o_orderkey GROUP BY 1, 2),
funds AS (SELECT ticker, fiscal_date, 'Q' || quarter(fiscal_date) AS fiscal_period,
           (fiscal_date + to_days(CASE WHEN quarter(fiscal_date) = 4 THEN 90 ELSE 45 END))::DATE AS report_date,
           revenue, net_income / units AS eps, net_income, equity, total_debt, free_cash_flow,
           4 * net_income / equity AS roe, total_debt / equity AS debt_to_equity, net_income / revenue AS operating_margin FROM raw_funds)
"""
