"""Joins in time: backward as-of, point in time, nearest within a tolerance.

All are merges: both sides are put in one table, dealt out by the entity, sorted once by
time, and each row takes the last (or first) history row beside it. No rows are paired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spine(dates: DataFrame, entities: DataFrame) -> DataFrame:
    """Every entity at every date. ``dates`` holds one row a month and is broadcast (1,200 rows a century)."""
    return entities.crossJoin(F.broadcast(dates))


def _merged(left: DataFrame, history: DataFrame, key: str, at: str, date: str) -> DataFrame:
    """Rows of both sides in one table: _row (left's columns) or _past (history's), with _key and _at."""
    asked = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.struct(*left.columns).alias("_row"))
    past = history.select(F.col(key).alias("_key"), F.col(date).alias("_at"), F.struct(*[c for c in history.columns if c != key]).alias("_past"))
    return asked.unionByName(past, allowMissingColumns=True)


def backward(left: DataFrame, history: DataFrame, key: str, at: str, date: str) -> DataFrame:
    """The last row of ``history`` with ``date`` at or before ``at``; all rows of ``left`` stay.

    A merge: both sides are sorted once by entity and time, and each row of ``left`` takes
    the last history row before it. Of rows of one date any may be taken. A null key or
    time finds nothing.
    """
    w = Window.partitionBy("_key").orderBy(F.col("_at").asc_nulls_first(), F.col("_past").isNull())  # at one time the history comes first
    last = F.last(F.when(F.col("_at").isNotNull(), F.col("_past")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = _merged(left, history, key, at, date).withColumn("_last", F.when(F.col("_key").isNotNull() & F.col("_at").isNotNull(), last)).where(F.col("_row").isNotNull())
    return found.select("_row.*", *[F.col("_last")[c].alias(c) for c in history.columns if c != key])


def known_at_reports(reports: DataFrame, key: str, rows: int) -> DataFrame:
    """What is known from each report date on: the last ``rows`` reports by fiscal date.

    One row for each (key, known_from) with ``q``, newest first, and the number known.
    Evaluated at report dates only, since nothing changes between them. A report can be
    among the last ``rows`` from its own date until ``rows`` later ones are all known, so
    it is sent to the report dates in between (about ``rows`` of them) and no list grows
    with the history.
    """
    by_report, by_fiscal = Window.partitionBy(key).orderBy("report_date"), Window.partitionBy(key).orderBy("fiscal_date", "report_date")
    following, upto = by_fiscal.rowsBetween(1, rows), by_report.rangeBetween(Window.unboundedPreceding, 0)
    placed = reports.where("report_date is not null").withColumns({"_nth": F.dense_rank().over(by_report), "_n": F.count("*").over(upto)})
    gone = F.when(F.count("*").over(following) == rows, F.max("_nth").over(following)).otherwise(F.max("_nth").over(Window.partitionBy(key)) + 1)
    sent = placed.withColumn("_gone", gone).withColumn("_at", F.explode(F.sequence("_nth", F.greatest(F.col("_nth"), F.col("_gone") - 1))))
    ordered = F.sort_array(F.collect_list(F.struct("fiscal_date", *[c for c in reports.columns if c not in (key, "fiscal_date")])), asc=False)
    own = lambda c: F.max(F.when(F.col("_at") == F.col("_nth"), F.col(c)))
    return sent.groupBy(key, "_at").agg(own("report_date").alias("known_from"), own("_n").alias("n_known"), own("report_date").alias("last_report"), F.slice(ordered, 1, rows).alias("q")).drop("_at")


def nearest(left: DataFrame, history: DataFrame, key: str | None, at: str, date: str, value: str, alias: str, days: int = 15) -> DataFrame:
    """``value`` on the date nearest to ``at`` within ``days``; on a tie the later date.

    The same merge from both sides: the last value up to ``at`` and the first one after it.
    Without a key the history is one for all (a row a month): its answers are found once a
    distinct date and broadcast.
    """
    if key is None:
        asked = left.select(at).distinct().withColumn("_all", F.lit(0))
        found = nearest(asked, history.withColumn("_all", F.lit(0)), "_all", at, date, value, alias, days)
        return left.join(F.broadcast(found.select(at, alias)), at, "left")  # a row a month
    known = history.where(F.col(value).isNotNull()).select(key, F.col(date).alias("_date"), F.col(value).alias("_value"))
    w = Window.partitionBy("_key").orderBy("_at")
    both = _merged(left, known, key, at, "_date")
    before = F.last("_past", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_past", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    apart = lambda c: F.abs(F.datediff(F.col(c)["_date"], "_at"))
    found = both.withColumns({"_before": before, "_after": after}).where(F.col("_row").isNotNull())
    later = F.when(apart("_after") <= F.coalesce(apart("_before"), F.lit(1 << 30)), F.col("_after")).otherwise(F.col("_before"))
    found = found.withColumn("_best", later)
    return found.select("_row.*", F.when(F.col("_key").isNotNull() & (apart("_best") <= days), F.col("_best")["_value"]).alias(alias))


def first_after(dates: DataFrame, marks: DataFrame, date: str, mark: str) -> DataFrame:
    """The first of ``dates`` strictly after each mark. Both hold a row a month: one window, no join."""
    both = marks.select(F.col(mark).alias("_at"), F.lit(True).alias("_mark")).distinct().unionByName(dates.select(F.col(date).alias("_at"), F.lit(False).alias("_mark")).distinct())
    after = F.first(F.when(~F.col("_mark"), F.col("_at")), ignorenulls=True).over(Window.orderBy("_at", "_mark").rowsBetween(1, Window.unboundedFollowing))
    return both.withColumn(date, after).where("_mark").select(F.col("_at").alias(mark), date)


def next_period(df: DataFrame, dates: DataFrame, date: str, alias: str = "next_date") -> DataFrame:
    """Each row with the next date of the common calendar."""
    following = dates.select(F.col(date), F.lead(date).over(Window.orderBy(date)).alias(alias))
    return df.join(F.broadcast(following), date, "left")
