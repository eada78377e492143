"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a word budget by its weight. Its documents are laid end to end in
a fixed pseudo-random order; the words before a document are the cumulative demand
at which it is due. A source's weight schedule over training progress (0 to 1) is
piecewise linear; its integral is the demand curve, and inverting that curve gives
the document's position. Documents are range-sorted by position.

No source is gathered in one task: the running sums are taken per (source, slice of
the order), 4096 slices a source, and the slices' totals are summed on their own.

The order within a source is that of a digest of id and text, so rows without an id or of
one id are dealt to all slices.

Defined results: null or wordless texts have size 0 and take 0 words; a null source
is a source of its own, after all others; repeated rows are placed one after another;
a text of any length is one document and taken whole or not at all; an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, digests, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Relative weight at progress 0 and 1, by the parity of the source's rank.
RAMPS = ((1.5, 0.5), (0.5, 1.5))
SLICE_HEX = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Null-safe join key of a source."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def source_budgets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, ramps=RAMPS) -> DataFrame:
    """key, source, source_size, target and schedule of each source.

    ``sizes`` has key, source and source_size, one row for each source. Budgets are
    ``share`` times all words by weight, at most ``epochs`` times the source's size;
    what a capped source leaves goes to the others by weight. With the sources
    sorted by cap over weight the capped ones come first, so one pass of running
    sums finds the level at which the rest stand.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1).cast("int")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(float(v)) for v in values]), i % len(values) + 1)
    base = sizes.withColumn("rank", rank).withColumn("weight", pick(weights, F.col("rank"))).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank").asc())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (
        base.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.lit(share) * F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("at", F.row_number().over(by_level))
    )
    final = levels.withColumn("final", F.min_by("level", F.when(F.col("free"), F.col("at"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    start, end = pick([r[0] for r in ramps], F.col("rank")), pick([r[1] for r in ramps], F.col("rank"))
    return final.select("key", "source", "source_size", target.alias("target"), schedule(F.array(F.struct(F.lit(0.0).alias("t"), start.alias("w")), F.struct(F.lit(1.0).alias("t"), end.alias("w")))).alias("schedule"))


def schedule(knots: Column) -> Column:
    """Segments of a piecewise-linear weight schedule with the integral before each.

    ``knots`` is an array of (t, w) from progress 0 to 1; the result's weights are
    scaled so that the integral over all of them is 1.
    """
    area = lambda i: (F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"]) * (F.element_at(knots, i + 1)["w"] + F.element_at(knots, i)["w"]) / 2
    segments = F.sequence(F.lit(1), F.size(knots) - 1)
    total = F.aggregate(segments, F.lit(0.0), lambda a, i: a + area(i))
    return F.transform(
        segments,
        lambda i: F.struct(
            F.element_at(knots, i)["t"].alias("t0"),
            F.element_at(knots, i + 1)["t"].alias("t1"),
            (F.element_at(knots, i)["w"] / total).alias("w0"),
            (F.element_at(knots, i + 1)["w"] / total).alias("w1"),
            (F.aggregate(F.filter(segments, lambda j: j < i), F.lit(0.0), lambda a, j: a + area(j)) / total).alias("before"),
        ),
    )


def progress_at(demand: Column, segments: Column) -> Column:
    """Progress at which the schedule's integral reaches ``demand`` (0 to 1)."""
    s = F.element_at(F.filter(segments, lambda x: x["before"] <= demand), -1)
    d, slope = demand - s["before"], F.try_divide(s["w1"] - s["w0"], s["t1"] - s["t0"])
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * d, F.lit(0.0)))
    return s["t0"] + F.coalesce(F.try_divide(2 * d, s["w0"] + root), F.lit(0.0))


def order_key(doc_id: Column, text: Column) -> Column:
    """Place of a document in its source's fixed order."""
    parts = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.substring(F.md5(parts.cast("binary")), 1, 16)


def placed(sized: DataFrame, work: Scratch, **budget) -> DataFrame:
    """``sized`` (source, size, same, order_key and more) with start (words before it in its source), source_size, target and schedule.

    A row stands for ``same`` equal documents that follow one another.
    """
    sized = work.stored(sized.withColumns({"key": source_key(F.col("source")), "slice": F.substring("order_key", 1, SLICE_HEX)}), "mix-sizes")
    total = F.col("size") * F.col("same")
    slices = work.stored(sized.groupBy("key", "source", "slice").agg(F.sum(total).alias("slice_size")), "mix-slices")
    budgets = source_budgets(slices.groupBy("key", "source").agg(F.sum("slice_size").alias("source_size")), **budget)
    running = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = slices.withColumn("ahead", F.coalesce(F.sum("slice_size").over(running), F.lit(0))).drop("source").join(budgets.drop("source"), "key").drop("slice_size")
    within = Window.partitionBy("key", "slice").orderBy("order_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum(total).over(within), F.lit(0))
    return sized.join(ahead, ["key", "slice"]).withColumn("start", start).drop("key", "slice", "order_key", "ahead")


def copies_and_positions(epochs: int = EPOCHS) -> tuple[Column, list[Column]]:
    """Number of copies that are taken, and the position of each (null if it is not), of rows that ``placed`` made."""
    middle = lambda e: F.lit(e) * F.col("source_size") + F.col("start") + F.col("size") / 2
    takes = lambda e: middle(e) <= F.col("target")
    at = lambda e: F.when(takes(e), F.round(progress_at(F.least(F.coalesce(F.try_divide(middle(e), F.col("target")), F.lit(0.0)), F.lit(1.0)), F.col("schedule")), 6))
    return sum((takes(e).cast("long") for e in range(1, epochs)), takes(0).cast("long")), [at(e) for e in range(epochs)]


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **budget) -> DataFrame:
    """The mix plan: a row for each document, without its text.

    doc_id, size, source_size, target, taken, copies, position (progress of the first
    copy, null if none is taken) and repeat_position (that of the second). A copy is
    taken if the middle of its words is due before the target, so each source ends
    within half a document of it.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), F.lit(1).cast("long").alias("same"), order_key(F.col(doc_id), F.col(text)).alias("order_key"))
    copies, at = copies_and_positions(budget.get("epochs", EPOCHS))
    return placed(sized, Scratch(docs.sparkSession), **budget).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), at[0].alias("position"), at[1].alias("repeat_position"))


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixed(table(spark, sf_dir, "documents"))
    return plan.drop("copies").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every taken copy of every document, sorted by position.

    The columns of ``docs`` with mix_position and mix_copy (0, 1) after them, since files
    read back need not keep an order; columns of these names are replaced. The plan holds
    digests and sizes; texts move once to meet it and once to be sorted. Rows that are
    equal in every column share a plan row and are numbered where they meet it.
    """
    names = [c for c in docs.columns if c not in ("mix_position", "mix_copy")]
    one, two = digests(docs, names)
    sized = docs.select(one.alias("one"), two.alias("two"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("order_key"))
    groups = sized.groupBy("one", "two").agg(F.count("*").alias("same"), F.max("size").alias("size"), F.max("source").alias("source"), F.max("order_key").alias("order_key"))
    kept = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(names)]
    # The digests come last: the planner restates what it knows of a column under each later alias of its inputs.
    met = docs.select(*kept, one.alias("one"), two.alias("two")).join(placed(groups, Scratch(spark)), ["one", "two"])
    nth = F.row_number().over(Window.partitionBy("one", "two").orderBy("one")) - 1
    _, at = copies_and_positions()
    due = met.withColumn("start", F.col("start") + nth * F.col("size"))
    copies = due.select(*[F.col(f"carried_{i}") for i in range(len(names))], "one", F.posexplode(F.array(*at)).alias("mix_copy", "mix_position")).where("mix_position is not null")
    return copies.orderBy("mix_position", "one", "mix_copy").select(*[F.col(f"carried_{i}").alias(c) for i, c in enumerate(names)], "mix_position", "mix_copy")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 16) AS k FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM src),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap,
            CASE rank % 2 WHEN 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS w0, CASE rank % 2 WHEN 0 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS w1 FROM ranked),
levels AS (
  SELECT *, row_number() OVER o AS place,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, rank)),
unfilled AS (SELECT min_by(level, place) AS final_level FROM levels WHERE level * weight <= cap),
budget AS (SELECT source, source_size, w0, w1, least(cap, coalesce(final_level * weight, cap)) AS target FROM levels, unfilled),
due AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, w0, w1,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source),
taken AS (SELECT *, start + size / 2.0::DOUBLE AS m0, source_size + start + size / 2.0::DOUBLE AS m1 FROM due),
demand AS (SELECT *, least(coalesce(m0 / nullif(target, 0), 0), 1.0::DOUBLE) AS u0, least(coalesce(m1 / nullif(target, 0), 0), 1.0::DOUBLE) AS u1 FROM taken)
SELECT doc_id, size, source_size, target, (CASE WHEN m0 <= target THEN size ELSE 0 END + CASE WHEN m1 <= target THEN size ELSE 0 END)::BIGINT AS taken,
       CASE WHEN m0 <= target THEN round(2 * u0 / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * u0, 0))), 6) END AS position,
       CASE WHEN m1 <= target THEN round(2 * u1 / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * u1, 0))), 6) END AS repeat_position
FROM demand
"""
