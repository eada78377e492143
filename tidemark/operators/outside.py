"""Scoring an entity from outside the universe with what is stored: nothing is fitted or rescored.

What the universe leaves behind at each date, as tables:

* ``ladders``: for each (date, figure) the cuts of its sorted values into slices, how many
  values lie before each slice, and how many there are in all; ``rungs``: the distinct
  values of each slice with their numbers. The rank of one more value needs one ladder
  and the rungs of one slice, whatever the number of entities.
* ``peers``: for each (date, sector, figure) the number, mean and squared deviations and
  the three values around the middle: enough for the median and the z-score of the sector
  with one more member in it.

So an outside entity gets the components that scoring the whole universe with it would
give, and its place among the stored final scores. Its presence moves the median of its own
sector, hence its peers' sector-relative price; their order is that of the price itself, so
ladders by sector of both figures give the place it would have among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, half_even
from . import scoring

SLICES = 64
RELATIVE_TO = ("current_pe_ratio", "price_to_sales", "twelve_month_momentum", "free_cash_flow_yield")
#: The ranked figure that an outside entity moves, and what orders a sector by it.
MOVED, BY = "sector_relative_pe", "current_pe_ratio"
RANKED = (*scoring.RISK, *scoring.VALUATION, *scoring.MOMENTUM, *scoring.FUNDAMENTAL, "debt_to_equity")


def _in_sector(figure: str) -> Column:
    return F.concat(F.lit(f"{figure} in "), F.coalesce("sector", F.lit("")))


def _long(rows: DataFrame, keys: list[str], figures: list[str]) -> DataFrame:
    there = [c for c in figures if c in rows.columns]
    return rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in there]).unpivot(keys, there, "figure", "value")


def ladders(long: DataFrame, by: list[str], slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """(ladders, rungs) of the values of each group: sorted in slices, so no task sorts a group."""
    some = long.where("value is not null")
    cuts = some.groupBy(*by).agg(F.percentile_approx("value", [i / slices for i in range(1, slices)], 10_000).alias("cuts"))
    values = some.join(cuts, by).groupBy(*by, _slice(F.col("value")).alias("slice"), "value").agg(F.count("*").alias("n"))
    sums = values.groupBy(*by, "slice").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("slice", "n"))).alias("per"))
    count = lambda i: F.coalesce(F.try_element_at("per", i), F.lit(0))
    running = F.aggregate(F.sequence(F.lit(0), F.lit(slices)), F.array(F.lit(0).cast("long")), lambda a, i: F.concat(a, F.array(F.element_at(a, -1) + count(i))))
    ladder = cuts.join(sums, by).withColumn("starts", running).select(*by, "cuts", "starts", F.element_at("starts", -1).alias("total"))
    within = Window.partitionBy(*by, "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    rungs = values.join(ladder.select(*by, "starts"), by).withColumn("before", F.get("starts", F.col("slice")) + F.coalesce(F.sum("n").over(within), F.lit(0)))
    return ladder, rungs.select(*by, "slice", "value", "n", "before")


def _slice(value: Column) -> Column:
    return F.size(F.filter("cuts", lambda c: c < value))


def peers(universe: DataFrame, figures: tuple[str, ...] = RELATIVE_TO, by: str = "feature_date") -> DataFrame:
    """Number, moments and middle values of each sector's figures at each date."""
    keys = [by, "sector", "figure"]
    long = _long(universe, [by, "sector"], list(figures)).where("value is not null")
    _, rungs = ladders(long, keys)
    moments = long.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("m2"))
    at = lambda k: F.max(F.when((F.col("before") <= k) & (F.lit(k) < F.col("before") + F.col("size")), F.col("value")))
    middle = rungs.withColumnRenamed("n", "size").join(moments.select(*keys, F.col("n").alias("all")), keys)
    n = F.col("all")
    low, mid, high = F.floor((n - 2 - n % 2) / 2), F.floor((n - 1) / 2), F.floor((n + n % 2) / 2)
    return moments.join(middle.groupBy(*keys).agg(*[at(k).alias(c) for k, c in ((low, "low"), (mid, "mid"), (high, "high"))]), keys)


def with_sector(rows: DataFrame, stored: DataFrame, by: str = "feature_date") -> DataFrame:
    """Adds the sector-relative features as if each row were a member of its sector at its date."""
    wide = stored.groupBy(by, "sector").agg(*[F.max(F.when(F.col("figure") == c, F.struct("n", "mean", "m2", "low", "mid", "high"))).alias(f"_{c}") for c in RELATIVE_TO])
    out = rows.join(wide, [by, "sector"], "left")

    def median(c: str) -> Column:
        x, s = F.col(c), F.col(f"_{c}")
        odd = (s["mid"] + F.when(s["n"] == 1, x).otherwise(clamp2(x, s["low"], s["high"]))) / 2
        return F.when(s.isNull(), x).when(s["n"] % 2 == 1, odd).otherwise(clamp2(x, s["low"], s["high"]))

    def count(c: str) -> Column:
        return F.coalesce(F.col(f"_{c}")["n"], F.lit(0)) + 1

    def zscore(c: str) -> Column:
        x, s = F.col(c), F.col(f"_{c}")
        mean = s["mean"] + (x - s["mean"]) / count(c)
        sd = F.sqrt((s["m2"] + (x - s["mean"]) * (x - mean)) / s["n"])
        return F.when((count(c) >= 3) & (sd > 0), (x - mean) / sd)

    ratio = lambda c: F.when(median(c) > 0, F.col(c) / median(c) - 1)
    made = {
        "sector_relative_pe": ratio("current_pe_ratio"),
        "sector_relative_ps": ratio("price_to_sales"),
        "sector_relative_momentum": F.col("twelve_month_momentum") - median("twelve_month_momentum"),
        "sector_relative_fcf_yield": F.when(count("free_cash_flow_yield") >= 3, F.col("free_cash_flow_yield") - median("free_cash_flow_yield")),
        "peer_momentum_zscore": zscore("twelve_month_momentum"),
        "peer_valuation_zscore": zscore("current_pe_ratio"),
    }
    return out.withColumns(made).drop(*[f"_{c}" for c in RELATIVE_TO])


def clamp2(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def placed(long: DataFrame, ladder: DataFrame, rungs: DataFrame, keys: list[str], by: str = "feature_date") -> DataFrame:
    """Rows (keys, figure, value) with ``below``, ``equal`` and ``total``: where the value stands among the stored ones."""
    group = [by, "figure"]
    at = long.join(ladder, group, "left").withColumn("slice", F.when(F.col("value").isNotNull(), _slice(F.col("value"))))
    met = at.join(rungs.select(*group, "slice", F.col("value").alias("_v"), F.col("n").alias("_n")), [*group, "slice"], "left")
    less, same = (F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)) for c in (F.col("_v") < F.col("value"), F.col("_v") == F.col("value")))
    start = F.coalesce(F.max(F.get("starts", F.col("slice"))), F.lit(0))
    return met.groupBy(*keys, "figure").agg(F.max("value").alias("value"), (start + less).alias("below"), same.alias("equal"), F.coalesce(F.max("total"), F.lit(0)).alias("total"))


def scored(rows: DataFrame, ladder: DataFrame, rungs: DataFrame, used: dict, by: str = "feature_date") -> DataFrame:
    """Components, final score, class and place of outside rows among the stored universe.

    ``rows`` have features, predictions and data_quality_score; ``used`` says which
    predictions count, as for scoring.scores. A figure counts from three values on, the
    row's own included.
    """
    keys = [by, "ticker"]
    figures = list(dict.fromkeys([c for c in (*RANKED, used["excess"]) if c and c in rows.columns]))
    asked = _long(rows, keys, figures).withColumns({"role": F.col("figure"), "sign": F.lit(1)})
    own = lambda c, sign: rows.select(*keys, _in_sector(c).alias("figure"), F.col(c).cast("double").alias("value"), F.lit(MOVED).alias("role"), F.lit(sign).alias("sign"))
    asked = asked.unionByName(own(MOVED, -1)).unionByName(own(BY, 1))  # among its sector by the price itself
    each = placed(asked, ladder, rungs, [*keys, "role", "sign"], by)
    first = lambda c: F.max(F.when(F.col("figure") == F.col("role"), F.col(c)))
    ranks = each.groupBy(*keys, F.col("role").alias("figure")).agg(first("value").alias("value"), first("total").alias("total"), *[F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("below", "equal")])
    share = (F.col("below") + 1 + F.col("equal") / 2) / (F.col("total") + 1)
    of = ranks.select(*keys, "figure", F.struct(F.coalesce(F.when(F.col("value").isNotNull(), share * 100), F.lit(50.0)).alias("score"), (F.col("total") + F.col("value").isNotNull().cast("int") >= 3).alias("usable")).alias("r"))
    wide = of.groupBy(*keys).agg(*[F.max(F.when(F.col("figure") == c, F.col("r"))).alias(f"_{c}") for c in figures])
    out = rows.join(wide, keys)

    def mean(plain: tuple[str, ...], inverse: tuple[str, ...] = ()) -> Column:
        use = [c for c in (*plain, *inverse) if c in figures]
        n = sum((F.col(f"_{c}")["usable"].cast("int") for c in use), F.lit(0))
        score = lambda c: 100 - F.col(f"_{c}")["score"] if c in inverse else F.col(f"_{c}")["score"]
        total = sum((F.when(F.col(f"_{c}")["usable"], score(c)).otherwise(0.0) for c in use), F.lit(0.0))
        return F.when(n > 0, total / n).otherwise(50.0)

    p, x, votes = used["probability"], used["excess"], used["votes"]
    rule = lambda c: F.coalesce((F.col(c) >= (0.5 if c == p else 0.0)).cast("int"), F.lit(0))
    parts = {
        "probability_score": F.coalesce(clamp(F.col(p) * 100, 0.0, 100.0), F.lit(50.0)) if p else F.lit(50.0),
        "excess_score": F.col(f"_{x}")["score"] if x else F.lit(50.0),
        "agreement_score": sum((rule(c) for c in votes), F.lit(0)) * 100.0 / len(votes) if votes else F.lit(50.0),
        "risk_score": 100 - mean(scoring.RISK),
        "valuation_score": mean((), scoring.VALUATION),
        "momentum_score": mean(scoring.MOMENTUM),
        "fundamental_score": mean(scoring.FUNDAMENTAL, ("debt_to_equity",)),
    }
    weighed = {"probability_score": "probability", "excess_score": "excess", "agreement_score": "agreement", "risk_score": "risk", "valuation_score": "valuation"}
    out = out.withColumns(parts).drop(*[f"_{c}" for c in figures])
    total = sum((F.col(c) * scoring.WEIGHTS[k] for c, k in weighed.items()), F.coalesce("data_quality_score", F.lit(50.0)) * scoring.WEIGHTS["data_quality"])
    out = out.withColumn("final_score", half_even(total, 2))
    out = out.withColumns({"class": scoring.classify(F.col("probability"), F.col("predicted_excess"), F.col("agreement_score"), F.col("data_quality_score")), "label": scoring.label_of_score(F.col("final_score")), "would_pass": F.col("weakest") > 0})
    final = placed(_long(out, keys, ["final_score"]), ladder, rungs, keys, by)
    rank = 1 + F.col("total") - F.col("below")  # those with at least its score, and itself
    return out.join(final.select(*keys, rank.alias("rank"), (rank / (F.col("total") + 1)).alias("percentile")), keys)


def stored_state(universe: DataFrame, used: dict, by: str = "feature_date") -> dict[str, DataFrame]:
    """The tables that a scored universe leaves behind: peers, ladders, rungs."""
    figures = [c for c in dict.fromkeys((*RANKED, used["excess"], "final_score")) if c]
    long = _long(universe, [by], figures)
    for c in (MOVED, BY):
        long = long.unionByName(universe.select(by, _in_sector(c).alias("figure"), F.col(c).cast("double").alias("value")))
    ladder, rungs = ladders(long, [by, "figure"])
    return {"peers": peers(universe, by=by), "ladders": ladder, "rungs": rungs}
