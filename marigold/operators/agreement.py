"""Agreement of raters: Krippendorff's alpha from coincidences that add up over periods, its bootstrap, two-way intraclass correlation.

A coincidence matrix says how often two values meet within a unit, each unit's pairs weighted by one over its number of ratings less one.
Matrices of disjoint sets of units add up, so they are the state that weeks keep: any range of weeks is the sum of theirs. Values are
categories or scores of a scale, MAX_VALUES distinct ones at most; more is an error. Null units and values take no part; units of a
single rating have no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values that a coincidence matrix may have.
MAX_VALUES = 1000
WEEK = 604_800


def _checked(ratings: DataFrame, value: str) -> None:
    found = ratings.select(value).distinct().limit(MAX_VALUES + 1).count()
    if found > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} distinct values; put scores into classes first")


def coincidences(ratings: DataFrame, *, unit: str, value: str, period: str | None = None) -> DataFrame:
    """(period, c, v, o): the coincidences of values c and v; period is 0 for all without one. Units are those of one period."""
    _checked(ratings, value)
    at = F.col(period) if period else F.lit(0)
    cells = ratings.select(at.alias("period"), F.col(unit).alias("u"), F.col(value).alias("v")).dropna().groupBy("period", "u", "v").agg(F.count("*").alias("n"))
    units = cells.groupBy("period", "u").agg(F.collect_list(F.struct("v", "n")).alias("own"), F.sum("n").alias("m")).where("m > 1")  # MAX_VALUES at most
    pairs = units.select("period", "m", "own", F.explode("own").alias("a")).select("period", "m", "a", F.explode("own").alias("b"))
    met = (F.col("a.n") * (F.col("b.n") - F.when(F.col("a.v") == F.col("b.v"), 1).otherwise(0))) / (F.col("m") - 1)
    return pairs.groupBy("period", F.col("a.v").alias("c"), F.col("b.v").alias("v")).agg(F.sum(met).alias("o")).where("o > 0")


def merged(states: DataFrame, last: int) -> DataFrame:
    """Coincidences of each period and the `last` - 1 before it, of numbered periods; only periods that there are."""
    shifted = states.select(F.explode(F.sequence("period", F.col("period") + (last - 1))).alias("period"), "c", "v", "o")
    known = states.select("period").distinct()
    return shifted.join(known, "period", "left_semi").groupBy("period", "c", "v").agg(F.sum("o").alias("o"))


def alpha(states: DataFrame, metric: str = "nominal") -> DataFrame:
    """(period, alpha, pairable): reliability by the metric "nominal", "ordinal" or "interval"; 1 where all values are equal.

    An ordinal distance is the number of ratings between two values, half of their own included: the distance of their middle ranks."""
    margins = states.groupBy("period", "c").agg(F.sum("o").alias("n"))
    if metric == "nominal":
        differs = F.when(F.col("c") == F.col("v"), 0.0).otherwise(1.0)
        observed = states.groupBy("period").agg(F.sum(F.col("o") * differs).alias("observed"), F.sum("o").alias("n"))
        expected = margins.groupBy("period").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("same")).select("period", (F.col("t") * F.col("t") - F.col("same")).alias("expected"))
    elif metric in ("ordinal", "interval"):
        below = F.sum("n").over(Window.partitionBy("period").orderBy("c")) - F.col("n") / 2  # MAX_VALUES rows a period
        place = margins.select("period", "c", "n", (below if metric == "ordinal" else F.col("c").cast("double")).alias("x"))
        observed = states.join(place.select("period", "c", F.col("x").alias("x")), ["period", "c"]).join(place.select("period", F.col("c").alias("v"), F.col("x").alias("y")), ["period", "v"])
        observed = observed.groupBy("period").agg(F.sum(F.col("o") * F.pow(F.col("x") - F.col("y"), 2)).alias("observed"), F.sum("o").alias("n"))
        means = place.groupBy("period").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"), F.sum("n").alias("t"))
        expected = place.join(means, "period").groupBy("period", "t").agg(F.sum(F.col("n") * F.pow(F.col("x") - F.col("mean"), 2)).alias("s")).select("period", (2 * F.col("t") * F.col("s")).alias("expected"))
    else:
        raise ValueError("metric: nominal, ordinal or interval")
    share = F.col("observed") / (F.col("expected") / (F.col("n") - 1))
    return observed.join(expected, "period").select("period", F.round(F.when(F.col("expected") == 0, 1.0).otherwise(1 - share), 6).alias("alpha"), F.col("n").alias("pairable"))


def week_of(time: Column) -> Column:
    """Number of the seven days since 1970 that a time falls into."""
    return F.floor(F.unix_timestamp(time.cast("timestamp")) / WEEK).cast("int")


def weekly_reliability(ratings: DataFrame, *, unit: str, value: str, week: str, metric: str = "nominal", last: int = 3, threshold: float = 0.667) -> DataFrame:
    """(week, alpha, merged, moving, recalibrate): of each week, of the last weeks' ratings together, the mean of the last weeks' alphas
    (of those that there are), and whether that mean is below the threshold."""
    states = coincidences(ratings, unit=unit, value=value, period=week)
    each, together = alpha(states, metric).drop("pairable"), alpha(merged(states, last), metric).select("period", F.col("alpha").alias("merged"))
    after = each.select(F.explode(F.sequence("period", F.col("period") + (last - 1))).alias("period"), F.col("alpha").alias("one"))
    moving = after.groupBy("period").agg(F.round(F.avg("one"), 6).alias("moving"))
    found = each.join(together, "period").join(moving, "period")
    return found.select(F.col("period").alias("week"), "alpha", "merged", "moving", (F.col("moving") < threshold).alias("recalibrate"))


def poisson_weight(key: Sequence[Column]) -> Column:
    """A number drawn from the Poisson distribution of mean 1 by a hash of the key: the same in any run."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in key)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    bounds = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10)]
    return sum((F.when(draw >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def bootstrap_alpha(ratings: DataFrame, *, unit: str, value: str, replicates: int = 200, share: float = 0.95) -> DataFrame:
    """(low, high, replicates): the middle `share` of nominal alphas over resamples of units. Each unit is in each resample as often as its
    Poisson weight says, so that resampling is one pass of additions."""
    _checked(ratings, value)
    cells = ratings.select(F.col(unit).alias("u"), F.col(value).alias("v")).dropna().groupBy("u", "v").agg(F.count("*").alias("n"))
    units = cells.groupBy("u").agg(F.collect_list(F.struct("v", "n")).alias("own"), F.sum("n").alias("m")).where("m > 1")
    drawn = units.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", poisson_weight([F.col("u"), F.col("r")])).where("w > 0")
    agree = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["n"] * (x["n"] - 1))
    sums = drawn.groupBy("r").agg(F.sum(F.col("w") * (F.col("m") * (F.col("m") - 1) - agree) / (F.col("m") - 1)).alias("observed"), F.sum(F.col("w") * F.col("m")).alias("n"))
    margins = drawn.select("r", "w", F.explode("own").alias("x")).groupBy("r", "x.v").agg(F.sum(F.col("w") * F.col("x.n")).alias("n"))
    same = margins.groupBy("r").agg(F.sum(F.col("n") * F.col("n")).alias("same"))
    total, expected = F.col("n"), F.col("n") * F.col("n") - F.col("same")
    each = sums.join(same, "r").select("r", F.when(expected == 0, 1.0).otherwise(1 - F.col("observed") * (total - 1) / expected).alias("alpha"))
    ends = [(1 - share) / 2, (1 + share) / 2]
    return each.agg(F.percentile("alpha", F.array(*(F.lit(e) for e in ends))).alias("p"), F.count("*").alias("replicates")).select(F.round(F.col("p")[0], 6).alias("low"), F.round(F.col("p")[1], 6).alias("high"), "replicates")


def icc_two_way(ratings: DataFrame, *, unit: str, rater: str, value: str) -> DataFrame:
    """(icc_agreement, icc_consistency, units, raters, incomplete): two-way intraclass correlations of single ratings, absolute agreement
    and consistency, from the mean squares of units, raters and rest. Several ratings of a rater count as their mean. The model needs every
    rater at every unit: `incomplete` units lack one and take no part."""
    cells = ratings.select(F.col(unit).alias("u"), F.col(rater).alias("r"), F.col(value).cast("double").alias("x")).dropna().groupBy("u", "r").agg(F.avg("x").alias("x"))
    size = cells.agg(F.count_distinct("r").alias("k"))
    rows = cells.groupBy("u").agg(F.count("*").alias("n"), F.avg("x").alias("row"))
    marked = rows.join(F.broadcast(size), F.lit(True)).withColumn("whole", F.col("n") == F.col("k"))
    whole = cells.join(marked.where("whole").select("u", "row", "k"), "u")
    grand = whole.agg(F.avg("x").alias("grand"), F.count_distinct("u").alias("n"))
    columns = whole.groupBy("r").agg(F.avg("x").alias("column"))
    centred = whole.join(F.broadcast(grand), F.lit(True)).join(columns, "r")
    sums = centred.agg(
        F.sum(F.pow(F.col("row") - F.col("grand"), 2)).alias("rows"), F.sum(F.pow(F.col("column") - F.col("grand"), 2)).alias("columns"),
        F.sum(F.pow(F.col("x") - F.col("row") - F.col("column") + F.col("grand"), 2)).alias("rest"), F.max("n").alias("n"), F.max("k").alias("k"),
    )
    n, k = F.col("n"), F.col("k")
    r, c, e = F.col("rows") / (n - 1), F.col("columns") / (k - 1), F.col("rest") / ((n - 1) * (k - 1))
    left = marked.agg(F.count_if(~F.col("whole")).alias("incomplete"))
    icc = lambda below: F.round(F.when((n > 1) & (k > 1) & (below != 0), (r - e) / below), 6)
    found = sums.select(icc(r + (k - 1) * e + k * (c - e) / n).alias("icc_agreement"), icc(r + (k - 1) * e).alias("icc_consistency"), F.coalesce(n, F.lit(0)).alias("units"), F.coalesce(k, F.lit(0)).alias("raters"))
    return found.join(F.broadcast(left), F.lit(True))
