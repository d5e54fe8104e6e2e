"""Statistics that depend on the order of a column's values, exact at any size.

Values are never gathered in one task: counts between approximate cuts say which cell holds a
rank, only that cell is looked at again, and equal values are counted before they are ordered.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import saved

#: Cells that a range of values is cut into; distinct values of a cell that are ordered without another cut.
CELLS, FEW = 256, 8192
#: Distinct values of a range that is ordered in one task; ranks up to which their ranges are broadcast.
RANGE, BROADCAST = 1 << 17, 100_000

# Rational approximation of the inverse normal distribution (relative error 1.15e-9).
_MIDDLE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
_TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))
_EDGE = 0.02425

# Royston's polynomials for the two outer weights, and for the mean and log deviation of the statistic.
_LAST, _LAST_BUT_ONE = (-2.706056, 4.434685, -2.07119, -0.147981, 0.221157), (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
_SMALL = ((-0.0006714, 0.025054, -0.39978, 0.544), (-0.0020322, 0.062767, -0.77857, 1.3822))
_LARGE = ((0.0038915, -0.083751, -0.31082, -1.5861), (0.0030302, -0.082676, -0.4803))


def _poly(x, factors):
    """The polynomial of numbers or Columns, highest power first."""
    return reduce(lambda total, k: total * x + k, factors[1:], x * 0 + factors[0])


def normal_quantile(p: Column) -> Column:
    """The standard normal value below which the share ``p`` lies; null outside (0, 1)."""
    far = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _poly(far, _TAIL[0]) / _poly(far, _TAIL[1])
    q = p - 0.5
    middle = q * _poly(q * q, _MIDDLE[0]) / _poly(q * q, _MIDDLE[1])
    return F.when((p > 0) & (p < 1), F.when(p < _EDGE, tail).when(p > 1 - _EDGE, -tail).otherwise(middle))


def _selected(values: DataFrame, wanted: DataFrame, few: int) -> DataFrame:
    """Rows (g, v, n) of distinct values, and (g, rank) of ranks from 0 -> (g, rank, v)."""
    found = None
    here = values.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("distinct"))
    todo = wanted.join(here, "g").select("g", "rank", F.lit(0).cast("long").alias("below"), "low", "high", "distinct")
    while True:
        todo = saved(todo)
        # a join by group alone would sort all values of a group in one task
        dealt = F.broadcast if todo.count() <= BROADCAST else lambda ranges: ranges
        near = todo.filter(F.col("distinct") <= few)
        ranges = near.select("g", "low", "high", "below").distinct()
        inside = values.join(dealt(ranges), "g").filter("v between low and high")
        upto = F.sum("n").over(W.partitionBy("g", "low").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
        steps = inside.withColumn("upto", F.col("below") + upto).withColumn("before", F.col("upto") - F.col("n"))
        got = near.select("g", "rank", "low").join(steps.select("g", "low", "v", "before", "upto"), ["g", "low"]).filter("rank >= before and rank < upto").select("g", "rank", "v")
        found = got if found is None else found.unionByName(got)
        far = todo.filter(F.col("distinct") > few)
        if far.isEmpty():
            return found
        ranges = far.select("g", "low", "high", "below").distinct()
        inside = values.join(dealt(ranges), "g").filter("v between low and high").select("g", F.col("low").alias("of"), "below", "v", "n")
        # cuts by the values' order, so that a range of any shape loses all but a few parts in 256 of its values
        cuts = inside.groupBy("g", "of").agg(F.percentile_approx("v", [i / CELLS for i in range(1, CELLS)], 8 * CELLS).alias("cuts"))
        cells = inside.join(cuts, ["g", "of"]).withColumn("cell", F.size(F.filter("cuts", lambda c: c < F.col("v"))))
        cells = cells.groupBy("g", "of", "below", "cell").agg(F.sum("n").alias("n"), F.count("*").alias("distinct"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.col("below") + F.sum("n").over(W.partitionBy("g", "of").orderBy("cell")) - F.col("n")
        cells = cells.select("g", "of", before.alias("below"), "n", "distinct", "low", "high")
        todo = far.select("g", "rank", F.col("low").alias("of")).join(cells, ["g", "of"]).filter("rank >= below and rank < below + n").select("g", "rank", "below", "low", "high", "distinct")


def quantiles(df: DataFrame, value: str, shares: list[float], by: str | None = None, few: int = FEW) -> DataFrame:
    """Rows (by, share, quantile): exact quantiles with linear interpolation; nulls and NaN take no part, a group without values gives no row.

    Each round keeps about one part in 256 of the distinct values around a rank, so 10**12 of them take four rounds or
    so; a heavily repeated value is one row with its count.
    """
    v = F.col(value).cast("double")
    g = F.col(by) if by else F.lit("all")
    rows = df.select(F.struct(g.alias("by")).alias("g"), F.when(v == 0, 0.0).otherwise(v).alias("v")).filter("v is not null and not isnan(v)")
    values = saved(rows.groupBy("g", "v").agg(F.count("*").alias("n")))
    at = F.explode(F.array(*[F.lit(float(s)) for s in sorted(set(shares))])).alias("share")
    places = values.groupBy("g").agg(F.sum("n").alias("n")).select("g", at, "n").withColumn("place", F.col("share") * (F.col("n") - 1))
    places = saved(places.select("g", "share", "place", F.floor("place").alias("lower"), F.ceil("place").alias("upper")))
    wanted = places.select("g", F.explode(F.array("lower", "upper")).alias("rank")).distinct()
    chosen = saved(_selected(values, wanted, few))
    lower = chosen.select("g", F.col("rank").alias("lower"), F.col("v").alias("a"))
    upper = chosen.select("g", F.col("rank").alias("upper"), F.col("v").alias("b"))
    out = places.join(lower, ["g", "lower"]).join(upper, ["g", "upper"])
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.col("lower")))
    return out.select(F.col("g.by").alias(by or "by"), "share", between.alias("quantile"))


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("w", "z", "p")]))
def _royston(n: pd.Series, spread: pd.Series, mx: pd.Series, mm: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
    """One row for each group: W, its normal score and p value, from sums over the group's ranks."""
    normal = NormalDist()

    def one(n: int, spread: float, mx: float, mm: float, first: list[float], last: list[float]) -> tuple[float | None, ...]:
        if n < 4 or not spread > 0:
            return None, None, None
        m = [normal.inv_cdf((n - i - 0.375) / (n + 0.25)) for i in (0, 1)]
        u = 1 / math.sqrt(n)
        a = [_poly(u, (*k, x / math.sqrt(mm))) for k, x in zip((_LAST, _LAST_BUT_ONE), m)]
        outer = 2 if n > 5 else 1
        a, m = a[:outer], m[:outer]
        wide = [y - x for x, y in zip(first, last)]  # of the outermost pair, and of the next
        rest = math.sqrt((mm - 2 * sum(x * x for x in m)) / (1 - 2 * sum(x * x for x in a)))
        w = min(1.0, (sum(x * y for x, y in zip(a, wide)) + (mx - sum(x * y for x, y in zip(m, wide))) / rest) ** 2 / spread)
        off = math.log(max(1 - w, 1e-300))
        if n <= 11:
            top = 0.459 * n - 2.273
            z = math.inf if off >= top else (-math.log(top - off) - _poly(n, _SMALL[0])) / math.exp(_poly(n, _SMALL[1]))
        else:
            z = (off - _poly(math.log(n), _LARGE[0])) / math.exp(_poly(math.log(n), _LARGE[1]))
        return w, z, math.erfc(z / math.sqrt(2)) / 2

    return pd.DataFrame([one(*row) for row in zip(n, spread, mx, mm, first, last)], columns=["w", "z", "p"], dtype="float64")


def shapiro_wilk(df: DataFrame, value: str, by: str | None = None, few: int = RANGE) -> DataFrame:
    """Shapiro and Wilk's W of each group with Royston's approximation: (by, n, w, z, p); small p speaks against a normal distribution.

    Every value takes part, ranked in two levels (about ``few`` distinct values to a bucket).  Below four values, or if all
    are equal, w is null.  Published p values reach to 5000 rows; beyond, p extends the same formula.
    """
    v = F.col(value).cast("double")
    g = F.col(by) if by else F.lit("all")
    rows = df.select(F.struct(g.alias("by")).alias("g"), v.alias("v")).filter("v is not null and not isnan(v)")
    counted = saved(rows.groupBy("g", "v").agg(F.count("*").alias("k")))
    whole = counted.groupBy("g").agg(F.sum("k").alias("n"), (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"), F.count("*").alias("distinct"))
    # ranges of the ordered values are the buckets; a value is in one row, so they are even whatever the values are
    placed = saved(counted.repartitionByRange(max(1, -(-counted.count() // few)), "g", "v").withColumn("bucket", F.spark_partition_id()))
    held = placed.groupBy("g", "bucket").agg(F.sum("k").alias("held"))
    held = held.select("g", "bucket", (F.sum("held").over(W.partitionBy("g").orderBy("bucket")) - F.col("held")).alias("below")).join(whole, "g")
    within = F.sum("k").over(W.partitionBy("g", "bucket").orderBy("v").rowsBetween(W.unboundedPreceding, 0)) - F.col("k")
    ranked = placed.withColumn("before", within).join(held, ["g", "bucket"]).withColumn("before", F.col("before") + F.col("below"))
    ranked = ranked.withColumn("rank", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("k") - 1)))
    ranked = ranked.withColumn("m", normal_quantile((F.col("rank") + 0.625) / (F.col("n") + 0.25))).withColumn("x", F.col("v") - F.col("mean"))
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("x")))
    last = F.col("n") - 1
    sums = ranked.groupBy("g", "n").agg(
        F.sum(F.col("x") * F.col("x")).alias("spread"), F.sum(F.col("m") * F.col("x")).alias("mx"), F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.array(at(F.lit(0)), at(F.lit(1))).alias("first"), F.array(at(last), at(last - 1)).alias("last"), F.max("distinct").alias("distinct"),
    )
    got = sums.withColumn("got", _royston("n", F.when(F.col("distinct") > 1, F.col("spread")).otherwise(0.0), "mx", "mm", "first", "last"))
    return got.select(F.col("g.by").alias(by or "by"), "n", "got.*")
