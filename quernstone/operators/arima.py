"""Seasonal autoregressive models with moving averages, for many series side by side.

Models are fitted by two regressions.  A long autoregression gives each day's innovation; then the value is
regressed on earlier values and earlier innovations.  Both need nothing but sums of products, which Spark adds up by
series, and the regressors of every order of the grid are among those of the largest one: one pass over the data gives all
orders, and what reaches Python is one small matrix a series.  Seasonal terms are added to the others, not multiplied with them.

Days are averaged, sorted, and counted as steps, so a missing day is no step.  Null days and values are left out, a
series of fewer than ``LEAST`` days has no forecast, and a constant series is forecast as it is.  A series
has one row a day, so it is short beside the table; its lags are taken in one window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import saved

#: The orders (p, d, q) that are compared, each without and with a seasonal term of order (1, 0, 1); least days; 80 % of a normal distribution.
ORDERS = ((1, 1, 1), (2, 1, 1), (1, 1, 0), (0, 1, 1), (1, 0, 0))
LEAST, WIDE = 16, 1.2815515655446004
#: Lags of the long autoregression, beside the seasonal ones.
LONG = 6


def days_of(df: DataFrame, day: str, value: str, group: str | None = None) -> DataFrame:
    """(grp, day, value, n, days): the mean of each day, its number in the series from 1, and the length of the series."""
    rows = df.select((F.col(group).cast("string") if group else F.lit("all")).alias("grp"), F.to_date(day).alias("day"), F.col(value).cast("double").alias("value")).dropna()
    rows = rows.filter(~F.isnan("value")).groupBy("grp", "day").agg(F.avg("value").alias("value"))
    whole = W.partitionBy("grp")
    return rows.select("*", F.row_number().over(whole.orderBy("day")).alias("n"), F.count("*").over(whole).alias("days"))


def horizon_of(days: Column, given: int | None = None) -> Column:
    """The given number of steps, or a fifth of the series within 3 and 24; at most a third of it and at least 2."""
    usual = F.lit(given) if given else F.greatest(F.lit(3), F.least(F.lit(24), F.round(days * 0.2)))
    return F.greatest(F.lit(2), F.least(usual, F.floor(days / 3))).cast("int")


def _products(columns: list[Column]) -> Column:
    """The sums of products of all pairs of columns, row by row of the upper triangle."""
    return F.array(*[F.sum(columns[i] * columns[j]) for i in range(len(columns)) for j in range(i, len(columns))])


def _square(sums: np.ndarray) -> np.ndarray:
    wide = int((np.sqrt(8 * len(sums) + 1) - 1) / 2)
    out = np.zeros((wide, wide))
    out[np.triu_indices(wide)] = sums
    return out + np.triu(out, 1).T


def _regress(products: np.ndarray, used: list[int]) -> tuple[np.ndarray, float]:
    """Factors of the used columns for the last one, and the squares that are left."""
    w = np.linalg.lstsq(products[np.ix_(used, used)], products[used, -1], rcond=1e-12)[0]
    return w, max(float(products[-1, -1] - w @ products[used, -1]), 0.0)


@F.pandas_udf(ArrayType(DoubleType()))
def _long_factors(sums: pd.Series) -> pd.Series:
    squares = [_square(np.asarray(s, float)) for s in sums]
    return pd.Series([_regress(m, list(range(len(m) - 1)))[0].tolist() for m in squares], dtype=object)


def _lags(column: str, lags: list[int]) -> list[Column]:
    return [F.lag(column, k).over(W.partitionBy("grp", "d").orderBy("n")) for k in lags]


def _innovations(days: DataFrame, period: int, differences: list[int]) -> DataFrame:
    """(grp, d, n, days, seasonal, mean, scale, y, w, e): scaled values, their differences and innovations (null where lags are missing)."""
    whole = W.partitionBy("grp")
    spread = F.stddev_pop("value").over(whole)
    rows = days.filter(F.col("days") >= LEAST).withColumns({"mean": F.avg("value").over(whole), "scale": F.when(spread > 0, spread).otherwise(1.0)})
    rows = rows.withColumn("seasonal", (F.lit(period) > 1) & (F.col("days") >= 2 * period + 8))
    rows = rows.withColumn("y", (F.col("value") - F.col("mean")) / F.col("scale"))
    before = F.lag("y").over(whole.orderBy("n"))
    rows = rows.withColumn("before", before).withColumn("d", F.explode(F.array(*map(F.lit, differences))))
    rows = rows.withColumn("w", F.when(F.col("d") == 0, F.col("y")).otherwise(F.col("y") - F.col("before")))
    far = [period, period + 1] if period > LONG else []
    near = [f"_l{i}" for i in range(LONG)]
    season = [f"_s{i}" for i in range(len(far))]
    rows = rows.withColumns(dict(zip(near, _lags("w", list(range(1, LONG + 1))))) | {s: F.when(F.col("seasonal"), c).otherwise(0.0) for s, c in zip(season, _lags("w", far))})
    xs = [F.lit(1.0), *map(F.col, near + season)]
    known = F.col("w").isNotNull()
    for c in near + season:
        known = known & F.col(c).isNotNull()
    rows = saved(rows.withColumn("known", known))
    factors = rows.filter("known").groupBy("grp", "d").agg(_products([*xs, F.col("w")]).alias("sums")).select("grp", "d", _long_factors("sums").alias("factors"))
    rows = rows.join(factors, ["grp", "d"])
    guess = sum((F.col("factors")[i] * x for i, x in enumerate(xs)), F.lit(0.0))
    return rows.select("grp", "d", "n", "days", "seasonal", "mean", "scale", "y", "w", F.when(F.col("known"), F.col("w") - guess).alias("e"))


#: The regressors of the largest order: a constant, two lags of the value and the season's, one lag of the innovation and the season's.
_TERMS = ("c", "ar1", "ar2", "ar_season", "ma1", "ma_season")


def _terms(p: int, q: int, seasonal: bool) -> list[int]:
    return [0, *([1] if p > 0 else []), *([2] if p > 1 else []), *([3] if seasonal else []), *([4] if q > 0 else []), *([5] if seasonal else [])]


def _grid(orders: tuple[tuple[int, int, int], ...]):
    @F.pandas_udf("array<struct<p:int,q:int,season:boolean,aic:double,variance:double,factors:array<double>>>")
    def each(sums: pd.Series, rows: pd.Series, seasonal: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for s, n, has, diff in zip(sums, rows, seasonal, d):
            m, found = _square(np.asarray(s, float)), []
            for p, q in [(p, q) for p, k, q in orders if k == diff]:
                for season in (False, True) if has else (False,):
                    used = _terms(p, q, season)
                    w, left = _regress(m, used)
                    full = np.zeros(len(_TERMS))
                    full[used] = w
                    variance = max(left / n, 1e-12)
                    found.append({"p": p, "q": q, "season": season, "aic": float(n * np.log(variance) + 2 * (len(used) + 1)), "variance": variance, "factors": full.tolist()})
            out.append(found)
        return pd.Series(out, dtype=object)

    return each


def _candidates(rows: DataFrame, period: int, orders: tuple[tuple[int, int, int], ...]) -> DataFrame:
    season = period if period > 1 else 1
    ar, ma = _lags("w", [1, 2, season]), _lags("e", [1, season])
    only = lambda c: F.when(F.col("seasonal"), c).otherwise(0.0)
    wide = rows.withColumns({"ar1": ar[0], "ar2": ar[1], "ar_season": only(ar[2]), "ma1": ma[0], "ma_season": only(ma[1])})
    # All orders are held against the same days, so that their criteria compare.
    first = 1 + LONG + 1 + F.when(F.col("seasonal"), 2 * season + 1).otherwise(0)
    wide = wide.filter(F.col("n") > F.least(first, F.col("days") - 8)).dropna(subset=["w", *_TERMS[1:]])
    sums = wide.groupBy("grp", "d", "seasonal").agg(_products([F.lit(1.0), *map(F.col, _TERMS[1:]), F.col("w")]).alias("sums"), F.count("*").alias("rows"))
    found = sums.filter("rows >= 4").select("grp", "d", "rows", F.explode(_grid(orders)("sums", "rows", "seasonal", "d")).alias("f"))
    return found.select("grp", "d", "rows", "f.*")


def orders_by_aic(df: DataFrame, day: str, value: str, period: int, group: str | None = None, orders: tuple[tuple[int, int, int], ...] = ORDERS) -> DataFrame:
    """(grp, p, d, q, season, rows, aic, variance, factors) of every order for every series; values are scaled by the series' mean and deviation."""
    rows = _innovations(days_of(df, day, value, group), period, sorted({d for _, d, _ in orders}))
    return _candidates(saved(rows), period, orders)


def forecast(df: DataFrame, day: str, value: str, period: int, horizon: int | None = None, group: str | None = None, orders: tuple[tuple[int, int, int], ...] = ORDERS) -> DataFrame:
    """(grp, step, forecast, lower, upper, arima, aic, method): each series under its order of least AIC, with an 80 % band."""
    rows = saved(_innovations(days_of(df, day, value, group), period, sorted({d for _, d, _ in orders})))
    best = _candidates(rows, period, orders).groupBy("grp").agg(F.min_by(F.struct("p", "d", "q", "season", "aic", "variance", "factors"), F.struct("aic", F.col("d"), F.col("p"), F.col("q"), "season")).alias("m"))
    back = max(period, 2)
    tail = rows.filter(F.col("n") > F.col("days") - back).groupBy("grp", "d").agg(
        F.array_sort(F.collect_list(F.struct("n", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("e", F.lit(0.0)).alias("e")))).alias("tail"),
        F.max_by("y", "n").alias("last"), F.first("days").alias("days"), F.first("mean").alias("mean"), F.first("scale").alias("scale"),
    )  # a season's rows at most

    @F.pandas_udf("array<struct<mid:double,deviation:double>>")
    def ahead(factors: pd.Series, variance: pd.Series, d: pd.Series, w: pd.Series, e: pd.Series, last: pd.Series, steps: pd.Series) -> pd.Series:
        out = []
        for f, v, k, ws, es, y, h in zip(factors, variance, d, w, e, last, steps):
            c, a1, a2, a_s, m1, m_s = f

            def run(ws: list[float], es: list[float], constant: float) -> np.ndarray:
                ws, es = list(ws), [*es, *[0.0] * int(h)]
                start = len(ws)
                for t in range(start, start + int(h)):
                    season = (a_s * ws[t - back], m_s * es[t - back]) if t >= back else (0.0, 0.0)
                    ws.append(constant + a1 * ws[t - 1] + a2 * ws[t - 2] + m1 * es[t - 1] + sum(season))
                return np.array(ws[start:])

            quiet = [0.0] * (back - 1)
            mid, shock = run(ws, es, c), np.concatenate([[1.0], run([*quiet, 1.0], [*quiet, 1.0], 0.0)[:-1]])
            mid, shock = (y + np.cumsum(mid), np.cumsum(shock)) if k else (mid, shock)
            out.append([{"mid": float(a), "deviation": float(b)} for a, b in zip(mid, np.sqrt(v * np.cumsum(shock**2)))])
        return pd.Series(out, dtype=object)

    joined = best.select("grp", "m.*").join(tail, ["grp", "d"])
    steps = ahead("factors", "variance", "d", F.col("tail.w"), F.col("tail.e"), "last", horizon_of(F.col("days"), horizon))
    name = F.format_string("(%d,%d,%d)%s", "p", "d", "q", F.when(F.col("season"), f"(1,0,1,{period})").otherwise(""))
    out = joined.select("grp", name.alias("arima"), "aic", "mean", "scale", F.posexplode(steps).alias("at", "x"))
    level = lambda times: F.col("mean") + F.col("scale") * (F.col("x.mid") + times * F.col("x.deviation"))
    return out.select("grp", (F.col("at") + 1).alias("step"), level(0).alias("forecast"), level(-WIDE).alias("lower"), level(WIDE).alias("upper"), "arima", "aic", F.lit("arima").alias("method"))


def backtest(df: DataFrame, day: str, value: str, period: int, horizon: int | None = None, group: str | None = None, orders: tuple[tuple[int, int, int], ...] = ORDERS) -> DataFrame:
    """(grp, step, day, value, forecast, lower, upper, arima): the last days of each series, forecast from those before them."""
    days = saved(days_of(df, day, value, group).withColumn("held", horizon_of(F.col("days"), horizon)))
    past = days.filter(F.col("n") <= F.col("days") - F.col("held")).drop("n", "days", "held")
    guess = forecast(past, "day", "value", period, 24 if horizon is None else horizon, "grp", orders)
    real = days.filter(F.col("n") > F.col("days") - F.col("held")).select("grp", "day", "value", (F.col("n") - F.col("days") + F.col("held")).alias("step"))
    return real.join(guess.drop("aic", "method"), ["grp", "step"])
