"""Resampling and assembling time series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import week_end


def how_for(column: str) -> str:
    """How a column is resampled, by its name."""
    low = column.lower()
    if "precip" in low or "rain" in low:
        return "sum"
    return "last" if any(k in low for k in ("load", "wastewater", "viral")) else "mean"


def aggregate(column: str, how: str, order: str = "date") -> Column:
    value = F.col(column)
    return {"sum": F.sum(value), "mean": F.avg(value), "last": F.max_by(value, F.when(value.isNotNull(), F.col(order))), "max": F.max(value), "min": F.min(value)}[how]


def rounded_mean(column: str, digits: int, places: int = 7) -> Column:
    """The mean of a column, rounded half away from zero; the same whatever order rows come in.

    Values are taken to ``places`` decimals and summed as whole numbers, so no sum of doubles decides a tie.
    """
    value = F.col(column)
    total, n = F.sum(F.round(value * 10**places).cast("decimal(28,0)")), F.count(value)
    halves = F.abs(total) * F.lit(2 * 10**digits) + n * F.lit(10**places)
    whole = F.call_function("div", halves.cast("decimal(38,0)"), (n * F.lit(2 * 10**places)).cast("decimal(38,0)"))
    return F.when(n > 0, F.signum(total.cast("double")) * whole / float(10**digits))


def daily(df: DataFrame, ts: str, values: dict[str, str], digits: int | None = None) -> DataFrame:
    """Sub-daily rows to days; ``values`` maps a column to mean, sum, max or min; nulls are skipped."""
    aggs = [aggregate(c, how, ts) for c, how in values.items()]
    named = [(F.round(a, digits) if digits is not None else a).alias(c) for a, c in zip(aggs, values)]
    return df.groupBy(F.substring(F.col(ts).cast("string"), 1, 10).alias("date")).agg(*named)


def rolling(df: DataFrame, day: str, values: dict[str, str], days: int, by: list[str] | None = None, least: int = 1, stretch: int | None = None) -> DataFrame:
    """``df`` with, for each of ``values`` (a column to mean, sum, max, min or count), its aggregate over the last ``days`` days, named column_how_days.

    Windows are of calendar days, so days without a row stay gaps and only shrink what a window holds; with
    fewer than ``least`` values it is null.  A long series is cut into stretches of ``stretch`` days; each is one
    window partition, with the rows of the days before it that its first windows reach back to.
    """
    long_, by = max(stretch or 32 * days, days), by or []
    rows = df.withColumns({"_day": F.unix_date(F.to_date(day)).cast("long"), "_own": F.lit(True)})
    part = F.floor(F.col("_day") / long_)
    rows = rows.withColumn("_part", part)
    lent = rows.filter((F.col("_part") + 1) * long_ - F.col("_day") < days).withColumns({"_part": F.col("_part") + 1, "_own": F.lit(False)})
    window = W.partitionBy(*by, "_part").orderBy("_day").rangeBetween(1 - days, 0)
    how = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    out = rows.unionByName(lent)
    for column, name in values.items():
        enough = F.count(column).over(window) >= least
        out = out.withColumn(f"{column}_{name}_{days}", F.when(enough, how[name](column).over(window)))
    return out.filter("_own").drop("_day", "_own", "_part")


def weekly(df: DataFrame, day: str, values: dict[str, str], fill_gaps: bool = True) -> DataFrame:
    """Days to weeks that end on Sunday; empty weeks between the first and the last appear, with sums of zero."""
    rows = df.withColumn("week", week_end(F.to_date(day)))
    out = rows.groupBy("week").agg(*[aggregate(c, how, day).alias(c) for c, how in values.items()])
    if fill_gaps:
        span = out.agg(F.min("week").alias("a"), F.max("week").alias("b")).filter("a is not null")
        weeks = span.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
        out = weeks.join(out, "week", "left")
    zero = {c for c, how in values.items() if how == "sum"}
    return out.select("week", *[F.coalesce(c, F.lit(0.0)).alias(c) if c in zero else F.col(c) for c in values])


def outer_join(frames: list[DataFrame], on: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "full_outer"), frames)


def assemble(frames: dict[str, DataFrame], mappings: list[dict[str, str]], freq: str = "W", datetime_col: str | None = None) -> tuple[DataFrame | None, list[str]]:
    """The mapped variables of several feeds on one calendar, and the template columns that were filled."""
    parts, filled = [], []
    for source, df in frames.items():
        mine = [m for m in mappings if m["connector_id"] == source and m["connector_variable"] in df.columns]
        if not mine:
            continue
        rows = df.select(F.to_date("date").alias("date"), *[F.col(m["connector_variable"]).cast("double").alias(m["template_column"]) for m in mine])
        how = {m["template_column"]: how_for(m["connector_variable"]) for m in mine}
        if freq == "W":
            parts.append(weekly(rows, "date", how).withColumnRenamed("week", "date"))
        else:
            parts.append(rows.groupBy("date").agg(*[aggregate(c, h).alias(c) for c, h in how.items()]))
        filled += list(how)
    if not parts:
        return None, []
    out = outer_join(parts, "date")
    return (out.withColumnRenamed("date", datetime_col) if datetime_col else out), filled


def wide(df: DataFrame, day: str, name: str, value: str, names: list[str], order: str) -> DataFrame:
    """Long to wide; the last row of a day and name wins.  Names are given, so no pass finds them."""
    out = df.filter(F.col(name).isin(*names)).groupBy(day).pivot(name, names).agg(F.max_by(value, order))
    return out


def fold_duplicate_days(df: DataFrame, values: list[str], extensive: tuple[str, ...] = ("pop", "flow"), digits: int = 4) -> DataFrame:
    """If any date repeats: one row for each date, sums of extensive columns and means of the others; else as it is."""
    if df.groupBy("date").count().filter("count > 1").limit(1).count() == 0:
        return df
    agg = lambda c: F.round(F.sum(c), digits) if c.lower() in extensive else rounded_mean(c, digits)
    return df.groupBy("date").agg(*[agg(c).alias(c) for c in values])


def validate(df: DataFrame, target: str, features: list[str], numeric: list[str], least: int = 20) -> dict:
    """What a training set lacks: target, features, rows, numbers."""
    have = [f for f in features if f in df.columns]
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()).alias(c) for c in numeric if c in df.columns],
    ).first()
    wrong = [c for c in numeric if c in df.columns and counts[c]]
    out = {"rows": counts["rows"], "target": target in df.columns, "matched": have, "missing": [f for f in features if f not in have], "not_numeric": wrong}
    return out | {"ok": out["target"] and bool(have) and counts["rows"] >= least and not wrong}


def durbin_watson(df: DataFrame, residual: str, order: list[str], group: list[str]) -> DataFrame:
    """Sum of squared steps over sum of squares, by group."""
    from pyspark.sql import Window as W

    step = F.col(residual) - F.lag(residual).over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("_d", step).groupBy(*group).agg((F.sum(F.col("_d") * F.col("_d")) / F.sum(F.col(residual) * F.col(residual))).alias("dw"))


def pooled(df: DataFrame, value: str, weight: str, group: list[str]) -> DataFrame:
    """Weighted mean, weighted population deviation and 95 % band, by group."""
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    rows = df.filter(v.isNotNull() & (w > 0))
    sums = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum(w).alias("_w"), F.sum(w * v).alias("_wv"), F.sum(w * v * v).alias("_wvv"))
    mean = F.col("_wv") / F.col("_w")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_wvv") / F.col("_w") - mean * mean))
    out = sums.withColumn("mean", mean).withColumn("sd", sd)
    return out.select(*group, "n", "mean", "sd", (F.col("mean") - 1.96 * F.col("sd")).alias("low"), (F.col("mean") + 1.96 * F.col("sd")).alias("high"))
