"""Feeds of measurements as daily or weekly rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import isoweek_to_date
from ..operators.timeseries import fold_duplicate_days, rounded_mean, wide

#: Names of the feeds' fields and of the columns made of them, places, and column names that are recognised.
DAILY = {"temperature_2m_mean": "temp_mean", "temperature_2m_max": "temp_max", "temperature_2m_min": "temp_min", "precipitation_sum": "precip_sum", "wind_speed_10m_max": "wind_speed_max"}
AIR = {"pm2_5": "pm2_5", "pm10": "pm10", "nitrogen_dioxide": "no2", "ozone": "o3"}
TARGETS = {"IAV": "flu_a_load", "IBV": "flu_b_load", "RSV": "rsv_load", "SARS-COV-2": "sars_cov2_load"}
PLACES = {"geneva": (46.2044, 6.1432), "lausanne": (46.5197, 6.6323), "zurich": (47.3769, 8.5417), "bern": (46.9480, 7.4474), "basel": (47.5596, 7.5886)}
DATE_NAMES = ("date", "week", "yearweek", "year_week", "time", "datum", "temporal", "woche")
VALUE_HINTS = ("inzidenz", "incidence", "ili_per_100k", "ili", "per_100k", "rate", "value")


def place(region: str | None, lat: float | None = None, lon: float | None = None) -> tuple[float, float]:
    """Coordinates: explicit ones, the region's, or the default city's."""
    return (lat, lon) if lat is not None and lon is not None else PLACES.get((region or "").lower(), PLACES["geneva"])


def _arrays(df: DataFrame, payload: str, part: str, names: list[str]) -> DataFrame:
    """Rows of the arrays of one part of a JSON payload, side by side."""
    fields = ",".join(["time:array<string>", *[f"{n}:array<double>" for n in names]])
    rows = df.select(F.from_json(F.col(payload), f"{part} struct<{fields}>")[part].alias("p")).filter("p.time is not null")
    filled = [F.coalesce(F.col(f"p.{n}"), F.array().cast("array<double>")).alias(n) for n in names]  # arrays can be absent
    return rows.select(F.col("p.time").alias("time"), *filled).select(F.explode(F.arrays_zip("time", *names)).alias("z")).select(*[F.col(f"z.{n}") for n in ("time", *names)])


def weather(df: DataFrame, payload: str = "payload") -> DataFrame:
    days = _arrays(df, payload, "daily", list(DAILY)).select(F.col("time").alias("date"), *[F.col(a).alias(b) for a, b in DAILY.items()])
    damp = _arrays(df, payload, "hourly", ["relative_humidity_2m"]).groupBy(F.substring("time", 1, 10).alias("date"))
    return days.join(damp.agg(rounded_mean("relative_humidity_2m", 1).alias("relative_humidity_mean")), "date", "left")


def air_quality(df: DataFrame, payload: str = "payload") -> DataFrame:
    hours = _arrays(df, payload, "hourly", list(AIR))
    return hours.groupBy(F.substring("time", 1, 10).alias("date")).agg(*[rounded_mean(a, 2).alias(b) for a, b in AIR.items()])


def wastewater(df: DataFrame, plant: str, targets: list[str] | None = None) -> DataFrame:
    """Rows (wwtp, sample_date, Target, Load, and a row number seq) to one row for each date; the last row wins."""
    load = F.col("Load").cast("string").try_cast("double")
    rows = df.filter((F.col("wwtp") == plant) & load.isNotNull()).select(F.col("sample_date").alias("date"), F.upper("Target").alias("Target"), load.alias("Load"), "seq")
    names = [t for t in TARGETS if targets is None or t in {x.upper() for x in targets}]
    out = wide(rows, "date", "Target", "Load", names, "seq")
    return out.select("date", *[F.col(f"`{t}`").alias(TARGETS[t]) for t in names])


def date_column(columns: list[str]) -> str:
    return next((c for c in columns if c.lower().strip() in DATE_NAMES), columns[0])


def generic(df: DataFrame) -> DataFrame:
    """All columns that hold numbers, by the date column; rows without a number go."""
    day = date_column(df.columns)
    rest = [c for c in df.columns if c != day]
    number = lambda c: F.trim(F.col(f"`{c}`").cast("string")).try_cast("double")
    have = df.agg(*[F.count(number(c)).alias(str(i)) for i, c in enumerate(rest)]).first() if rest else []
    kept = [c for i, c in enumerate(rest) if have[i]]
    name = lambda c: c.lower().strip().replace(" ", "_")
    rows = df.select(F.col(f"`{day}`").cast("string").alias("date"), *[number(c).alias(name(c)) for c in kept])
    return rows.filter(F.coalesce(*[F.col(name(c)) for c in kept]).isNotNull()) if kept else rows.limit(0)


def national(df: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    from ..operators.filters import equal_ignoring_case

    rows = generic(equal_ignoring_case(df, filters or {}))
    rows = rows.withColumn("date", F.when(F.col("date").rlike(r"^\d{4}-"), F.substring("date", 1, 10)).otherwise(F.col("date")))
    return fold_duplicate_days(rows, [c for c in rows.columns if c != "date"])


def sentinel(df: DataFrame, filters: dict[str, str] | None = None, value: str | None = None) -> DataFrame:
    """Weekly incidence (date, ili_incidence); the value column is named or guessed by hints in order."""
    from ..operators.filters import equal_ignoring_case

    day = date_column(df.columns)
    value = value or next((c for h in VALUE_HINTS for c in df.columns if c != day and h in c.lower()), None)
    if value is None:
        return df.sparkSession.createDataFrame([], "date date, ili_incidence double")
    rows = equal_ignoring_case(df, filters or {})
    rows = rows.select(isoweek_to_date(F.col(day).cast("string")).alias("date"), F.col(value).cast("string").try_cast("double").alias("v")).filter("date is not null and v is not null")
    return rows.groupBy("date").agg(rounded_mean("v", 4).alias("ili_incidence"))


def latest_incidence(df: DataFrame, payload: str = "payload") -> DataFrame:
    """inc100, or else inc, of the latest week of a payload that is a list or has it under data."""
    item = "array<struct<week:bigint,inc100:double,inc:double>>"
    rows = F.coalesce(F.from_json(F.col(payload), f"data {item}")["data"], F.from_json(F.col(payload), item))
    x = df.select(F.explode(rows).alias("x")).select("x.*")
    return x.agg(F.max_by(F.coalesce("inc100", "inc"), "week").alias("value"))


def csv_resource(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(url) of the first CSV resource of each catalogue payload that has a download address or an address; null without one."""
    item = "array<struct<format:string,download_url:string,url:string>>"
    found = F.from_json(F.col(payload), f"result struct<resources:{item}>")["result"]["resources"]
    address = lambda r: F.coalesce(F.nullif(r["download_url"], F.lit("")), F.nullif(r["url"], F.lit("")))
    usable = F.filter(found, lambda r: (F.lower(r["format"]) == "csv") & address(r).isNotNull())
    return df.select(*[c for c in df.columns if c != payload], F.get(F.transform(usable, address), F.lit(0)).alias("url"))


def snapshots(df: DataFrame, fields: dict[str, str], feed: str = "feed", taken: str = "taken_at", payload: str = "payload") -> DataFrame:
    """The latest landed snapshot of each feed, with fields of its JSON (name to Spark type); payloads that don't parse are passed over."""
    x = F.from_json(F.col(payload), ", ".join(f"`{k}` {v}" for k, v in fields.items()))
    rows = df.select(F.col(feed).alias("feed"), F.col(taken).alias("taken_at"), x.alias("x")).filter(F.greatest(*[F.col(f"x.`{k}`").isNotNull() for k in fields], F.lit(False)))
    last = rows.groupBy("feed").agg(F.max("taken_at").alias("taken_at"), F.max_by("x", "taken_at").alias("x"))
    return last.select("feed", "taken_at", *[F.col(f"x.`{k}`").alias(k) for k in fields])


def epidemic_projection(spark: SparkSession, params: dict, days: int = 365, n: int = 200) -> DataFrame:
    """The median trajectory of an ensemble as a feed; no usable parameters give no rows."""
    from ..operators.epidemic import Dist, ensemble

    given = {k: Dist(v["value"], v.get("ci_low"), v.get("ci_high")) for k, v in (params or {}).items() if isinstance(v, dict) and v.get("value") is not None}
    if not given:
        return spark.createDataFrame([], "day int, incidence double, prevalence double, deaths double")
    out = ensemble(spark, given, min(max(int(days), 1), 3650), min(max(int(n), 1), 1000))
    return out.groupBy("day").pivot("series", ["incidence", "prevalence", "deaths"]).agg(F.max("median"))


#: Connectors by id: what they make of landed payloads, and their variables.
CONNECTORS: dict[str, tuple[Callable[..., DataFrame], list[str]]] = {
    "open-meteo-weather": (weather, [*DAILY.values(), "relative_humidity_mean"]),
    "open-meteo-air-quality": (air_quality, list(AIR.values())),
    "eawag-wastewater": (wastewater, list(TARGETS.values())),
    "foph-wastewater": (national, ["value", "valuemean7d", "conc", "flow", "pop"]),
    "foph-sentinella-ili": (sentinel, ["ili_incidence"]),
    "generic-csv": (generic, []),
}


def list_connectors() -> list[dict]:
    return [{"id": k, "variables": v} for k, (_, v) in CONNECTORS.items()]


def fetch_series(connector: str, df: DataFrame, start: str | None = None, end: str | None = None, **params) -> DataFrame:
    """A connector's rows within an inclusive window; KeyError for an unknown id."""
    from ..operators.filters import between_dates

    return between_dates(CONNECTORS[connector][0](df, **params), "date", start, end)
