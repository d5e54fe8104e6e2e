"""Queries over measurements: resampling, seasons, bands, epidemics, models and streams' batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import arima, epidemic, models, ranks, timeseries
from ..session import table, unused_path
from ..streaming import living_review, review_stream


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def hourly_to_daily(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("ts", F.col("value").alias("v_mean"), F.col("value").alias("v_max"), F.col("value").alias("v_min"), F.col("value").alias("v_sum"))
    return timeseries.daily(e, "ts", {"v_mean": "mean", "v_max": "max", "v_min": "min", "v_sum": "sum"}, 4)


def weekly_resample_mixed(spark: SparkSession, sf: str) -> DataFrame:
    d = _events(spark, sf).groupBy(F.to_date("ts").alias("date")).agg(F.sum("value").alias("precip_sum"), F.avg("value").alias("temp_mean"), F.max("value").alias("rsv_load"))
    out = timeseries.weekly(d, "date", {c: timeseries.how_for(c) for c in ("precip_sum", "temp_mean", "rsv_load")})
    return out.select("week", *[F.round(c, 4).alias(c) for c in ("precip_sum", "temp_mean", "rsv_load")])


def weekly_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    """Two feeds on one calendar: events of two kinds."""
    e = _events(spark, sf).select(F.to_date("ts").cast("string").alias("date"), "event_type", "value")
    frames = {k: e.filter(F.col("event_type") == k).groupBy("date").agg(F.avg("value").alias("temp_mean")) for k in ("click", "view")}
    mappings = [{"template_column": f"{k}_mean", "connector_id": k, "connector_variable": "temp_mean"} for k in frames]
    out, _ = timeseries.assemble(frames, mappings, "W", "week")
    return out.select("week", *[F.round(f"{k}_mean", 4).alias(f"{k}_mean") for k in frames])


def pivot_event_type(spark: SparkSession, sf: str) -> DataFrame:
    """Last value of each kind by day."""
    e = _events(spark, sf).select(F.to_date("ts").alias("date"), "event_type", "value", F.struct("ts", "event_id").alias("seq"))
    return timeseries.wide(e, "date", "event_type", "value", ["click", "view", "purchase"], "seq")


def seasonal_harmonics(spark: SparkSession, sf: str) -> DataFrame:
    d = _events(spark, sf).select(F.to_date("ts").alias("day")).distinct()
    s, c = dates.harmonics(F.col("day"))
    return d.select("day", F.round(s, 6).alias("season_sin"), F.round(c, 6).alias("season_cos"))


def isoweek_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.year("o_orderdate"), F.lit("-W"), F.lpad((F.col("o_orderkey") % 54).cast("string"), 2, "0")).alias("week"))
    return o.select("o_orderkey", dates.isoweek_to_date(F.col("week")).alias("monday"))


def week_ends(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(dates.week_end(F.col("o_orderdate")).alias("week"), "o_totalprice")
    return o.groupBy("week").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def digest_due(spark: SparkSession, sf: str) -> DataFrame:
    """Users by whether a digest of their frequency is due three days after the last event of all."""
    e = _events(spark, sf)
    last = e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(e.agg((F.max("ts") + F.expr("interval 3 days")).alias("now")))  # one row
    kind = F.element_at(F.array(*[F.lit(k) for k in ("immediate", "daily", "weekly")]), (F.col("user_id") % 3 + 1).cast("int"))
    return last.select(kind.alias("frequency"), dates.digest_due(kind, F.col("last"), F.col("now")).alias("due")).groupBy("frequency", "due").agg(F.count("*").alias("n"))


def durbin_watson(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("r", F.col("l_discount") - 0.05)
    out = timeseries.durbin_watson(rows, "r", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate"], ["l_suppkey"])
    return out.select("l_suppkey", F.round("dw", 6).alias("dw"))


def corr_leakage(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r_price"), F.round(F.corr("l_quantity", "l_discount"), 6).alias("r_discount"))


def quantile_bands(spark: SparkSession, sf: str) -> DataFrame:
    q = lambda p: F.round(F.percentile(F.col("value"), p), 6)
    return _events(spark, sf).groupBy("event_type").agg(q(0.33).alias("orange"), q(0.66).alias("red"), q(0.5).alias("median"))


def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Thirds and the median of prices by flag, selected exactly."""
    out = ranks.quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.33, 0.5, 0.66], "l_returnflag")
    return out.withColumn("quantile", F.round("quantile", 4))


def normality(spark: SparkSession, sf: str) -> DataFrame:
    """Shapiro and Wilk's W of prices by flag."""
    out = ranks.shapiro_wilk(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")
    return out.select("l_returnflag", "n", F.round("w", 6).alias("w"))


def weighted_pool(spark: SparkSession, sf: str) -> DataFrame:
    out = timeseries.pooled(table(spark, sf, "lineitem"), "l_discount", "l_quantity", ["l_shipmode"] if "l_shipmode" in table(spark, sf, "lineitem").columns else ["l_returnflag"])
    return out.select(*[c if c in ("n", out.columns[0]) else F.round(c, 6).alias(c) for c in out.columns])


def median_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Median hours between a user's events, which give a series' frequency."""
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    rows = _events(spark, sf).select("user_id", gap.alias("g")).filter("g is not null")
    return rows.groupBy("user_id").agg(F.round(F.median("g") / 3600, 4).alias("hours"))


def error_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Prices predicted from the quantity alone."""
    li = table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0)
    out = models.regression_metrics(li, "l_extendedprice", "p", ["l_linestatus"])
    return out.select("l_linestatus", "n", F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae"), F.round("r2", 6).alias("r2"), F.round("mape", 6).alias("mape"))


def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Returned lines told by their discount."""
    li = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("s"))
    out = models.classification_metrics(li, "y", "s", 0.5)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "positive_share", "roc_auc")])


def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as runs, by mean absolute deviation of their prices; the smaller, the better."""
    p = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("family")).agg(F.round(F.stddev_pop("l_discount"), 6).alias("rmse"))
    return models.leaderboard(p, "rmse").select("family", "rmse", "rank")


def monitor_level(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of purchases against the thirds of all values."""
    e = _events(spark, sf)
    out = models.monitor(e.filter("event_type = 'purchase'"), e, "value", "value")
    return out.select(F.round("value", 6).alias("value"), "n_scored", F.round("orange", 6).alias("orange"), F.round("red", 6).alias("red"), "bands_source", "level")


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("y"), (F.avg("l_quantity") * 1500).alias("p"))
    return models.bootstrap_ci(li, "y", "p", "l_suppkey")


def train_eval_regression(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")
    got = models.train(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag"], key="id")
    return spark.createDataFrame([(got["method"], got["n"], float(got["metrics"]["rmse"]), float(got["metrics"]["r2"]))], "method string, n long, rmse double, r2 double")


def forecast(spark: SparkSession, sf: str) -> DataFrame:
    d = _events(spark, sf).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return models.seasonal_forecast(d, "day", "v", 7, group="event_type")


def forecast_arima(spark: SparkSession, sf: str) -> DataFrame:
    """The daily totals of each event type, forecast under the order of least AIC."""
    d = _events(spark, sf).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return arima.forecast(d, "day", "v", 7, group="event_type")


def forecast_errors(spark: SparkSession, sf: str) -> DataFrame:
    """How far the forecasts of each event type's last days are off, by both families."""
    e = _events(spark, sf)
    parts = [models.train_series(e, "ts", "value", 7, family, group="event_type")[1].withColumn("family", F.lit(family)) for family in ("sarimax", "prophet")]
    return parts[0].unionByName(parts[1])


def seir_projection(spark: SparkSession, sf: str) -> DataFrame:
    out = epidemic.simulate(spark, {"r0": 2.5, "infectious_period_days": 7, "incubation_period_days": 4, "cfr": 0.01}, 200)
    return out.select("day", *[F.round(c, 1).alias(c) for c in ("incidence", "prevalence", "cumulative", "deaths", "susceptible", "exposed", "recovered")])


def seir_ensemble_bands(spark: SparkSession, sf: str) -> DataFrame:
    d = epidemic.Dist
    return epidemic.ensemble(spark, {"r0": d(2.2, 1.8, 2.6), "infectious_period_days": d(6, 5, 7), "incubation_period_days": 3.0}, 120, 100)


def tumbling_events(spark: SparkSession, sf: str) -> DataFrame:
    return living_review.tumbling(_events(spark, sf), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])


def sliding_events(spark: SparkSession, sf: str) -> DataFrame:
    return living_review.tumbling(_events(spark, sf), "ts", "2 hours", ["event_type"], [F.count("*").alias("n")], slide="1 hour")


def session_events(spark: SparkSession, sf: str) -> DataFrame:
    return living_review.sessions(_events(spark, sf), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])


def living_review_increment(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events as records: which of the last day's are not among the others of the table."""
    e = _events(spark, sf).select(F.concat_ws(":", "user_id", "event_type", F.hour("ts").cast("string")).alias("external_id"), F.lit("events").alias("source"), F.to_date("ts").alias("entered"))
    last = e.agg(F.max("entered").alias("last"))
    rows = e.crossJoin(last)  # one row
    known = rows.filter("entered < date_sub(last, 1)").select("external_id", "source").distinct()
    batch = rows.filter("entered >= date_sub(last, 1)")
    return living_review.new_records(known, batch, F.lit(1), now=F.col("last")).select("external_id").distinct()


def rolling_week(spark: SparkSession, sf: str) -> DataFrame:
    """Sums and means of the last seven days for each user, whose days have gaps; stretches of ten days."""
    days = _events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("total"))
    out = timeseries.rolling(days, "day", {"total": "sum"}, 7, ["user_id"], stretch=10)
    out = timeseries.rolling(out, "day", {"total": "mean"}, 7, ["user_id"], least=3, stretch=10)
    return out.select("user_id", F.col("day").cast("string").alias("day"), F.round("total_sum_7", 4).alias("week"), F.round("total_mean_7", 6).alias("mean"))


def living_review_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events of all days arrive in three batches; those of users and types that were known before the look-back of 20 days add nothing."""
    rows = _events(spark, sf).select(F.col("user_id").cast("string").alias("external_id"), F.col("event_type").alias("source"), F.to_date("ts").alias("entered"))
    last = rows.agg(F.max("entered").cast("string")).first()[0]
    now = F.to_date(F.lit(last))
    landing, target, state = (unused_path(spark, n) for n in ("landing", "reviewed", "state"))
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)  # of a batch
    rows.repartitionByRange(3 * files, "entered", "external_id").write.parquet(landing)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(landing)
    known = rows.filter(F.col("entered") < F.date_sub(now, 20))
    review_stream.review(stream, target, state, 20, known=known, now=now).awaitTermination()
    return review_stream.reviewed(target, rows).select("external_id", "source")


def _dated(query):
    """The query with its dates and times as text, which all clients read alike."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = query(spark, sf)
        pattern = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss"}
        return out.withColumns({c: F.date_format(c, pattern[t]) for c, t in out.dtypes if t in pattern})

    return run


def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return models.folds(table(spark, sf, "lineitem"), "stratified", 5, "l_orderkey", "l_returnflag").groupBy("l_returnflag", "fold").agg(F.count("*").alias("n"))


def expanding_folds(spark: SparkSession, sf: str) -> DataFrame:
    out = models.folds(_events(spark, sf).select("event_id", "ts", "value"), "timeseries", 5, "event_id", order="ts")
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.round(F.avg("value"), 6).alias("mean"))


def living_review_all(spark: SparkSession, sf: str) -> DataFrame:
    """Event types as scenarios with look-backs of their own; by scenario, its new users as records."""
    e = _events(spark, sf)
    now = e.agg(F.date_add(F.max(F.to_date("ts")), 1).alias("now"))
    batch = e.select(F.col("event_type").alias("scenario_id"), F.col("user_id").cast("string").alias("external_id"), F.lit("events").alias("source"), F.to_date("ts").alias("entered"))
    presets = spark.createDataFrame([("view", 0, 1), ("click", 1, None)], "scenario_id string, place int, lookback_days int")
    users = spark.createDataFrame([("purchase", 0, 9, "a", "flu"), ("signup", 1, 9, None, "flu")], "scenario_id string, place int, lookback_days int, owner string, query string")
    existing = batch.filter("external_id % 7 = 0").select("external_id", "source").distinct()
    under = living_review.scenarios(presets, users, days=3).crossJoin(now)  # one row
    out = living_review.review_all(existing, batch, under, now=F.col("now"))
    return out.groupBy("scenario_id", "project_context").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: _dated(f) for f in (
    hourly_to_daily, weekly_resample_mixed, weekly_outer_join, pivot_event_type, seasonal_harmonics, isoweek_dates, week_ends, digest_due, durbin_watson,
    corr_leakage, quantile_bands, exact_quantiles, normality, weighted_pool, median_gap, error_metrics, class_metrics, leaderboard, monitor_level, bootstrap_ci, train_eval_regression,
    forecast, forecast_arima, forecast_errors, seir_projection, seir_ensemble_bands, tumbling_events, sliding_events, session_events, living_review_increment, living_review_stream, rolling_week,
    stratified_folds, expanding_folds, living_review_all,
)}

_WEEK = "(date_trunc('week', {0}) + INTERVAL 6 DAY)::DATE"
_CAL = "cal AS (SELECT unnest(generate_series((SELECT min(week) FROM w), (SELECT max(week) FROM w), INTERVAL 7 DAY))::DATE AS week)"


def _week_mean(kind: str) -> str:
    return f"{kind}_d AS (SELECT ts::DATE AS d, avg(value) AS v FROM events WHERE event_type = '{kind}' GROUP BY 1), {kind} AS (SELECT {_WEEK.format('d')} AS week, avg(v) AS v FROM {kind}_d GROUP BY 1)"


def _seir_sql(r0: float, infectious: float, incubation: float, cfr: float, days: int) -> str:
    """The same integration as a recursive query: four Runge-Kutta steps a day, states as fractions of a million."""
    beta, gamma, sigma = r0 / infectious, 1 / infectious, 1 / incubation
    states = ("s", "e", "i", "r", "d", "c")
    slope = {"s": "-{b}*{s}*{i}", "e": "{b}*{s}*{i} - {g2}*{e}", "i": "{g2}*{e} - {g}*{i}", "r": "(1 - {f})*{g}*{i}", "d": "{f}*{g}*{i}", "c": "{b}*{s}*{i}"}
    fixed = {"b": f"{beta!r}::DOUBLE", "g": f"{gamma!r}::DOUBLE", "g2": f"{sigma!r}::DOUBLE", "f": f"{cfr!r}::DOUBLE"}

    def stage(at: dict[str, str], k: int) -> str:
        return ", ".join(f"{slope[x].format(**fixed, **at)} AS {x}{k}" for x in states)

    sql, h = "SELECT * FROM t WHERE n < " + str(4 * days), 0.25
    for k in range(1, 5):
        before = {x: x if k == 1 else f"({x} + {h * (1.0 if k == 4 else 0.5)!r}::DOUBLE * {x}{k - 1})" for x in states}
        sql = f"SELECT *, {stage(before, k)} FROM ({sql})"
    step = ", ".join(f"greatest({x} + {h / 6!r}::DOUBLE * ({x}1 + 2 * {x}2 + 2 * {x}3 + {x}4), 0)" for x in states)
    start = "0, 1 - 1e-5::DOUBLE, 0::DOUBLE, 1e-5::DOUBLE, 0::DOUBLE, 0::DOUBLE, 1e-5::DOUBLE"
    named = {"incidence": f"{fixed['b']} * s * i", "prevalence": "i", "cumulative": "c", "deaths": "d", "susceptible": "s", "exposed": "e", "recovered": "r"}
    return f"WITH RECURSIVE t(n, s, e, i, r, d, c) AS (SELECT {start} UNION ALL SELECT n + 1, {step} FROM ({sql})) SELECT (n // 4)::INT AS day, " + ", ".join(f"round({x} * 1e6, 1) AS {k}" for k, x in named.items()) + " FROM t WHERE n % 4 = 0"


_DAY, _TIME = "strftime({0}, '%Y-%m-%d')", "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _texts(sql: str, days: tuple[str, ...] = (), times: tuple[str, ...] = ()) -> str:
    changed = ", ".join(f"{p.format(c)} AS {c}" for p, names in ((_DAY, days), (_TIME, times)) for c in names)
    return f"SELECT * REPLACE ({changed}) FROM ({sql})"


def _poly_sql(x: str, factors: tuple[float, ...]) -> str:
    """The polynomial in ``x``, highest power first."""
    total = f"({factors[0]!r})"
    for k in factors[1:]:
        total = f"({total} * {x} + ({k!r}))"
    return total


def _normality_sql() -> str:
    far, q = "sqrt(-2 * ln(least(p, 1 - p)))", "(p - 0.5)"
    tail = f"({_poly_sql(far, ranks._TAIL[0])} / {_poly_sql(far, ranks._TAIL[1])})"
    middle = f"({q} * {_poly_sql(f'({q} * {q})', ranks._MIDDLE[0])} / {_poly_sql(f'({q} * {q})', ranks._MIDDLE[1])})"
    last, second = (_poly_sql("u", (*k, 0.0)) for k in (ranks._LAST, ranks._LAST_BUT_ONE))
    return f"""
WITH r AS (
  SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i,
    count(*) OVER (PARTITION BY l_returnflag) AS n, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS x
  FROM lineitem),
s AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM r),
m AS (SELECT *, CASE WHEN p < {ranks._EDGE} THEN {tail} WHEN p > {1 - ranks._EDGE} THEN -{tail} ELSE {middle} END AS m FROM s),
t AS (
  SELECT l_returnflag, n, 1 / sqrt(n) AS u, sum(x * x) AS spread, sum(m * x) AS mx, sum(m * m) AS mm,
    max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2,
    max(x) FILTER (i = n) - max(x) FILTER (i = 1) AS d1, max(x) FILTER (i = n - 1) - max(x) FILTER (i = 2) AS d2
  FROM m GROUP BY l_returnflag, n),
a AS (SELECT *, {last} + m1 / sqrt(mm) AS a1, {second} + m2 / sqrt(mm) AS a2 FROM t)
SELECT l_returnflag, n, round(least(1.0, (a1 * d1 + a2 * d2 + (mx - m1 * d1 - m2 * d2) / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2))) ** 2 / spread), 6) AS w
FROM a"""


SQL = {
    "exact_quantiles": "SELECT l_returnflag, 0.33::DOUBLE AS share, round(quantile_cont(l_extendedprice, 0.33), 4) AS quantile FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 0.5::DOUBLE, round(quantile_cont(l_extendedprice, 0.5), 4) FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 0.66::DOUBLE, round(quantile_cont(l_extendedprice, 0.66), 4) FROM lineitem GROUP BY 1",
    "normality": _normality_sql(),
    "seir_projection": _seir_sql(2.5, 7, 4, 0.01, 200),
    "hourly_to_daily": "SELECT strftime(ts, '%Y-%m-%d') AS date, round(avg(value), 4) AS v_mean, round(max(value), 4) AS v_max, round(min(value), 4) AS v_min, round(sum(value), 4) AS v_sum FROM events GROUP BY 1",
    "weekly_resample_mixed": f"WITH d AS (SELECT ts::DATE AS date, sum(value) AS p, avg(value) AS t, max(value) AS r FROM events GROUP BY 1), w AS (SELECT {_WEEK.format('date')} AS week, sum(p) AS p, avg(t) AS t, arg_max(r, date) AS r FROM d GROUP BY 1), {_CAL} SELECT week, round(coalesce(p, 0), 4) AS precip_sum, round(t, 4) AS temp_mean, round(r, 4) AS rsv_load FROM cal LEFT JOIN w USING (week)",
    "weekly_outer_join": f"WITH {_week_mean('click')}, {_week_mean('view')} SELECT coalesce(c.week, v.week) AS week, round(c.v, 4) AS click_mean, round(v.v, 4) AS view_mean FROM click c FULL JOIN view v ON c.week = v.week",
    "pivot_event_type": "SELECT ts::DATE AS date, " + ", ".join(f"arg_max(value, (ts, event_id)) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("click", "view", "purchase")) + " FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1",
    "seasonal_harmonics": "SELECT DISTINCT ts::DATE AS day, round(sin(2 * pi() * weekofyear(ts) / 52.18), 6) AS season_sin, round(cos(2 * pi() * weekofyear(ts) / 52.18), 6) AS season_cos FROM events",
    "isoweek_dates": "WITH m AS (SELECT o_orderkey, o_orderkey % 54 AS w, (date_trunc('week', make_date(year(o_orderdate), 1, 4)) + to_days(((o_orderkey % 54 - 1) * 7)::INT))::DATE AS d FROM orders) SELECT o_orderkey, CASE WHEN w BETWEEN 1 AND 53 AND weekofyear(d) = w THEN d END AS monday FROM m",
    "week_ends": f"SELECT {_WEEK.format('o_orderdate')} AS week, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "digest_due": "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), k AS (SELECT ['immediate', 'daily', 'weekly'][(user_id % 3 + 1)::INT] AS frequency, floor(epoch((SELECT max(ts) FROM events) + INTERVAL 3 DAY)) - floor(epoch(last)) AS s FROM l) SELECT frequency, CASE frequency WHEN 'immediate' THEN TRUE WHEN 'daily' THEN s >= 86400 ELSE s >= 604800 END AS due, count(*) AS n FROM k GROUP BY 1, 2",
    "durbin_watson": "WITH r AS (SELECT l_suppkey, l_discount - 0.05 AS r, l_discount - 0.05 - lag(l_discount - 0.05) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate) AS d FROM lineitem) SELECT l_suppkey, round(sum(d * d) / sum(r * r), 6) AS dw FROM r GROUP BY l_suppkey",
    "corr_leakage": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r_price, round(corr(l_quantity, l_discount), 6) AS r_discount FROM lineitem GROUP BY l_returnflag",
    "quantile_bands": "SELECT event_type, round(quantile_cont(value, 0.33), 6) AS orange, round(quantile_cont(value, 0.66), 6) AS red, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type",
    "weighted_pool": "WITH s AS (SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS w, sum(l_quantity * l_discount) AS wv, sum(l_quantity * l_discount * l_discount) AS wvv FROM lineitem WHERE l_quantity > 0 AND l_discount IS NOT NULL GROUP BY l_returnflag), m AS (SELECT l_returnflag, n, wv / w AS mean, sqrt(greatest(0, wvv / w - (wv / w) * (wv / w))) AS sd FROM s) SELECT l_returnflag, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - 1.96 * sd, 6) AS low, round(mean + 1.96 * sd, 6) AS high FROM m",
    "median_gap": "WITH g AS (SELECT user_id, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS g FROM events) SELECT user_id, round(median(g) / 3600, 4) AS hours FROM g WHERE g IS NOT NULL GROUP BY user_id",
    "error_metrics": "SELECT l_linestatus, count(*) AS n, round(sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)), 2) AS rmse, round(avg(abs(l_extendedprice - l_quantity * 1500)), 2) AS mae, round(1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2, round(avg(abs((l_extendedprice - l_quantity * 1500) / l_extendedprice)), 6) AS mape FROM lineitem GROUP BY l_linestatus",
    "class_metrics": "WITH r AS (SELECT (l_returnflag = 'R')::INT AS y, l_discount * 10 AS s FROM lineitem), k AS (SELECT y, s, (s >= 0.5)::INT AS h, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM r) SELECT count(*) AS n, round(avg((y = h)::INT), 6) AS accuracy, round(2.0::DOUBLE * sum(y * h) / (2 * sum(y * h) + sum((1 - y) * h) + sum(y * (1 - h))), 6) AS f1, round(avg(y), 6) AS positive_share, round((sum(y * rk::DOUBLE) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y))), 6) AS roc_auc FROM k",
    "leaderboard": "SELECT family, rmse, row_number() OVER (ORDER BY rmse, family)::INT AS rank FROM (SELECT l_suppkey AS family, round(stddev_pop(l_discount), 6) AS rmse FROM lineitem GROUP BY 1)",
    "monitor_level": "WITH q AS (SELECT quantile_cont(value, 0.33) AS o, quantile_cont(value, 0.66) AS r FROM events), m AS (SELECT avg(value) AS v, count(*) AS n FROM events WHERE event_type = 'purchase') SELECT round(v, 6) AS value, n AS n_scored, round(o, 6) AS orange, round(r, 6) AS red, 'data_quantiles' AS bands_source, CASE WHEN v IS NULL THEN 'unavailable' WHEN v >= r THEN 'red' WHEN v >= o THEN 'orange' ELSE 'green' END AS level FROM q, m",
    "tumbling_events": "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3",
    "sliding_events": "WITH h AS (SELECT date_trunc('hour', ts) - to_hours(k::INT) AS window_start, event_type FROM events, range(2) t(k)) SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n FROM h GROUP BY 1, 2, 3",
    "session_events": "WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT AS b FROM events), s AS (SELECT user_id, ts, sum(coalesce(b, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k",
    "rolling_week": "WITH d AS (SELECT user_id, ts::DATE AS day, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT user_id, day::VARCHAR AS day, round(sum(total) OVER w, 4) AS week, CASE WHEN count(*) OVER w >= 3 THEN round(avg(total) OVER w, 6) END AS mean FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)",
    "living_review_stream": "WITH e AS (SELECT user_id::VARCHAR AS external_id, event_type AS source, ts::DATE AS d, (SELECT max(ts)::DATE FROM events) - 20 AS since FROM events) SELECT external_id, source FROM e GROUP BY external_id, source HAVING min(d) >= max(since)",
    "living_review_increment": "WITH e AS (SELECT user_id || ':' || event_type || ':' || hour(ts) AS external_id, ts::DATE AS d, (SELECT max(ts)::DATE FROM events) AS last FROM events) SELECT DISTINCT external_id FROM e WHERE d >= last - 1 AND external_id NOT IN (SELECT external_id FROM e WHERE d < last - 1)",
    "stratified_folds": "SELECT l_returnflag, fold::INT AS fold, count(*) AS n FROM (SELECT l_returnflag, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey) - 1) % 5 AS fold FROM lineitem) GROUP BY 1, 2",
    "expanding_folds": "WITH r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS c FROM events WHERE ts IS NOT NULL) SELECT greatest(floor((r - (c - 5 * (c // 6))) / (c // 6)), -1)::INT AS fold, count(*) AS n, sum(event_id)::BIGINT AS ids, round(avg(value), 6) AS mean FROM r GROUP BY 1",
    "living_review_all": "WITH l AS (SELECT max(ts)::DATE + 1 AS now FROM events), s AS (SELECT * FROM (VALUES ('view', 0, 1, 'preset'), ('click', 1, 3, 'preset'), ('purchase', 2, 9, 'user')) t(scenario_id, place, days, project_context)), f AS (SELECT user_id, min(place) AS place FROM events JOIN s ON event_type = scenario_id, l WHERE ts::DATE >= now - days AND user_id % 7 <> 0 GROUP BY 1) SELECT scenario_id, project_context, count(*) AS n FROM f JOIN s USING (place) GROUP BY 1, 2",
}

for _name, _columns in {"weekly_resample_mixed": "week", "weekly_outer_join": "week", "pivot_event_type": "date", "seasonal_harmonics": "day", "isoweek_dates": "monday", "week_ends": "week"}.items():
    SQL[_name] = _texts(SQL[_name], days=(_columns,))
for _name, _columns in {"tumbling_events": "window", "sliding_events": "window", "session_events": "session"}.items():
    SQL[_name] = _texts(SQL[_name], times=(f"{_columns}_start", f"{_columns}_end"))
