import datetime
import random

import numpy as np

from quernstone.operators import arima

START = datetime.date(2020, 1, 1)


def series(n, ar=(), ma=(), season=0.0, period=7, level=10.0, seed=3, summed=False):
    rng = random.Random(seed)
    e = [rng.gauss(0, 1) for _ in range(n + 100)]
    w: list[float] = []
    for t in range(n + 100):
        w.append(e[t] + sum(a * w[t - i - 1] for i, a in enumerate(ar) if t > i) + sum(b * e[t - i - 1] for i, b in enumerate(ma) if t > i) + (season * w[t - period] if t >= period else 0))
    w = w[100:]
    return [level + x for x in (np.cumsum(w).tolist() if summed else w)]


def table(spark, groups):
    rows = [(g, START + datetime.timedelta(days=i), float(x)) for g, xs in groups.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "g string, day date, v double")


def test_known_factors_are_found(spark):
    df = table(spark, {"ar": series(1500, ar=(0.6, -0.3)), "ma": series(1500, ma=(0.5,)), "season": series(1500, season=0.7)})
    got = {r["grp"]: r for r in arima.orders_by_aic(df, "day", "v", 7, "g", ((2, 0, 1),)).filter("season = (grp = 'season')").collect()}
    ar, ma, season = (got[k]["factors"] for k in ("ar", "ma", "season"))
    pure = {r["grp"]: r["factors"] for r in arima.orders_by_aic(df, "day", "v", 7, "g", ((2, 0, 0),)).filter("not season").collect()}
    assert abs(pure["ar"][1] - 0.6) < 0.06 and abs(pure["ar"][2] + 0.3) < 0.06
    only = {r["grp"]: r["factors"] for r in arima.orders_by_aic(df, "day", "v", 7, "g", ((0, 0, 1),)).filter("not season").collect()}
    assert abs(only["ma"][4] - 0.5) < 0.08 and abs(season[3] - 0.7) < 0.12
    assert len(ar) == len(ma) == 6


def test_orders_equal_regressions(spark):
    values = series(200, ar=(0.5,), season=0.4)
    got = arima.orders_by_aic(table(spark, {"a": values}), "day", "v", 7, "g").collect()
    assert len(got) == 2 * len(arima.ORDERS)
    y = (np.array(values) - np.mean(values)) / np.std(values)
    for r in got:
        w = y if r["d"] == 0 else np.concatenate([[np.nan], np.diff(y)])
        lag = lambda x, k: np.concatenate([np.full(k, np.nan), x[:-k]])
        one = np.ones(len(w))
        long = np.column_stack([one, *[lag(w, k) for k in range(1, 7)], lag(w, 7), lag(w, 8)])
        ok = ~np.isnan(long).any(1) & ~np.isnan(w)
        e = np.full(len(w), np.nan)
        e[ok] = w[ok] - long[ok] @ np.linalg.lstsq(long[ok], w[ok], rcond=None)[0]
        parts = [one, lag(w, 1), lag(w, 2), lag(w, 7), lag(e, 1), lag(e, 7)]
        ok = ~np.isnan(np.column_stack([*parts, w])).any(1) & (np.arange(1, len(w) + 1) > 1 + 6 + 1 + 15)
        x = np.column_stack([parts[i] for i in arima._terms(r["p"], r["q"], r["season"])])[ok]
        b, *_ = np.linalg.lstsq(x, w[ok], rcond=None)
        variance = float(np.mean((w[ok] - x @ b) ** 2))
        assert r["rows"] == ok.sum() and abs(r["variance"] - variance) < 1e-8
        assert abs(r["aic"] - (r["rows"] * np.log(variance) + 2 * (x.shape[1] + 1))) < 1e-5


def test_forecast_and_band(spark):
    groups = {"season": [20 + 5 * (i % 7) for i in range(140)], "flat": [4.0] * 40, "short": [1.0] * 15, "line": [2.0 * i for i in range(60)]}
    out = arima.forecast(table(spark, groups).unionByName(spark.createDataFrame([("flat", None, 1.0), ("flat", START, None)], "g string, day date, v double")), "day", "v", 7, group="g").collect()
    by = {g: sorted((r for r in out if r["grp"] == g), key=lambda r: r["step"]) for g in groups}
    assert not by["short"] and len(by["season"]) == 24 and len(by["flat"]) == 8 and len(by["line"]) == 12
    assert all(abs(r["forecast"] - (20 + 5 * ((139 + r["step"]) % 7))) < 0.5 for r in by["season"])
    assert all(abs(r["forecast"] - 4) < 1e-6 for r in by["flat"])
    assert all(abs(r["forecast"] - 2 * (59 + r["step"])) < 0.5 for r in by["line"])
    assert arima.forecast(table(spark, groups).limit(0), "day", "v", 7, group="g").count() == 0


def test_band_covers(spark):
    df = table(spark, {str(k): series(220, ar=(0.6,), seed=k, summed=k % 2 == 0) for k in range(40)})
    held = arima.backtest(df, "day", "v", 7, 5, "g").collect()
    inside = np.mean([r["lower"] <= r["value"] <= r["upper"] for r in held])
    assert len(held) == 200 and 0.68 < inside < 0.92
    assert {r["step"] for r in held} == {1, 2, 3, 4, 5}
