"""Exact quantiles against numpy; the normality test against published values and against all ranks at once."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import chunks, epidemic, ranks


def test_normal_quantile(spark):
    shares = [1e-9, 0.001, 0.02, 0.02425, 0.1, 0.5, 0.7, 0.97575, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in [*shares, 0.0, 1.0]], "p double").select("p", ranks.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=2e-9, abs=2e-9) for r in got[:-2])
    assert [r["z"] for r in got[-2:]] == [None, None]


@pytest.mark.parametrize("few", [7, 100_000])
def test_quantiles(spark, few):
    rng = random.Random(3)
    rows = [("normal", rng.gauss(0, 1)) for _ in range(3000)] + [("wide", 10 ** rng.uniform(-300, 300) * rng.choice([-1, 1])) for _ in range(2000)]
    rows += [("tied", float(rng.randint(0, 3))) for _ in range(2000)] + [("one", 5.0), ("same", 2.0), ("same", 2.0), (None, 1.0), (None, 4.0)]
    rows += [("normal", None), ("normal", math.nan), ("none", None), ("far", -1.7e308), ("far", 0.0), ("far", 1.7e308), ("zero", 0.0), ("zero", -0.0)]
    shares = [0.0, 0.33, 0.5, 0.66, 1.0]
    got = {(r["k"], r["share"]): r["quantile"] for r in ranks.quantiles(spark.createDataFrame(rows, "k string, v double"), "v", shares, "k", few).collect()}
    by = {}
    for k, v in rows:
        if v is not None and not math.isnan(v):
            by.setdefault(k, []).append(v)
    assert set(got) == {(k, s) for k in by for s in shares}
    for (k, s), q in got.items():
        if k != "far":
            assert q == pytest.approx(np.quantile(by[k], s), rel=1e-9), (k, s)
    assert got["far", 0.0] == -1.7e308 and got["far", 0.5] == 0.0


def test_quantiles_of_nothing(spark):
    assert ranks.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0
    assert ranks.shapiro_wilk(spark.createDataFrame([], "v double"), "v").count() == 0


def test_published_normality(spark):
    """Miles per gallon of the 32 cars of 1974: W = 0.94756, p = 0.1229."""
    mpg = [21, 21, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26, 30.4, 15.8, 19.7, 15, 21.4]
    rows = [("mpg", float(x)) for x in mpg] + [("mpg", None), ("few", 1.0), ("few", 2.0), ("same", 3.0)] + [("same", 3.0)] * 9
    got = {r["k"]: r for r in ranks.shapiro_wilk(spark.createDataFrame(rows, "k string, v double"), "v", "k").collect()}
    assert got["mpg"]["n"] == 32 and got["mpg"]["w"] == pytest.approx(0.94756, abs=6e-6) and got["mpg"]["p"] == pytest.approx(0.1229, abs=6e-5)
    assert got["few"]["w"] is None and got["same"]["w"] is None


def test_normality_in_buckets(spark):
    """Ranks in many buckets are those of one bucket; a normal sample keeps its hypothesis, an exponential one loses it."""
    rng = random.Random(5)
    rows = [("normal", round(rng.gauss(10, 2), 2)) for _ in range(2000)] + [("skewed", rng.expovariate(1)) for _ in range(2000)] + [("small", rng.gauss(0, 1)) for _ in range(9)]
    df = spark.createDataFrame(rows, "k string, v double")
    one = {r["k"]: r for r in ranks.shapiro_wilk(df, "v", "k").collect()}
    many = {r["k"]: r for r in ranks.shapiro_wilk(df, "v", "k", few=10).collect()}
    assert all(one[k]["w"] == pytest.approx(many[k]["w"], rel=1e-9) for k in one)
    assert one["normal"]["p"] > 0.01 and one["small"]["p"] > 0.01 and one["skewed"]["p"] < 1e-10


def test_chunks_by_paragraphs(spark):
    """Whole paragraphs up to the size, the last of a chunk again in the next, long ones cut at sentence ends."""
    cut = lambda text: spark.createDataFrame([(text,)], "t string").select(chunks.paragraphs(F.col("t"), size=20, overlap=6, least=2)).first()[0]
    assert cut("aaaa\n\nbbbb\n \ncccc\n\ndddd") == ["aaaa\n\nbbbb\n\ncccc", "cccc\n\ndddd"]
    assert cut("aaaaaaaa\n\nbbbbbbbb\n\ncccccccc") == ["aaaaaaaa\n\nbbbbbbbb", "cccccccc"]
    assert cut("  One two. Three four. Five six.  ") == ["One two. Three four.", "Five six."]
    assert cut("One two. Three four! Five six? Seven.") == ["One two. Three four!", "Five six? Seven."]
    assert cut("x" * 45) == ["x" * 20, "x" * 20, "x" * 5]
    assert cut("ab\n\n" + "y" * 20 + "\n\ncd") == ["y" * 20]
    assert cut("") == [] and cut(" \n\n ") == []


def test_shift_in_closed_form():
    """No shift of a fine grid is better, and a known one is found."""
    model = np.exp(-0.5 * ((np.arange(120) - 40) / 9.0) ** 2)
    day = np.array([0.0, 3.0, 7.5, 12.0, 20.25, 31.0])
    truth = 3.0 * np.interp(day + 22.3, np.arange(120), model)
    shift, scale, error = epidemic.fit_shift(model, day, truth, 60)
    assert shift == pytest.approx(22.3, abs=1e-6) and scale == pytest.approx(3.0, abs=1e-6) and error < 1e-12
    noisy = truth + np.array([0.3, -0.2, 0.1, 0.25, -0.3, 0.2])
    _, _, error = epidemic.fit_shift(model, day, noisy, 60)
    for s in np.linspace(0, 60, 6001):
        m = np.interp(day + s, np.arange(120), model)
        k = max(0.0, m @ noisy / (m @ m)) if m @ m > 0 else 0.0
        assert error <= ((k * m - noisy) ** 2).sum() + 1e-12
    assert epidemic.fit_shift(model, day, truth, 0)[0] == 0.0
    assert epidemic.fit_shift(np.zeros(9), day, truth, 3)[1] == 0.0


def test_ranges_are_not_searched_cut_by_cut(spark, monkeypatch):
    """Buckets of many distinct values are ranges of a sort; no value is held against every cut."""

    def scanned(*args):
        raise AssertionError("a scan of all cuts for each value")

    monkeypatch.setattr(F, "filter", scanned)
    df = spark.range(3000).select((F.col("id") * F.col("id")).cast("double").alias("v"))
    row = ranks.shapiro_wilk(df, "v", few=100).first()
    assert row["n"] == 3000 and 0.8 < row["w"] < 0.95


def test_ranges_are_sent_to_the_values(spark, monkeypatch):
    """Values are not dealt out by their group, of which there may be one."""
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    df = spark.range(3000).select(F.col("id").cast("double").alias("v"))
    assert ranks.quantiles(df, "v", [0.25], few=100).first()["quantile"] == 749.75
    assert sent
