import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quernstone.operators import models, neighbours


def points(spark, n, wide, seed=1, groups=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (groups, wide)) if groups else None
    x = rng.normal(0, 1, (n, wide)) + (centres[rng.integers(0, groups, n)] if groups else 0)
    x[n // 2 :: 7] = x[3]  # copies: ties by id
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")


def brute(x, ids, k, own):
    out = set()
    for q in ids:
        d = np.linalg.norm(x - x[q], axis=1)
        order = sorted((float(d[i]), i) for i in range(len(x)) if not (own and i == q))[:k]
        out |= {(q, r + 1, i) for r, (_, i) in enumerate(order)}
    return out


@pytest.mark.parametrize("groups", [0, 6])
def test_same_as_comparing_everything(spark, monkeypatch, groups):
    monkeypatch.setattr(neighbours, "ROWS", 32)
    monkeypatch.setattr(neighbours, "QUERIES", 8)
    x, df = points(spark, 700, 5, groups=groups)
    ids = range(0, 700, 9)
    asked = df.filter("id % 9 = 0")
    for others in (False, True):
        got = neighbours.nearest(asked, df, 6, others=others).collect()
        assert {(r["query_id"], r["rank"], r["id"]) for r in got} == brute(x, ids, 6, others)
        assert all(abs(r["distance"] - np.linalg.norm(x[r["query_id"]] - x[r["id"]])) < 1e-12 for r in got)


def test_far_rings_are_not_met(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 32)
    met, whole = [], neighbours._compared
    monkeypatch.setattr(neighbours, "_compared", lambda q, b, *a: (met.append(q.count()), whole(q, b, *a))[1])
    _, df = points(spark, 700, 3, groups=8)
    neighbours.nearest(df.filter("id % 9 = 0"), df, 3, cells=24).count()
    assert sum(met) < 78 * 24 / 2  # a query meets less than half of the cells


def test_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None), (4, [float("nan"), 0.0]), (5, [1.0, None]), (6, [1.0]), (7, []), (8, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = neighbours.nearest(df, df, 9).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in got) == [(1, 1, 1, 0.0), (1, 2, 2, 5.0), (2, 1, 2, 0.0), (2, 2, 1, 5.0)]
    assert neighbours.nearest(df, df.limit(0), 3).count() == 0 and neighbours.nearest(df.limit(0), df, 3).count() == 0
    names = df.select(F.concat(F.lit("k"), "id").alias("id"), "vector")
    assert [r["id"] for r in neighbours.nearest(names, names, 1, others=True).orderBy("query_id").collect()] == ["k2", "k1"]


def test_votes(spark):
    found = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 13), (2, 2, 10)], "query_id long, rank int, id long")
    labels = spark.createDataFrame([(10, "b"), (11, "a"), (12, "b"), (13, "a"), (14, None)], "k long, l string")
    assert sorted(map(tuple, neighbours.votes(found, labels, "k", "l").collect())) == [(1, "b", 2, 3), (2, "a", 1, 2)]


def rings(spark, n=600):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        inner, turn = i % 2, rng.uniform(0, 2 * math.pi)
        r = (1.0 if inner else 3.0) + rng.gauss(0, 0.2)
        rows.append((i, r * math.cos(turn), r * math.sin(turn), "oui" if inner else "non", r))
    return spark.createDataFrame(rows, "id long, a double, b double, kind string, r double")


def test_families_that_see_circles(spark):
    df = rings(spark)
    got = {f: models.train(df, "kind", ["a", "b"], models.CLASSIFICATION, f, key="id") for f in ("logistic", "svm", "knn")}
    assert got["logistic"]["metrics"]["accuracy"] < 0.75
    assert got["svm"]["metrics"]["accuracy"] > 0.97 and got["svm"]["method"] == "kernel_svm" and got["svm"]["metrics"]["roc_auc"] > 0.99
    assert got["knn"]["metrics"]["accuracy"] > 0.97 and got["knn"]["method"] == "knn" and got["knn"]["importances"] == []
    for family in ("svm", "knn"):
        r = models.train(df, "r", ["a", "b"], models.REGRESSION, family, key="id")
        assert r["metrics"]["r2"] > 0.9 > models.train(df, "r", ["a", "b"], key="id")["metrics"]["r2"]


def test_knn_equals_a_mean_of_neighbours(spark):
    x, df = points(spark, 200, 3)
    df = df.select("id", array_to_vector("vector").alias("features"), F.sin("id").alias("label"))
    fit, test = df.filter("id % 4 > 0"), df.filter("id % 4 = 0")
    model = neighbours.Neighbours(n_neighbors=1).fit(fit)
    got = {r["id"]: r["prediction"] for r in model.transform(test).collect()}
    known = [i for i in range(200) if i % 4]
    for q, p in got.items():
        d = np.linalg.norm(x[known] - x[q], axis=1)
        assert any(abs(p - math.sin(known[j])) < 1e-12 for j in np.flatnonzero(d <= d.min() + 1e-12))


def test_weights_by_distance(spark):
    fit = spark.createDataFrame([([0.0], 1.0), ([1.0], 4.0), ([5.0], 100.0)], "v array<double>, label double").select(array_to_vector("v").alias("features"), "label")
    test = spark.createDataFrame([(1, [0.25]), (2, [1.0])], "id long, v array<double>").select("id", array_to_vector("v").alias("features"))
    model = neighbours.Neighbours(n_neighbors=2, weights="distance").fit(fit)
    got = {r["id"]: r["prediction"] for r in model.transform(test).collect()}
    assert abs(got[1] - (1 / 0.25 + 4 / 0.75) / (1 / 0.25 + 1 / 0.75)) < 1e-12 and got[2] == 4.0


def test_products_come_near_the_kernel(spark):
    x, df = points(spark, 30, 4)
    model = neighbours.FourierFeatures(width=8192, gamma=0.3).fit(df.select("id", array_to_vector("vector").alias("features")))
    out = model.transform(df.select("id", array_to_vector("vector").alias("features"))).select("id", vector_to_array("fourier").alias("z")).collect()
    z = {r["id"]: np.array(r["z"]) for r in out}
    assert max(abs(z[a] @ z[b] - math.exp(-0.3 * np.sum((x[a] - x[b]) ** 2))) for a in z for b in z) < 0.06


def test_bounds_are_made_for_a_few_queries_at_a_time(spark, monkeypatch):
    """With very many rings, a batch of queries by all of them would not fit."""
    df = spark.range(300).select("id", F.array(F.sin(F.col("id") * 1.7), F.cos(F.col("id") * 2.3)).alias("vector"))
    whole = sorted(map(tuple, neighbours.nearest(df, df, 2, others=True, cells=8).collect()))
    monkeypatch.setattr(neighbours, "BOUNDS", 24)
    assert sorted(map(tuple, neighbours.nearest(df, df, 2, others=True, cells=8).collect())) == whole and len(whole) == 600
