import random

from pyspark.sql import functions as F

from quernstone.operators import models
from quernstone.sources import enrichment


def rows(spark, n=120):
    rng = random.Random(1)
    data = [(i, x, 3 * x + rng.gauss(0, 0.1), "yes" if x > 0.3 else "no") for i, x in ((i, rng.gauss(0, 1)) for i in range(n))]
    return spark.createDataFrame(data, "id long, x double, y double, c string")


def test_folds(spark):
    df = rows(spark)
    for strategy in ("kfold", "stratified", "timeseries"):
        got = models.folds(df, strategy, 4, "id", "c", "id").collect()
        assert len(got) == 120 and {r["fold"] for r in got} - {-1} == {0, 1, 2, 3}
    assert [sum(r["fold"] == f for r in got) for f in range(-1, 4)] == [24] * 5
    assert all(r["fold"] == r["id"] // 24 - 1 for r in got)
    even = models.folds(df, "stratified", 4, "id", "c").groupBy("c", "fold").count().collect()
    for c in ("yes", "no"):
        counts = [r["count"] for r in even if r["c"] == c]
        assert max(counts) - min(counts) <= 1
    assert models.folds(df.limit(0), "timeseries", 4, "id", order="id").count() == 0


def test_search_spaces():
    for family in (*models.SPACES, "mlp"):
        got = models.search_space(family, 5, 3)
        assert got == models.search_space(family, 5, 3) and len(got) == (1 if family == "linear" else 5)
    assert all(100 <= p["numTrees"] <= 400 for p in models.search_space("random_forest", 20))


def test_tuning(spark):
    df = rows(spark)
    assert models.cross_validate(df, "y", ["x"], k=3)["r2"] > 0.99
    assert models.cross_validate(df, "y", ["x"], k=3, order="id", strategy="timeseries")["rmse"] < 0.2
    best = models.tune(df, "y", ["x"], family="elasticnet", trials=2, k=2)
    assert set(best["params"]) == {"regParam", "elasticNetParam"} and best["value"] > 0
    assert models.cross_validate(df, "c", ["x"], models.CLASSIFICATION, "logistic", k=2, positive="yes")["roc_auc"] > 0.99


def test_enrichment(spark):
    docs = spark.createDataFrame([(1, "10.1/A", "Some title"), (2, None, "OTHER title!"), (3, "10.1/z", None)], "id long, doi string, title string")
    works = spark.createDataFrame([("b", "10.1/a", "x y", 5), ("a", None, "other title", 7), ("c", None, "other title", 9), ("d", None, "some title", 1)], "work_id string, doi string, title string, cited int")
    assert sorted((r["id"], r["cited"]) for r in enrichment.enrich(docs, works, ["cited"]).collect()) == [(1, 5), (2, 7), (3, None)]
    a = spark.createDataFrame([(1, "", "J1")], "id long, authors string, journal string")
    b = spark.createDataFrame([(1, "X", "J2"), (2, "Y", None)], "id long, authors string, journal string")
    got = enrichment.backfill(docs.withColumn("journal", F.lit("own")), [a, b])
    assert sorted((r["id"], r["authors"], r["journal"]) for r in got.collect()) == [(1, "X", "J1"), (2, "Y", "own"), (3, None, "own")]
    held = docs.withColumn("authors", F.lit("Z"))
    assert {r["id"]: r["authors"] for r in enrichment.backfill(held, [b], missing_only=True).collect()} == {1: "Z", 2: "Y", 3: "Z"}


def test_expanding_folds_find_stretches_by_halving(spark):
    """No filter walks through all cuts; as a step of the ranks' join, Spark lost the column that it walked for on large tables."""
    df = spark.range(20000).select("id", (F.col("id") * 7 % 20000).cast("timestamp").alias("t"))
    out = models.folds(df, "timeseries", 4, "id", order="t").groupBy("fold").agg(F.count("*").alias("n"), F.min(F.col("t").cast("long")).alias("least"))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(f, 4000, 4000 * (f + 1)) for f in range(-1, 4)]
