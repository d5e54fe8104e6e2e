import numpy as np
import pytest

from quernstone.operators import search, vector_index


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def clustered(n=1500, wide=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, wide))
    return centres[rng.integers(0, 25, n)] + rng.normal(scale=0.15, size=(n, wide)), rng


def found(df):
    return [(r["vec_id"], None if r["similarity"] is None else round(r["similarity"], 9)) for r in df.collect()]


def test_exact_search_equals_the_scan(spark, tmp_path):
    """Ties, copies, vectors without a direction; more asked for than there is."""
    x, rng = clustered()
    x[200:320] = x[200]
    extra = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [1.0] * 3)]
    df = vectors(spark, x, extra)
    index = vector_index.build(df, str(tmp_path / "i"))
    assert index.without == 4 and int(index.cells["n"].sum()) == 1500
    again = vector_index.load(spark, str(tmp_path / "i"))
    clean = df.filter("vec_id < 5000")
    for q in (x[250], rng.normal(size=16)):
        query = [float(v) for v in q]
        for k in (10, 150):
            assert found(index.nearest(spark, query, k)) == found(search.nearest(clean, query, k)) == found(again.nearest(spark, query, k))
    many = index.nearest(spark, [float(v) for v in x[0]], 1600)
    assert many.count() == 1504 and found(many)[1500:] == [(5000, None), (5001, None), (5002, None), (5003, None)]


def test_only_some_folders_are_read(spark, tmp_path):
    x, _ = clustered()
    index = vector_index.build(vectors(spark, x), str(tmp_path / "i"), cells=40)
    query = [float(v) for v in x[11]]
    for df in (index.nearest(spark, query, 10, probes=3), index.nearest(spark, query, 10)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [cell" in plan
        assert df.inputFiles() and len(df._jdf.queryExecution().optimizedPlan().toString())
    read = index.rows(spark, index.cells["cell"].to_numpy()[np.argsort(index.angles(query))[:3]].tolist())
    assert 0 < read.count() < 600


def test_many_queries_and_recall(spark, tmp_path):
    x, _ = clustered()
    df = vectors(spark, x)
    index = vector_index.build(df, str(tmp_path / "i"))
    queries = df.filter("vec_id % 100 = 0").selectExpr("vec_id as q", "embedding as e").unionByName(spark.createDataFrame([(-1, None)], "q long, e array<float>"))
    got = {}
    for r in index.nearest_of_many(queries, "q", "e", 10).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["vec_id"])
    unit = np.float32(x).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert got == {q: np.lexsort((np.arange(1500), -np.round(unit @ unit[q], 14)))[:10].tolist() for q in range(0, 1500, 100)}
    assert vector_index.recall(index, queries, "q", "e", 10, 4) >= 0.9


@pytest.mark.parametrize("n", [0, 1, 3])
def test_small_tables(spark, tmp_path, n):
    df = vectors(spark, np.eye(4)[:n])
    index = vector_index.build(df, str(tmp_path / "i"))
    assert found(index.nearest(spark, [1.0, 0.5, 0.25, 0.0], 2)) == found(search.nearest(df, [1.0, 0.5, 0.25, 0.0], 2))
