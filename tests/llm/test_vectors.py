import numpy as np

from quernstone.llm import covertree, egojoin, queries


def vectors(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)


def best(ids, x, q, k=10):
    s = x @ x[q]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), int(s[i])) for i in order]


def test_top_k_query(spark, folder):
    ids, x = vectors(spark, folder)
    x = np.floor(1024 * x)
    got = {}
    for r in queries.op3_topk(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {int(ids[q]): best(ids, x, q) for q in np.flatnonzero(ids % 100 == 0)}


def test_top_k_trees(spark):
    """Many equal vectors, ties, small shards and blocks."""
    rng = np.random.default_rng(2)
    x = rng.integers(-5, 6, (700, 6)).astype(float)
    x[100:400] = x[100]
    df = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<long>")
    got = {}
    for r in covertree.top_k(df.filter("id % 10 = 0"), df, 7, shard=90, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert got == {q: best(np.arange(700), x, q, 7) for q in range(0, 700, 10)}


def odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (100, [1.0, 0.01]), (None, [1.0, 0.0])]
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cls string")


def test_odd_vectors(spark):
    df = odd(spark)
    found = covertree.top_k((v := covertree.integers(df, "vec_id", "embedding")).filter("id % 100 = 0"), v)
    assert [r["id"] for r in found.filter("query_id = 0").orderBy("rank").collect()] == [1, 8, 100, 4, 9, 9]
    assert covertree.top_k(v.limit(0), v.limit(0)).count() == 0
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in egojoin.near_duplicates(df).collect()), key=str)
    want = [(0, 3, 0, True), (1, 3, 0, False), (8, 3, 0, False), (100, 3, 0, False), (9, 1, 9, True), (9, 1, 9, True), (None, 0, None, True)]
    assert got == sorted(want + [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7)], key=str)
    assert egojoin.near_duplicates(df.limit(0)).count() == 0


def links(spark, groups, ids, x, got, least=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = u @ u.T >= least
    np.fill_diagonal(m, False)
    g = groups(ids.tolist())
    for a, b in zip(*np.nonzero(m)):
        if a < b:
            g.join(int(ids[a]), int(ids[b]))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {int(i): (int(n), g.find(int(i))) for i, n in zip(ids, m.sum(axis=1))}


def test_near_query(spark, folder, groups):
    links(spark, groups, *vectors(spark, folder), queries.op10_embeddings(spark, folder).collect())


def test_near_groups(spark, groups):
    """Dense groups over many small blocks, copies, and links across blocks."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5))
    x = centres[rng.integers(0, 6, 600)] + rng.normal(scale=0.35, size=(600, 5))
    x[50:120] = x[50]
    ids = rng.permutation(600)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    links(spark, groups, ids, x, egojoin.near_duplicates(df, least=0.97, block=32).collect(), 0.97)
