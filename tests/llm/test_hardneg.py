import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import hardneg, queries

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchors, positive=5, negative=3, low=50, high=95):
    """Rows (id, label, integer vector); a result for each row whose id is asked."""
    out = []
    width = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, c, [*v, *[0] * (width - len(v))]) for i, c, v in rows]
    for i, label, v in rows:
        if i not in anchors:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, c) for j, c, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positive]:
            fit = [(t, n) for t, n, c in scored if c != label and low * -s <= 100 * -t <= high * -s][:negative]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def test_query_as_brute_force_and_as_its_sql(spark, folder):
    rows = [r for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [int(x) for x in np.floor(256 * np.array(r["embedding"], float))]) for r in rows]
    have = got(queries.op12_negatives(spark, folder))
    assert have == brute(rows, {i for i, _, _ in rows if i % 50 == 0}) and have
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert have == sorted(duck.execute(f"SELECT {', '.join(NAMES)} FROM ({queries.SQL['op12_negatives']})").fetchall())


@pytest.mark.parametrize("shelf, block", [(8192, 512), (50, 16), (7, 3)])
def test_shelves_lanes_and_ties(spark, shelf, block):
    """Small whole numbers, so many scores tie; one label holds most rows; a third of the rows are copies; norms of every size."""
    rng = np.random.default_rng(shelf)
    x = rng.integers(-4, 6, (400, 4)) * rng.integers(1, 9, (400, 1))
    x[150:280] = x[150]
    rows = [(i, 0 if i % 3 else i % 7, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, c, [float(y) for y in v]) for i, c, v in rows], "vec_id long, label int, embedding array<double>")
    found = hardneg.mine(df, F.col("id") % 9 == 0, F.col("label"), scale=1.0, shelf=shelf, block=block)
    assert got(found) == brute(rows, set(range(0, 400, 9)))


def test_odd_rows(spark):
    """Nulls, NaN, infinite and empty vectors, shorter ones, zero vectors, repeated rows, clashing columns, empty tables."""
    nan, inf = float("nan"), float("inf")
    vectors = [[3.0, 1.0], [2.0, 2.0], [2.0], [], [0.0, 0.0], [-3.0, -1.0], [1.0, 1.0], [1.0, 0.0], [1.0, 1.0], [0.5, 2.0]]
    good = [(i, i % 2, v) for i, v in enumerate(vectors * 3)] + [(0, 0, [3.0, 1.0]), (4, 1, [1.0, 2.0]), (4, 0, [0.0, 0.0]), (-10, 1, [5.0, 5.0])]
    bad = [(50, 1, None), (60, None, [1.0, 1.0]), (70, 1, [nan, 1.0]), (80, 0, [inf, 1.0]), (90, 1, [None, 1.0]), (None, 1, [1.0, 1.0])]
    extra = ["id", "row", "norm", "part", "vector", "asked", "reach", "rank"]
    df = spark.createDataFrame([(*r, *[3] * len(extra)) for r in good + bad], "vec_id long, label int, embedding array<float>, " + ", ".join(f"{c} int" for c in extra))
    whole = [(i, c, [int(np.floor(2 * x)) for x in v]) for i, c, v in good]
    for shelf, block in ((8192, 512), (4, 2)):
        found = hardneg.mine(df, F.col("id") % 2 == 0, F.col("label"), scale=2.0, shelf=shelf, block=block)
        assert got(found) == brute(whole, {i for i, _, _ in whole if i % 2 == 0})
    for none in (df.limit(0), spark.createDataFrame(bad, "vec_id long, label int, embedding array<float>"), df.filter("vec_id = 0").limit(1)):
        assert hardneg.mine(none, F.col("id") % 2 == 0, F.col("label")).count() == 0


@pytest.mark.parametrize("size", [1 << 24, 1 << 31, 1 << 45])
def test_scores_beyond_doubles(spark, size):
    rows = [(i, i % 2, [size + i % 5, size - i % 3, i % 4]) for i in range(40)] + [(50 + i, i % 2, [size // 2 + size // 4 + i, size // 2 + i, 1]) for i in range(20)]
    df = spark.createDataFrame([(i, c, [float(x) for x in v]) for i, c, v in rows], "vec_id long, label int, embedding array<double>")
    want = [(*r[:4], min(r[4], 2**63 - 1), min(r[5], 2**63 - 1)) for r in brute(rows, {0, 10, 20, 55})]
    assert got(hardneg.mine(df, F.col("id").isin(0, 10, 20, 55), F.col("label"), scale=1.0, shelf=16, block=2)) == want and want


def test_buckets_are_skipped(spark, monkeypatch):
    """Norms that fall fast: most buckets are ruled out by the windows' limits or the running scores."""
    monkeypatch.setattr(hardneg, "BUCKET", 50)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(2000, 8)) * 1000 / np.arange(1, 2001)[:, None] ** 0.5).astype(np.int64)
    ids, labels = np.arange(2000), np.arange(2000) % 5
    at = np.arange(20)
    walk = hardneg.Walk(ids[:20], labels[:20], x[:20], at, [None] * 20, [None] * 20, 5, True)
    order = np.argsort(-np.sqrt((x * x).sum(axis=1)), kind="stable")
    assert walk.shelf(ids[order], labels[order], x[order]) is False
    assert walk.products < 20 * 2000 / 4
    assert hardneg.window(7, 50, 95) == (4, 6) and hardneg.window(0, 50, 95) == (0, 0) and hardneg.window(1, 50, 95) == (1, 0)
