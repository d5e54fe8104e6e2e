"""Pruning, exactness beyond doubles, and components by either route."""

import random

import numpy as np
import pytest

from quernstone.llm import components, covertree, egojoin


def test_pairs_are_skipped_between_shards(spark):
    """Vectors in groups far apart: most blocks meet few of the shards, and few products are computed."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 4)) * 1000
    x = np.round(centres[rng.integers(0, 12, 3000)] + rng.normal(scale=5, size=(3000, 4))).astype(np.int64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<long>")
    got = {}
    for r in covertree.top_k(df.filter("id % 20 = 0"), df, 5, shard=100, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    for q in range(0, 3000, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:5]
        assert got[q] == [(int(i), int(s[i])) for i in order]
    search = covertree.Search(5)
    search.run(np.arange(0, 3000, 20), x[::20], np.arange(3000), x)
    assert search.products < 150 * 3000 / 2
    pivots = x[:30].astype(float)
    shards, asked = covertree._grouped(df, pivots, 100, 4, "shard"), covertree._grouped(df.filter("id % 20 = 0"), pivots, 16, 4, "block")
    worst = asked.select("block", (covertree.F.col("norm") * 900).alias("worst"))
    assert 0 < covertree._meetings(asked, shards, 4, 2, worst).count() < shards.count() * asked.count() / 2


@pytest.mark.parametrize("size", [1 << 29, 1 << 40])
def test_scores_beyond_doubles(spark, size):
    rows = [(0, [size, 1])] + [(i, [size if i < 40 else -size, 3 * (i % 7)]) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    score = {i: sum(a * b for a, b in zip(v, rows[0][1])) for i, v in rows}
    want = sorted((-score[i], i) for i in score if i)[:10]
    got = covertree.top_k(df.filter("id = 0"), df, 10, shard=7).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(i, min(-s, (1 << 63) - 1)) for s, i in want]


def test_repeated_query_ids(spark):
    df = spark.createDataFrame([(0, [1, 0]), (0, [0, 1]), (1, [5, 0]), (2, [0, 5])], "id long, vector array<long>")
    got = covertree.top_k(df.filter("id = 0"), df, 1).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == [(0, 1, 1, 5), (0, 1, 2, 5)]
    assert covertree.top_k(df.filter("id = 0"), df.limit(0), 1).count() == 0


def test_blocks_are_skipped(spark, groups):
    """Vectors along a curve: most pairs of blocks can't hold a link and do not meet; the links are those of all pairs."""
    n, rng = 2000, np.random.default_rng(5)
    t = rng.uniform(0, 2 * np.pi, n)
    x = np.column_stack((np.cos(t), np.sin(t), 0.3 * np.cos(3 * t), 0.3 * np.sin(3 * t)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    eps = float(np.sqrt(2 - 2 * 0.995)) + 1e-6
    _, distinct, kind = egojoin._classes(df, "vec_id", "embedding")
    basis = egojoin._principal([bytes(r["vector"]) for r in distinct.collect()], kind, 4)
    blocks = egojoin._blocks(distinct, kind, basis, eps, 32)
    all_ = blocks.count() * (blocks.count() + 1) // 2
    assert 0 < egojoin._box_pairs(blocks, 4, eps).count() < all_ / 4
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.995).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in egojoin.near_duplicates(df, least=0.995, block=32).collect()}
    assert got == {i: int(w) for i, w in enumerate(want)}


def test_vectors_of_other_lengths(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0]), (3, [0.0, 1.0]), (4, [0.0, 3.0, 0.1, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in egojoin.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3)]


@pytest.mark.parametrize("few, held", [(1 << 18, 1 << 18), (0, 5), (40, 0)])
def test_components(spark, groups, few, held):
    """A long path, a hub, repeated links and self links, by each route."""
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges += [(7, 7), (5, 6), (6, 5), (5, 6)]
    rng.shuffle(edges)
    g = groups({x for e in edges for x in e})
    for a, b in edges:
        if a != b:
            g.join(a, b)
    want = {x: g.find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(4)
    assert {r["id"]: r["component"] for r in components.components(df, few, held).collect()} == want
    assert components.components(df.limit(0), few, held).count() == 0
