import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import density


def blobs(seed=1, noise=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 6)) * 3
    parts = [c + rng.normal(scale=s, size=(n, 6)) for c, s, n in zip(centres, (0.1, 0.2, 0.4, 0.15), (30, 25, 40, 12))]
    x = np.concatenate([*parts, rng.normal(size=(noise, 6)) * 3])
    x[3:9] = x[3]  # copies
    return x


def reachability(x, samples):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = np.round(np.sqrt(np.maximum(0, 2 - 2 * u @ u.T)), 7)
    core = [np.sort(np.delete(d[i], i))[:samples][-1] for i in range(len(x))]
    return np.maximum(d, np.maximum.outer(core, core))


def kruskal(w):
    groups, out = list(range(len(w))), []
    for d, a, b in sorted((w[a, b], a, b) for a in range(len(w)) for b in range(a + 1, len(w))):
        if groups[a] != groups[b]:
            old = groups[b]
            groups = [groups[a] if g == old else g for g in groups]
            out.append((a, b, d))
    return out


def plain(w, least):
    """Clusters by cutting the graph itself: at each distance, the parts that closer links hold together."""

    def parts(rows, limit):
        left, out = set(rows), []
        while left:
            part, todo = set(), [left.pop()]
            while todo:
                a = todo.pop()
                part.add(a)
                near = {b for b in left if w[a, b] < limit}
                left -= near
                todo += near
            out.append(sorted(part))
        return out

    def grow(rows, birth):
        """(stability, members, clusters below that stay) of a cluster that begins at ``birth``."""
        stable, now = 0.0, rows
        while True:
            limit = max(d for _, _, d in kruskal(w[np.ix_(now, now)]))
            edge = 1 / max(limit, 1e-7)
            big, small = [], []
            for p in parts(now, limit):
                (big if len(p) >= least else small).append(p)
            stable += sum(len(p) for p in small) * (edge - birth)
            if len(big) == 1:
                now = big[0]
                continue
            stable += sum(len(p) for p in big) * (edge - birth)
            below = [grow(p, edge) for p in big]
            return (stable, [rows], 0) if stable >= sum(b[0] for b in below) - 1e-9 or not below else (sum(b[0] for b in below), [m for b in below for m in b[1]], 0)

    rows = list(range(len(w)))
    now, birth = rows, 0.0
    while True:  # the cluster of all rows is never one that stays
        limit = max(d for _, _, d in kruskal(w[np.ix_(now, now)]))
        big = [p for p in parts(now, limit) if len(p) >= least]
        if len(big) == 1:
            now = big[0]
            continue
        return sorted(m for p in big for m in grow(p, 1 / max(limit, 1e-7))[1])


@pytest.mark.parametrize("few, block", [(density.FEW, 1000), (0, 30)])
def test_tree_and_clusters_as_brute_force(spark, few, block):
    """One task or Boruvka's rounds; one block or several."""
    x = blobs()
    df = spark.createDataFrame([(1000 + i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    df = df.unionByName(spark.createDataFrame([(1, None), (2, [0.0] * 6)], "vec_id long, embedding array<double>"))
    got = {}
    for r in density.clusters(df, samples=4, least=8, few=few, block=block).collect():
        assert r["noise"] == (r["cluster"] is None)
        got.setdefault(r["cluster"], []).append(r["vec_id"])
    noise = got.pop(None)
    want = plain(reachability(x, 4), 8)
    assert sorted(sorted(i - 1000 for i in m) for m in got.values()) == want and len(want) >= 3
    assert {1, 2} <= set(noise) and all(c == min(m) for c, m in got.items())


def test_spanning_tree_of_many_equal_weights(spark):
    rng = np.random.default_rng(4)
    edges = {(int(min(p)), int(max(p))): float(rng.integers(1, 5)) for p in rng.integers(0, 60, (400, 2)) if p[0] != p[1]}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, w double")
    groups, want = list(range(60)), []
    for (a, b), w in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        if groups[a] != groups[b]:
            old = groups[b]
            groups = [groups[a] if g == old else g for g in groups]
            want.append((a, b, w))
    for few in (0, 20, 10_000):
        assert sorted(map(tuple, density.spanning_tree(df, few).collect())) == sorted(want)


def test_few_rows(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "vec_id long, embedding array<float>")
    assert {(r["cluster"], r["noise"]) for r in density.clusters(df).collect()} == {(None, True)}
    assert density.clusters(df.limit(1)).count() == 1 and density.clusters(df.limit(0)).count() == 0


def test_wide_blocks_meet_in_parts(spark):
    """Many rows stand in at most so many blocks, so what is shuffled grows with the rows; a task still takes a part of a block at a time."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)) + 4 * rng.normal(size=(5, 6))[rng.integers(0, 5, 400)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, density.clusters(df, block=1000).collect()), key=str)
    assert sorted(map(tuple, density.clusters(df, block=7).collect()), key=str) == want and {r[1] for r in want} - {None}
    rows = df.select(F.col("vec_id").alias("row"), F.col("embedding").alias("v"))
    assert len({r["i"] for r in density._meetings(rows, density.BLOCKS).select("i").collect()}) < density.BLOCKS == 48


def test_tree_from_few_nearest(spark):
    """What is among no row's two nearest is looked for where it may be shorter; the tree is as short as that of all pairs, and plans don't grow."""
    x = blobs(seed=3)
    w = reachability(x, 2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, v array<double>").repartition(3)
    near = density.nearest(rows.filter("row not between 4 and 8"), 2, 7, 10)  # 3 to 8 are copies
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = np.round(np.sqrt(np.maximum(0, 2 - 2 * u @ u.T)), 7)
    for r in near.select("row", "near").collect():
        others = np.sort(np.delete(d[r["row"]], [r["row"], *range(4, 9)]))
        assert [e["d"] for e in r["near"]] == others[:2].tolist() and all(d[r["row"], e["other"]] == e["d"] for e in r["near"])
    cored = density.core_distances(near.withColumn("times", F.when(F.col("row") == 3, 6).otherwise(1)), 2, 2)
    tree = density.shortest_edges(cored, block=20)
    kept = [i for i in range(len(x)) if not 4 <= i <= 8]
    got, want = [r["w"] for r in tree.collect()], [e for _, _, e in kruskal(w[np.ix_(kept, kept)])]
    assert sorted(got) == pytest.approx(sorted(want), abs=1e-12)
    assert len(tree._jdf.queryExecution().analyzed().constraints().mkString()) < 200


def test_two_blocks_meet_once(spark):
    rows = spark.range(200).select(F.col("id").alias("row"), F.array(F.lit(1.0)).alias("v"))
    far = f"least(j - i, 9 - j + i) > {density.BESIDE}"
    met = [(r["i"], r["j"]) for pairs in ("i = j", f"i < j and not {far}", f"i < j and {far}") for r in density._meetings(rows, 9, pairs=pairs).select("i", "j").collect()]
    assert sorted(met) == [(i, j) for i in range(9) for j in range(i, 9)]


def test_rows_that_wait_for_a_shorter_edge():
    """Row 2 may have an edge of 1 not seen yet, so its edge of 3 is not taken; the others take theirs."""
    rows, seen = np.array([5, 6, 7, 8]), (np.array([5, 7, 6]), np.array([6, 8, 7]), np.array([1.0, 1.0, 3.0]))
    of, need = density.settled(rows, np.array([9.0, 9.0, 1.0, 9.0]), *seen)
    assert len(set(of)) == 1 and (need == -np.inf).all()  # 5 and 6 may take it
    of, need = density.settled(rows, np.array([9.0, 2.0, 1.0, 9.0]), *seen)
    assert of.tolist() == [0, 0, 2, 2] and sorted(need) == [-np.inf, -np.inf, 3.0, 3.0]
