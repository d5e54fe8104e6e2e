"""Clusters by density, with noise: a hierarchy over mutual reachability distances.

1. Rows are dealt into blocks, and every two blocks meet once, in one task, which finds for the rows of both what is nearer than
   the ``NEAREST`` nearest others known so far.  The core distance of a row is that to its ``samples``-th nearest other row; two rows
   are as far apart as the largest of their distance and their two core distances.
2. A minimum spanning tree of all rows under that distance, by Boruvka's rounds: each component takes its shortest edge, and
   components merge.  An edge that is not among a row's nearest is at least as long as the last of those, so most components know
   their shortest edge at once.  Where a longer one was found only, the rows that may have a shorter one meet all rows of other
   components that may have it too, and the rounds go on.  Nothing is left out by that: no edge that was not looked at can be shorter.
3. The tree's edges, from short to long, give the hierarchy; edges of one length merge at once, so the choice
   among equal edges doesn't matter.  Groups of fewer than ``least`` rows fall out of their cluster, larger ones
   split it.  Of a cluster and those that it splits into, the more stable side stays: stability is the sum, over
   its rows, of 1 / distance where they leave it less 1 / distance where it began.
4. Rows of no cluster that stays are noise.

Distances are Euclidean between unit vectors, rounded to seven places.  Work grows with the square of the rows, shared out by
pairs of blocks; there are at most ``BLOCKS`` / 2 of them until a block holds ``WIDEST`` rows, so what is shuffled grows with the rows only,
and a task makes the distances of ``BLOCK`` rows by ``BLOCK`` at a time.  The rounds on the tree's edges and the hierarchy are made in one task from one edge for each row, so at most ``MOST`` rows are
clustered; more are an error, not a sample.  Rows whose vector has no direction are noise; all rows together are never one cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved, written
from .vector_index import directed

#: Rows in a block, edges that one task joins, rows of a hierarchy.
BLOCK, FEW, MOST = 1000, 262_144, 2_000_000
#: Blocks that meet each other at most, twice over, and rows of a block beyond which there are more.
BLOCKS, WIDEST = 48, 65_536
#: Nearest others of a row that are kept, at least; blocks on either side that meet before all others do.
NEAREST, BESIDE = 16, 2

DIGITS = 7


def _matrix(values: pa.StructArray) -> np.ndarray:
    vectors = values.field("v")
    rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(float)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.StructArray, pa.StructArray]]:
    """Two blocks at a time, where Arrow holds them."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.column("i")[at].as_py(), batch.column("j")[at].as_py(), batch.column("x")[at].values, batch.column("y")[at].values


def _parts(n: int, part: int) -> list[slice]:
    return [slice(at, at + part) for at in range(0, n, part)]


def _length(products: np.ndarray) -> np.ndarray:
    """The distance of unit vectors by their inner product."""
    return np.round(np.sqrt(np.maximum(0.0, 2.0 - 2.0 * products)), DIGITS)


def _blocks(n: int, block: int) -> int:
    return max(1, min(-(-n // block), BLOCKS // 2), -(-n // WIDEST))


def _packed(rows: DataFrame, blocks: int, *columns: str) -> DataFrame:
    """(block, rows): the rows of each block as an array of structs."""
    return saved(rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("row", "v", *columns)).alias("rows")))


def _joined(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, x, y) for pairs of blocks (few, as long): a block goes once to each pair it is in, a task has about one pair."""
    side = lambda packed, k, name: packed.join(F.broadcast(pairs), F.col("block") == F.col(k)).select("i", "j", F.col("rows").alias(name)).repartition(tasks, "i", "j")
    tasks = max(1, pairs.count())
    return side(left, "i", "x").join(side(right, "j", "y").hint("merge"), ["i", "j"])


def _meetings(rows: DataFrame, blocks: int, *columns: str, pairs: str | None = None) -> DataFrame:
    """(i, j, x, y): every two blocks of rows, as arrays of structs; a single block meets itself."""
    packed = _packed(rows, blocks, *columns)
    numbers = rows.sparkSession.range(blocks)
    both = numbers.select(F.col("id").alias("i")).crossJoin(numbers.select(F.col("id").alias("j"))).filter(pairs or ("i < j" if blocks > 1 else "i = j"))
    return _joined(both, packed, packed)


class _Nearest:
    """The nearest others of rows, as these meet them; ``limit`` is the distance below which one counts."""

    def __init__(self, limit: np.ndarray, k: int):
        self.limit, self.k = limit.copy(), k
        none = np.zeros(0, np.int64)
        self.found, self.fresh = [(none, np.zeros(0), none)], 0

    def take(self, at: slice, products: np.ndarray, others: np.ndarray, axis: int = 0) -> None:
        """Rows ``at`` by others; their products lie along ``axis``."""
        limit = self.limit[at]
        if open_ := not np.isfinite(limit).all():
            products, axis = products if axis == 0 else products.T, 0
            m = min(self.k, products.shape[1])
            j = np.argpartition(products, products.shape[1] - m, axis=1)[:, -m:].ravel()
            i = np.repeat(np.arange(len(limit)), m)
        else:  # less than half a unit of the last digit off, so that none that rounds below the limit is missed
            least = np.where(limit > 0, 1.0 - np.maximum(0.0, limit - 0.4 * 10.0**-DIGITS) ** 2 / 2, np.inf)
            i, j = np.divmod(np.flatnonzero(products > (least[:, None] if axis == 0 else least)), products.shape[1])
            if axis == 1:
                i, j, products = j, i, products.T
        d = _length(products[i, j])
        near = d < limit[i]
        self.found.append((i[near] + at.start, d[near], others[j[near]]))
        self.fresh += int(near.sum())
        if open_ or self.fresh > self.k * len(self.limit):
            self.trim()

    def trim(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, d, o = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((o, d, i))
        i, d, o = i[order], d[order], o[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        kept = rank < self.k
        last = rank == self.k - 1
        self.limit[i[last]] = np.minimum(self.limit[i[last]], d[last])
        self.found, self.fresh = [(i[kept], d[kept], o[kept])], 0
        return self.found[0]


def nearest(rows: DataFrame, k: int, blocks: int, part: int = BLOCK) -> DataFrame:
    """(row, v, near): the k nearest others of each row (all, if fewer), as structs (d, other) from near to far.

    Blocks meet themselves first, then those beside them, then all others: what is known by then keeps later finds few.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, x, y in _met(batches):
            sides = []
            for v in (x,) if i == j else (x, y):
                limit = v.field("limit").to_numpy(zero_copy_only=False)
                sides.append((_matrix(v), v.field("row").to_numpy(zero_copy_only=False), _Nearest(limit, k)))
            (a, a_rows, a_best), (b, b_rows, b_best) = sides[0], sides[-1]
            for p in _parts(len(a), part):
                for q in _parts(len(b), part):
                    if i == j and q.start < p.start:
                        continue
                    products = a[p] @ b[q].T
                    if same := i == j and p == q:
                        np.fill_diagonal(products, -np.inf)
                    a_best.take(p, products, b_rows[q])
                    if not same:
                        b_best.take(q, products, a_rows[p], 1)
            for _, own, best in sides:
                at, d, o = best.trim()
                heads, starts = np.unique(at, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), pa.StructArray.from_arrays([pa.array(d), pa.array(o, pa.int64())], ["d", "other"]))
                yield pa.RecordBatch.from_arrays([pa.array(own[heads], pa.int64()), lists], ["row", "near"])

    kind = "array<struct<d: double, other: bigint>>"
    far = f"least(j - i, {blocks} - j + i) > {BESIDE}"
    state = rows.withColumn("near", F.array().cast(kind))
    for pairs in ("i = j", f"i < j and not {far}", f"i < j and {far}")[: 1 if blocks == 1 else 2 if blocks <= 2 * BESIDE + 1 else 3]:
        limit = F.when(F.size("near") >= k, F.element_at("near", -1)["d"]).otherwise(float("inf"))
        met = _meetings(state.select("row", "v", limit.alias("limit")), blocks, "limit", pairs=pairs).mapInArrow(near, f"row long, near {kind}")
        met = met.unionByName(state.select("row", "near"))
        best = met.groupBy("row").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
        state = saved(rows.join(best, "row"))
    return state


class _Groups:
    """Union of numbered groups."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The spanning forest of a partition's edges."""
    parts = list(batches)
    if parts:
        edges = pd.concat(parts).sort_values(["w", "a", "b"])
        groups = _Groups()
        yield edges[[groups.join(a, b) for a, b in zip(edges["a"], edges["b"])]]


def spanning_tree(edges: DataFrame, few: int = FEW) -> DataFrame:
    """The minimum spanning forest of edges (a < b, w); equal weights go by (a, b).

    In each round every component takes its shortest edge out, which merges at least two of them into one.
    """
    kinds, tree = "a long, b long, w double", None
    edges = written(edges.select("a", "b", "w").mapInPandas(_forest, kinds))
    live = edges.withColumns({"p": F.col("a"), "q": F.col("b")})
    while (n := live.count()) > few:
        both = live.unionByName(live.withColumns({"p": F.col("q"), "q": F.col("p")}))
        best = written(both.groupBy("p").agg(F.min(F.struct("w", "a", "b", "q")).alias("e")).select("p", "e.*"))
        picked = best.select("a", "b", "w").distinct()
        tree = picked if tree is None else tree.unionByName(picked)
        back = best.select(F.col("p").alias("q"), F.col("q").alias("back"))
        to = written(best.join(back, "q").select("p", F.when((F.col("back") == F.col("p")) & (F.col("p") < F.col("q")), F.col("p")).otherwise(F.col("q")).alias("to")))
        while True:  # every component follows its way to the root of its tree
            on = written(to.join(to.select(F.col("p").alias("to"), F.col("to").alias("next")), "to").select("p", "to", "next"))
            if on.filter("to <> next").isEmpty():
                break
            to = on.select("p", F.col("next").alias("to"))
        of = lambda c: to.select(F.col("p").alias(c), F.col("to").alias(f"{c}_"))  # noqa: E731, B023
        live = live.join(of("p"), "p").join(of("q"), "q").select("a", "b", "w", F.col("p_").alias("p"), F.col("q_").alias("q"))
        live = written(live.filter("p <> q").groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "e.w", "p", "q"))
    if n:

        def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = list(batches)
            if parts:
                rest = pd.concat(parts).sort_values(["w", "a", "b"])
                groups = _Groups()
                yield rest[[groups.join(p, q) for p, q in zip(rest["p"], rest["q"])]][["a", "b", "w"]]

        rest = live.select("a", "b", "w", "p", "q").coalesce(1).mapInPandas(finish, kinds)  # at most ``few``
        tree = rest if tree is None else tree.unionByName(rest)
    return written(tree if tree is not None else edges.limit(0))


def settled(rows: np.ndarray, unseen: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of each row, and the length below which it may have an edge not seen yet that its component needs (-inf: none).

    Components merge along their shortest edge as long as it is not longer than any that they have not seen (``unseen`` is
    the least that such an edge of a row can have).  The component with most rows to look from waits for the others.
    """
    order = np.lexsort((b, a, w))
    p, q, w = np.searchsorted(rows, a[order]), np.searchsorted(rows, b[order]), w[order]
    n, whole = len(rows), np.arange(len(rows))
    of = whole.copy()
    while True:
        live = of[p] != of[q]
        p, q, w = of[p[live]], of[q[live]], w[live]
        least, first = np.full(n, np.inf), np.full(n, len(w))
        np.minimum.at(least, of, unseen)
        np.minimum.at(first, p, np.arange(len(w)))
        np.minimum.at(first, q, np.arange(len(w)))
        short = np.append(w, np.inf)[first]
        sure = whole[(first < len(w)) & (short <= least)]
        if not len(sure):
            break
        to = whole.copy()
        to[sure] = p[first[sure]] + q[first[sure]] - sure
        both = sure[(to[to[sure]] == sure) & (sure < to[sure])]
        to[both] = both
        while (to[to] != to).any():
            to = to[to]
        of = to[of]
    need = short[of]
    looks = np.bincount(of[unseen < need], minlength=n)
    need[of == looks.argmax()] = -np.inf
    return of, need


def _found(left: DataFrame, right: DataFrame, block: int) -> DataFrame:
    """(row, other, w): for each row of ``left`` its shortest edge to a row of ``right`` in another component, if one is shorter than ``need``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x, y in _met(batches):
            (a, of_a, core_a, rows_a), (b, of_b, core_b, rows_b) = ((_matrix(v), *(v.field(c).to_numpy(zero_copy_only=False) for c in ("of", "core", "row"))) for v in (x, y))
            best, other, within = x.field("need").to_numpy(zero_copy_only=False).copy(), np.full(len(a), -1), 1.0 - core_b**2 / 2
            for p in _parts(len(a), block):
                for q in _parts(len(b), block):
                    products = np.minimum(a[p] @ b[q].T, within[q])
                    products[of_a[p][:, None] == of_b[q]] = -np.inf
                    j = products.argmax(axis=1)
                    at = np.arange(len(j))
                    w = np.maximum(np.maximum(_length(np.einsum("ij,ij->i", a[p], b[q][j])), core_a[p]), core_b[q][j])
                    shorter = (products[at, j] > -np.inf) & (w < best[p])
                    best[p] = np.where(shorter, w, best[p])
                    other[p] = np.where(shorter, rows_b[q][j], other[p])
            hit = other >= 0
            yield pa.RecordBatch.from_arrays([pa.array(rows_a[hit], pa.int64()), pa.array(other[hit], pa.int64()), pa.array(best[hit])], ["row", "other", "w"])

    spark = left.sparkSession
    sizes = [_blocks(side.count(), block) for side in (left, right)]
    pairs = spark.range(sizes[0]).select(F.col("id").alias("i")).crossJoin(spark.range(sizes[1]).select(F.col("id").alias("j")))
    met = _joined(pairs, _packed(left, sizes[0], "of", "core", "need"), _packed(right, sizes[1], "of", "core"))
    found = met.mapInArrow(look, "row long, other long, w double")
    return found.groupBy("row").agg(F.min(F.struct("w", "other")).alias("e")).select("row", "e.other", "e.w")


def core_distances(state: DataFrame, samples: int, k: int) -> DataFrame:
    """(row, v, near, core, unseen) of rows (row, v, near, times) that stand for so many copies; with no more rows than ``samples`` core is that to the farthest one.

    ``unseen``: the least that an edge to a row not in ``near`` can have.
    """
    times = state.select(F.col("row").alias("other"), F.col("times").alias("times_"))
    each = state.select("row", F.explode("near").alias("e")).select("row", "e.*").join(times, "other")
    counted = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("d", "times_"))).alias("counted"))
    start = F.struct((F.col("times") - 1).alias("n"), F.lit(0.0).alias("d"))
    step = lambda acc, x: F.when(acc["n"] >= samples, acc).otherwise(F.struct((acc["n"] + x["times_"]).alias("n"), x["d"].alias("d")))
    core = F.coalesce(F.aggregate("counted", start, step)["d"], F.lit(0.0))
    last = F.when(F.size("near") >= k, F.element_at("near", -1)["d"]).otherwise(float("inf"))  # with fewer, all others are known
    return written(state.join(counted, "row", "left").select("row", "v", "near", core.alias("core"), F.greatest(core, last).alias("unseen")))


def shortest_edges(rows: DataFrame, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """(a < b, w): a minimum spanning tree of rows (row, v, near, core, unseen) under their mutual reachability."""
    far = rows.select(F.col("row").alias("other"), F.col("core").alias("core_"))
    edges = rows.select("row", "core", F.explode("near").alias("e")).select("row", "core", "e.*").join(far, "other")
    edge = lambda df: df.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b"), "w")
    tree = spanning_tree(edge(edges.withColumn("w", F.greatest("d", "core", "core_"))).distinct(), few)
    unseen = rows.select("row", "unseen")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            both = pd.concat(parts)
            own, edges = both[both["b"] < 0].sort_values("a"), both[both["b"] >= 0]
            names, least = own["a"].to_numpy(), own["w"].to_numpy()
            of, need = settled(names, least, *(edges[c].to_numpy() for c in "abw"))
            most = np.where(least < need, need, -np.inf).max()
            at = least < most
            yield pd.DataFrame({"row": names[at], "of": names[of[at]], "unseen": least[at], "need": need[at]})

    while True:
        given = tree.unionByName(unseen.select(F.col("row").alias("a"), F.lit(-1).cast("long").alias("b"), F.col("unseen").alias("w")))
        open_ = written(given.coalesce(1).mapInPandas(settle, "row long, of long, unseen double, need double"))  # an edge and a length for each row, MOST at most
        if open_.isEmpty():
            return tree
        able = written(open_.join(rows.select("row", "v", "core"), "row"))
        asked = able.filter("unseen < need")
        found = written(_found(asked, able, block))
        tree = spanning_tree(tree.unionByName(edge(found)), few)
        looked = asked.select("row", "need").join(found.select("row", "w"), "row", "left").select("row", F.coalesce("w", "need").alias("least"))
        unseen = written(unseen.join(looked, "row", "left").select("row", F.greatest("unseen", "least").alias("unseen")))


def hierarchy(a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> dict[int, int]:
    """The cluster of each row that a spanning tree's edges join; a cluster's number is its smallest row; rows of none are left out."""
    order = np.lexsort((b, a, w))
    groups, children, weight, size = _Groups(), {}, {}, {}
    top: dict[int, int] = {}  # the node of a group's root; rows are their own nodes
    fresh = int(max(a.max(), b.max())) + 1
    at = 0
    while at < len(order):
        to = at
        merged: dict[int, list[int]] = {}
        while to < len(order) and w[order[to]] == w[order[at]]:
            p, q = groups.find(int(a[order[to]])), groups.find(int(b[order[to]]))
            if p != q:
                nodes = [n for r in (p, q) for n in merged.pop(r, [top.get(r, r)])]
                groups.join(p, q)
                merged[groups.find(p)] = nodes
            to += 1
        for root, nodes in merged.items():
            children[fresh], weight[fresh], size[fresh] = nodes, float(w[order[at]]), sum(size.get(n, 1) for n in nodes)
            top[root] = fresh
            fresh += 1
        at = to

    def rows(node: int) -> Iterator[int]:
        stack = [node]
        while stack:
            n = stack.pop()
            if n in children:
                stack += children[n]
            else:
                yield n

    birth, stable, parent, inside = [0.0], [0.0], [-1], [[]]
    stack = [(fresh - 1, 0)]
    while stack:
        node, c = stack.pop()
        edge = 1.0 / max(weight[node], 10.0**-DIGITS)
        large = [n for n in children[node] if size.get(n, 1) >= least]
        for n in children[node]:
            if n not in large:
                inside[c] += rows(n)
                stable[c] += size.get(n, 1) * (edge - birth[c])
        if len(large) == 1:
            stack.append((large[0], c))
            continue
        for n in large:
            stable[c] += size[n] * (edge - birth[c])
            birth.append(edge), stable.append(0.0), parent.append(c), inside.append([])
            stack.append((n, len(birth) - 1))
    worth, below = list(stable), [0.0] * len(stable)
    stays = [False] * len(stable)
    for c in range(len(stable) - 1, 0, -1):
        stays[c] = stable[c] >= below[c] - 1e-9 * abs(below[c])
        worth[c] = max(stable[c], below[c])
        below[parent[c]] += worth[c]
    of, number, found = [-1] * len(stable), {}, {}
    for c in range(1, len(stable)):
        above = of[parent[c]]
        of[c] = above if above >= 0 else c if stays[c] else -1
        for r in inside[c] if of[c] >= 0 else ():
            found[r] = of[c]
            number[of[c]] = min(number.get(of[c], r), r)
    return {r: number[c] for r, c in found.items()}


def clusters(df: DataFrame, key: str = "vec_id", vector: str = "embedding", samples: int = 5, least: int = 10, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """(key, cluster, noise) of each row; a cluster's number is the smallest key in it, null for noise."""
    kind = dict(df.dtypes)[key]
    plainly = F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else F.transform(vector, lambda x: x.cast("double"))  # half the bytes; workers make doubles of both
    rows = saved(df.select(F.col(key).alias("key"), directed(F.col(vector)).alias("able"), plainly.alias("v")).withColumn("row", F.monotonically_increasing_id()))
    able = rows.filter("able").select("row", "v")
    n = able.count()
    if n > MOST:
        raise ValueError(f"at most {MOST} rows can be clustered")
    plain = rows.select(F.col("key").alias(key), F.lit(None).cast(kind).alias("cluster"), F.lit(True).alias("noise"))
    if n < 2:
        return plain
    k = max(samples, NEAREST)
    same = written(able.groupBy("v").agg(F.min("row").alias("row"), F.count("*").alias("times")))  # of equal vectors one meets the others
    near = nearest(same.select("row", "v"), k, _blocks(same.count(), block), block)
    cored = core_distances(near.join(same.select("row", "times"), "row"), samples, k)
    copies = able.join(same.filter("times > 1").select("v", F.col("row").alias("first")), "v").filter("row <> first").select("row", "first")
    copies = copies.join(cored.select(F.col("row").alias("first"), F.col("core").alias("w")), "first").select(F.col("first").alias("a"), F.col("row").alias("b"), "w")
    tree = shortest_edges(cored, few, block).unionByName(copies)

    def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            edges = pd.concat(parts)
            found = hierarchy(*(edges[c].to_numpy() for c in "abw"), least)
            yield pd.DataFrame({"row": list(found), "of": list(found.values())}, dtype="int64")

    found = tree.coalesce(1).mapInPandas(labels, "row long, of long")  # an edge for each row, MOST at most
    out = rows.join(found, "row", "left")
    names = out.filter("of is not null").groupBy("of").agg(F.min("key").alias("cluster"))
    return out.join(names, "of", "left").select(F.col("key").alias(key), "cluster", F.col("of").isNull().alias("noise"))
