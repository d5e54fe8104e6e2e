"""Exact top-k inner products by dual-tree search over cover trees.

Candidates are dealt into shards around pivots, and queries into blocks around the same
pivots, so both are the upper nodes of a cover tree: each has a centre and a radius that
covers its members.  A pair of nodes is skipped when even the best inner product that
their covering radii allow is below the worst kth score of the node's queries.

1. Each block of queries first meets the shards that promise most.
2. It then meets only those of the other shards that can still hold a better score than
   its worst kth one; the bounds are computed from centres and radii, before any vector moves.
3. Where a block meets a shard, both get a cover tree (a node's children cover their points
   within half its radius), and the two trees are walked together with the same bound.

The k best of each meeting are merged by rank.  Pivots come from a bounded sample; they
affect speed alone.  What can be skipped depends on the data: vectors in all directions of
a space of many dimensions have shards that no bound can rule out.

Defined results: vectors that are null or hold null or non-finite components take no
part; shorter vectors count as padded with zeros; rows with the query's own id are no
candidates for it; each row of a repeated query id gets its own list; equal scores go to
the smaller id; no queries give no rows.  Products are exact at any size: where doubles
are not, integers of 64 bits or of any length take their place; scores beyond a long are
ranked exactly (up to 2**125) and returned as the largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import saved

#: Vectors in a shard, queries in a block, points in a leaf; pivots at most, and rows to draw them from; shards that each block meets first.
SHARD, BLOCK, LEAF, PIVOTS, FIRST = 4096, 1024, 64, 1024, 2

#: A score is carried as high * 2**62 + score, so that those beyond a long can be ranked too.
_LOW, _LONG = 62, (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Neither null nor empty, and all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def padded(df: DataFrame, vector: str) -> DataFrame:
    """All vectors of one length; zeros fill the shorter ones."""
    most = df.agg(F.max(F.size(vector))).first()[0] or 0
    return df.withColumn(vector, F.concat(vector, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(most) - F.size(vector)))))


def _length(gaps: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", gaps, gaps))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, near enough to choose by; radii are measured exactly."""
    return np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)


class Node:
    __slots__ = ("center", "radius", "members", "children", "norm")

    def __init__(self, points: np.ndarray, members: np.ndarray, at: int, distance: np.ndarray, bound: float):
        """``distance``: of the members from point ``at``."""
        self.center, self.members = points[at], members
        self.norm = float(np.sqrt(self.center @ self.center))
        self.radius = float(distance.max()) if len(distance) else 0.0
        self.children: list[Node] = []
        if len(members) <= LEAF or self.radius == 0.0:
            return
        reach = min(bound, self.radius) / 2
        alone, rest = [], members[distance > reach]
        self._child(points, members[distance <= reach], at, reach, alone)
        while len(rest):
            lead = rest[:LEAF]  # the next centres, unless one of them covers another
            gap = _squares(points[rest], points[lead])
            free = np.ones(len(rest), bool)
            for c in range(len(lead)):
                if free[c]:
                    inside = free & (gap[:, c] <= reach * reach)
                    inside[c] = True
                    self._child(points, rest[inside], int(lead[c]), reach, alone)
                    free &= ~inside
            rest = rest[free]
        single = np.concatenate(alone) if alone else np.zeros(0, np.int64)
        if len(single):  # points with no company within reach stay together, covered by this node's radius
            leaf = Node.__new__(Node)
            leaf.center, leaf.norm, leaf.members, leaf.children = self.center, self.norm, single, []
            leaf.radius = float(_length(points[single] - self.center).max())
            self.children.append(leaf)

    def _child(self, points: np.ndarray, part: np.ndarray, at: int, reach: float, alone: list[np.ndarray]) -> None:
        if len(part) > 1:
            self.children.append(Node(points, part, at, _length(points[part] - points[at]), reach))
        else:
            alone.append(part)


def cover_tree(points: np.ndarray) -> Node:
    return Node(points, np.arange(len(points)), 0, _length(points - points[0]), float("inf"))


def exact_products(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Inner products of integer vectors, none above ``most`` in size: as floats while those are exact, else as integers."""
    if most < 2.0**53:
        return q.astype(np.float64) @ x.astype(np.float64).T
    if most < 2.0**62:
        return q @ x.T
    return q.astype(object) @ x.astype(object).T


class Best:
    """The k best candidates of each query so far, by score and then by smaller id."""

    def __init__(self, queries: int, k: int):
        self.found: list[list[tuple]] = [[] for _ in range(queries)]  # (-score, id), ascending
        self.kth = np.full(queries, -np.inf)  # rounded down
        self.k = k

    def worst(self, members: np.ndarray) -> float:
        return float(self.kth[members].min())

    def add(self, members: np.ndarray, scores: np.ndarray, own: np.ndarray, ids: np.ndarray) -> None:
        """Scores of leaves, but for those that are the query's ``own`` row."""
        able = (scores >= self.kth[members, None]) & ~own
        for r in np.flatnonzero(able.any(axis=1)):
            at = np.flatnonzero(able[r])
            who = int(members[r])
            if len(at) > 4 * self.k and scores.dtype != object:  # all that tie with the kth stay in
                cut = np.partition(scores[r][at], len(at) - self.k)[len(at) - self.k]
                at = at[scores[r][at] >= cut]
            new = sorted([*self.found[who], *((-s, i) for s, i in zip(scores[r][at].tolist(), ids[at].tolist()))])[: self.k]
            self.found[who] = new
            if len(new) == self.k:
                value = float(-new[-1][0])
                self.kth[who] = value - abs(value) * 1e-15


class Search:
    """Meetings of blocks with shards; counts the products that were computed."""

    def __init__(self, k: int):
        self.k, self.products = k, 0

    def run(self, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, least: np.ndarray | None = None, below: Node | None = None) -> Best:
        """Best of integer vectors (int64); ``least``: known lower bounds of each query's kth score; ``below``: the tree of x."""
        best = Best(len(q), self.k)
        if not len(q) or not len(x):
            return best
        if least is not None:
            best.kth = np.maximum(best.kth, least)
        high = [float(np.abs(v.astype(np.float64)).max(initial=0)) for v in (q, x)]
        most = max(1.0, high[0] * high[1] * q.shape[1])
        top, below = cover_tree(q.astype(np.float64)), below or cover_tree(x.astype(np.float64))
        slack = 1e-9 * (1 + (top.norm + top.radius) * (below.norm + below.radius))

        def bound(a: Node, b: Node) -> float:
            return float(a.center @ b.center) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius + slack

        stack = [(bound(top, below), top, below)]
        while stack:
            could, a, b = stack.pop()
            if could < best.worst(a.members):
                continue
            if not a.children and not b.children:
                self.products += len(a.members) * len(b.members)
                own = q_ids[a.members][:, None] == ids[b.members]
                best.add(a.members, exact_products(q[a.members], x[b.members], most), own, ids[b.members])
                continue
            if b.children and (not a.children or b.radius >= a.radius):
                pairs = [(bound(a, c), a, c) for c in b.children]
            else:
                pairs = [(bound(c, b), c, b) for c in a.children]
            stack += sorted(pairs, key=lambda p: p[0])  # the most promising pair comes off first
        return best


def _unpacked(rows: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (row, id, vector) of a group."""
    flat = rows.values
    numbers = [flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
    return *numbers, flat.field(2).flatten().to_numpy(zero_copy_only=False).reshape(len(flat), width)


def _grouped(df: DataFrame, pivots: np.ndarray, size: int, width: int, name: str) -> DataFrame:
    """Rows (id, vector) -> groups of about ``size``: (name, rows, center, radius, norm).

    A pivot's members are dealt out by hash if they are too many for one group.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = np.einsum("ij,ij->i", pivots, pivots)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).astype(np.float64)
            pivot = (squares - 2 * (x @ pivots.T)).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32))], ["id", "vector", "pivot"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = []
            for rows in batch.column(1):
                x = _unpacked(rows, width)[2].astype(np.float64)
                center = x.mean(axis=0)
                stats.append((center.tolist(), float(_length(x - center).max()), float(np.sqrt(center @ center))))
            columns = [pa.array([s[i] for s in stats], kind) for i, kind in enumerate((pa.list_(pa.float64()), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [name, "rows", "center", "radius", "norm"])

    near = saved(df.mapInArrow(nearest, "id long, vector array<long>, pivot int").withColumn("row", F.monotonically_increasing_id()))
    parts = near.groupBy("pivot").agg(F.ceil(F.count("*") / size).alias("parts"))  # a row for each pivot at most
    dealt = near.join(F.broadcast(parts), "pivot").withColumn(name, F.col("pivot").cast("long") * (1 << 40) + F.pmod(F.xxhash64("row"), "parts"))
    packed = dealt.groupBy(name).agg(F.collect_list(F.struct("row", "id", "vector")).alias("rows"))
    return saved(packed.mapInArrow(measured, f"{name} long, rows array<struct<row long, id long, vector array<long>>>, center array<double>, radius double, norm double"))


def _meetings(asked: DataFrame, shards: DataFrame, width: int, first: int, worst: DataFrame | None, chunk: int = 1024) -> DataFrame:
    """Pairs (block, shard, could): the ``first`` most promising shards of each block, or all that its ``worst`` kth score (block, worst) leaves open.

    Centres and radii meet in chunks, whose bounds are one matrix product; only the pairs that are asked for leave it.
    """

    def chunks(df: DataFrame, name: str, rows: str) -> DataFrame:
        n = max(1, -(-df.count() // chunk))
        stats = df.select(F.struct(F.col(name).alias("name"), "center", "radius", "norm", *(["worst"] if "worst" in df.columns else [])).alias("s"), F.pmod(F.xxhash64(name), F.lit(n)).alias("g"))
        return stats.groupBy("g").agg(F.collect_list("s").alias(rows)).drop("g")

    given, begin = asked.select("block", "center", "radius", "norm"), worst is None

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, x = (batch.column(j)[i].values for j in (0, 1))
                at = lambda v, name: v.field(name).to_numpy(zero_copy_only=False)
                centers = [v.field("center").flatten().to_numpy(zero_copy_only=False).reshape(len(v), width) for v in (q, x)]
                (rq, nq), (rx, nx) = ((at(v, "radius"), at(v, "norm")) for v in (q, x))
                could = centers[0] @ centers[1].T + rq[:, None] * nx + rx * nq[:, None] + rq[:, None] * rx
                could += 1e-9 * (1 + (rq + nq)[:, None] * (rx + nx))
                if begin:
                    best = np.argsort(-could, axis=1, kind="stable")[:, :first]
                    a, b = np.repeat(np.arange(len(could)), best.shape[1]), best.ravel()
                else:
                    a, b = np.nonzero(could >= at(q, "worst")[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(at(q, "name")[a]), pa.array(at(x, "name")[b]), pa.array(could[a, b])], ["block", "shard", "could"])

    left = chunks(given if worst is None else given.join(worst, "block"), "block", "q")
    pairs = left.crossJoin(chunks(shards, "shard", "x")).mapInArrow(bounds, "block long, shard long, could double")  # chunks of centres
    if worst is not None:
        return pairs
    turn = F.row_number().over(W.partitionBy("block").orderBy(F.col("could").desc(), "shard"))
    return pairs.withColumn("turn", turn).filter(F.col("turn") <= first).drop("turn")


def _widened(df: DataFrame, width: int) -> DataFrame:
    return df.select("id", F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vector"))).alias("vector"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, shard: int = SHARD, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """Rows (id, vector array<long>) twice -> (query_id, rank, id, score) of each query's k best."""
    n, width = candidates.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = max(1, width or 1, queries.agg(F.max(F.size("vector"))).first()[0] or 1)
    queries, candidates = _widened(queries, width), _widened(candidates, width)
    sample = candidates.orderBy(F.xxhash64("id", "vector")).limit(min(PIVOTS, max(1, n // shard))).select("vector").collect()  # bounded by PIVOTS
    pivots = np.array([r["vector"] for r in sample], np.float64).reshape(-1, width) if sample else np.zeros((1, width))
    shards = _grouped(candidates, pivots, shard, width, "shard")
    asked = _grouped(queries, pivots, block, width, "block")

    def met(pairs: DataFrame, least: DataFrame | None) -> DataFrame:
        """The k best of each pair of a block and a shard: (row, query_id, id, high, score)."""
        both = asked.select("block", F.col("rows").alias("queries"))
        both = both.withColumn("least", F.lit(None).cast("array<struct<row long, kth double>>")) if least is None else both.join(least, "block", "left")
        both = pairs.join(both, "block").join(shards.select("shard", "rows").hint("merge"), "shard").select("queries", "least", "shard", "rows")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = tree = None
            for batch in batches:
                for a, known, name, b in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                    rows, q_ids, q = _unpacked(a, width)
                    if name != here:  # a merge join brings a shard's blocks one after the other
                        here, (_, ids, x) = name, _unpacked(b, width)
                        tree = cover_tree(x.astype(np.float64))
                    held = {v["row"]: v["kth"] for v in known.as_py() or []}
                    best = Search(k).run(q_ids, q, ids, x, np.array([held.get(r, -np.inf) for r in rows.tolist()]), tree)
                    out = [(r, i, who, max(-_LONG, min(_LONG, int(-s) >> _LOW)), int(-s) & ((1 << _LOW) - 1)) for r, i, f in zip(rows.tolist(), q_ids.tolist(), best.found) for s, who in f]
                    columns = list(zip(*out)) if out else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "query_id", "id", "high", "score"])

        return both.mapInArrow(meet, "row long, query_id long, id long, high long, score long")

    rank = F.row_number().over(W.partitionBy("row").orderBy(F.col("high").desc(), F.col("score").desc(), "id"))
    high = F.col("high")
    whole = F.when(high.between(-2, 1), F.shiftleft(high, _LOW) + F.col("score"))
    final = F.coalesce(whole, F.when(high > 0, F.lit(_LONG)).otherwise(F.lit(-_LONG) - 1))
    value = F.coalesce(whole.cast("double"), high.cast("double") * float(1 << _LOW) + F.col("score"))
    begun = saved(_meetings(asked, shards, width, first, None).select("block", "shard"))
    best = saved(met(begun, None).withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"))
    kth = best.groupBy("row").agg(F.when(F.count("*") == k, F.min(value)).alias("kth"))
    lower = F.coalesce(F.col("kth") - F.abs("kth") * 1e-15, F.lit(float("-inf")))
    members = asked.select("block", F.explode("rows.row").alias("row")).join(kth, "row", "left").select("block", F.struct("row", lower.alias("kth")).alias("m"))
    of_block = saved(members.groupBy("block").agg(F.min("m.kth").alias("worst"), F.collect_list("m").alias("least")))
    left = _meetings(asked, shards, width, first, of_block.select("block", "worst")).join(begun, ["block", "shard"], "left_anti")
    found = best.unionByName(met(left.select("block", "shard"), of_block.select("block", "least")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", final.alias("score"))


def integers(df: DataFrame, key: str, vector: str, scale: float = 1024.0) -> DataFrame:
    """Usable rows as (id, vector array<long>): floor(scale * x) of each component x as double."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).filter(usable(F.col("vector")) & F.col("id").isNotNull())
    return padded(rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long"))), "vector")
