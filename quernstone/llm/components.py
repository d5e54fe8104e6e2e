"""Connected components of an edge table: local contraction, then alternating large and small stars.

Each partition's edges shrink to a spanning forest first.  Rounds of two aggregations and
joins follow, each ending in the shared folder, until few edges are left (the count is
checked); those are finished in one task.  No list of links or members passes through the
driver.  A component ends as a star around its smallest id, so a hub with very many
leaves is a key of a join whose other side has one row for it: adaptive execution splits
that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved

#: Edges up to which one task finishes; ids that a task's forest holds before it is passed on.
FEW, HELD = 1 << 18, 1 << 18


class Roots:
    """Union by the smaller id, with path halving."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the edge joined two groups."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.root[max(a, b)] = min(a, b)
        return True

    def stars(self, names: tuple[str, str]) -> pa.RecordBatch:
        """(member, smallest id) of all members, the smallest ids themselves too."""
        ids = list(self.root)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([self.find(x) for x in ids], pa.int64())], list(names))


def _forests(names: tuple[str, str], held: int):
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = Roots()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                roots.join(a, b)
            if held and len(roots.root) > held:
                yield roots.stars(names)
                roots = Roots()
        yield roots.stars(names)

    return contract


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger id a to the smaller b."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, few: int = FEW, held: int = HELD) -> DataFrame:
    """Edges (a long, b long) -> one row (id, component) for each id that has a link; component is the smallest id.

    Self links and repeated links are allowed; rows with a null end are ignored; no
    edges give no rows.  ``few`` and ``held`` change the route, not the result.
    """
    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    links = saved(links.mapInArrow(_forests(("a", "b"), held), "a long, b long").filter("a <> b"))
    before, now = None, _state(links)
    while now[0] > few and now != before:
        before = now
        links = saved(_small_star(_large_star(links)))
        now = _state(links)
    if now[0] <= few:  # a forest of so few edges is memory for one task
        return links.repartition(1).mapInArrow(_forests(("id", "component"), 0), "id long, component long")
    leaves = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    hubs = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(hubs)
