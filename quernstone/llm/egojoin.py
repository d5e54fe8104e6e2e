"""Embedding near-dedup by an epsilon grid order join.

A cosine of c or more means a distance of sqrt(2 - 2c) = eps or less between unit vectors.
Equal vectors collapse to one.  The others are put in the order of their grid cells on the
leading principal dimensions and cut into blocks with bounding boxes; the length of what
those dimensions leave of a vector is one more side of the box.  Boxes are dealt out by
their cells on three dimensions, and only blocks whose boxes are within eps meet.  Such
pairs are joined by halving both sequence intervals until they are provably distant or
small.  Joined blocks give, for each vector, the number of links, and a spanning forest of
the links: never all pairs.  The principal dimensions come from a bounded sample; any
orthonormal basis gives the same links, so the sample affects speed alone.

What can be skipped depends on the data: vectors that spread over few dimensions let most
pairs of blocks go; of vectors in all directions of a space of 64 dimensions, boxes on
eight of them can rule out next to nothing, and neither can any other exact bound.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; shorter vectors count as padded with zeros; a row with a null id takes
no part and is kept with a null component; equal rows link with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Roots, components
from .store import saved

#: Rows that the principal dimensions are fitted on; dimensions of the grid; vectors in a block and in the smallest interval.
FIT_ROWS, DIMS, BLOCK, LEAF = 8192, 8, 4096, 256
#: Dimensions and cells of each by which boxes are dealt out.
BOX_DIMS, BOX_CELLS = 3, 16


def _rows(vectors: pa.Array, kind: str) -> list[np.ndarray | None]:
    """Of each vector its components without the zeros at its end; None if it can't link."""
    out: list[np.ndarray | None] = []
    for value in vectors:
        if not value.is_valid:
            out.append(None)
            continue
        x = value.values.to_numpy(zero_copy_only=False).astype(kind)  # nulls come as nan
        last = np.flatnonzero(x)
        out.append(x[: last[-1] + 1] if len(last) and np.isfinite(x).all() else None)
    return out


def stacked(rows: list[np.ndarray], width: int | None = None) -> np.ndarray:
    """Vectors as rows of one matrix, filled with zeros."""
    out = np.zeros((len(rows), max([width or 1, *map(len, rows)])), rows[0].dtype if rows else float)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny) if x.size else 1.0
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), np.finfo(float).tiny)[:, None]


def _principal(sample: list[bytes], kind: str, dims: int) -> np.ndarray:
    """Leading principal directions (columns) of the sample."""
    if not sample:
        return np.zeros((1, 1))
    x = units(stacked([np.frombuffer(b, kind) for b in sample]))
    _, _, basis = np.linalg.svd(x - x.mean(axis=0), full_matrices=False) if len(x) > 1 else (0, 0, np.eye(x.shape[1]))
    return basis[: min(dims, len(basis))].T


def placed(unit: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates on the basis, and the length of what it leaves: their distance is never above the vectors'."""
    n = min(unit.shape[1], len(basis))
    grid = unit[:, :n] @ basis[:n]
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", grid, grid)))
    return np.column_stack((grid, rest))


class _Side:
    """One block's rows of a pair."""

    def __init__(self, ids: bytes, weights: bytes, vectors: bytes, kind: str, basis: np.ndarray):
        self.ids = np.frombuffer(ids, np.int64)
        self.weights = np.frombuffer(weights, np.int64)
        self.unit = units(np.frombuffer(vectors, kind).reshape(len(self.ids), -1))
        self.grid = placed(self.unit, basis)

    def widen(self, width: int) -> None:
        self.unit = np.pad(self.unit, ((0, 0), (0, width - self.unit.shape[1])))
        self.low = self.unit.astype(np.float32)


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """A lower bound of the distance between any two points of two intervals."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float(np.sqrt(gap @ gap))


def _forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a boolean matrix of links: edges that connect what it connects, at most one for each row and column."""
    rows, cols = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
    m = link[np.ix_(rows, cols)]
    label = np.arange(len(rows))
    while True:  # the smallest row that each row reaches
        of_col = np.where(m, label[:, None], len(rows)).min(axis=0)
        now = np.where(m, of_col, len(rows)).min(axis=1)
        now = np.minimum(now, label[now])
        if (now == label).all():
            return np.concatenate((rows, -1 - cols)), np.concatenate((rows[label], rows[of_col]))
        label = now


def _join(a: _Side, b: _Side, same: bool, least: float, eps: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, list]:
    """Links of each row of both sides (weighted), and the edges of a spanning forest."""
    count_a, count_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    roots, kept = Roots(), []
    stack = [(0, len(a.ids), 0, len(b.ids))]
    while stack:
        i, j, k, m = stack.pop()
        if same and k < i or _apart(a.grid[i:j], b.grid[k:m]) > eps:
            continue
        if max(j - i, m - k) > leaf:
            ij, km = (i + j) // 2, (k + m) // 2
            stack += [(p, q, r, s) for p, q in ((i, ij), (ij, j)) for r, s in ((k, km), (km, m)) if p < q and r < s]
            continue
        dots = a.low[i:j] @ b.low[k:m].T
        link = dots >= least
        near = np.abs(dots - least) < 1e-4  # single precision can't tell
        if near.any():
            p, q = np.nonzero(near)
            link[p, q] = np.einsum("ij,ij->i", a.unit[i + p], b.unit[k + q]) >= least
        if same and i == k:
            np.fill_diagonal(link, False)
        if not link.any():
            continue
        count_a[i:j] += link @ b.weights[k:m]
        if not (same and i == k):
            count_b[k:m] += link.T @ a.weights[i:j]
        for x, y in zip(*_forest(link)):
            edge = int(a.ids[i + x]) if x >= 0 else int(b.ids[k - 1 - x]), int(a.ids[i + y])
            if roots.join(*edge):
                kept.append(edge)
    return count_a, count_b, kept


def _box_pairs(box: DataFrame, dims: int, eps: float) -> DataFrame:
    """Boxes (block, low, high) -> pairs (a <= b) of blocks whose boxes are within eps of each other, each once."""
    ends = [c for d in range(min(BOX_DIMS, dims)) for c in (F.min(F.col("low")[d]), F.max(F.col("high")[d]))]
    row = box.agg(*ends, F.count("*")).first()
    dims = min(dims, next(d for d in range(1, BOX_DIMS + 1) if d == BOX_DIMS or row[-1] < BOX_CELLS ** (d + 1)))  # few blocks are wide in all but the first
    sides = [max(eps, ((row[2 * d + 1] or 0.0) - (row[2 * d] or 0.0)) / BOX_CELLS) for d in range(dims)]

    def dealt(name: str, slack: float) -> DataFrame:
        out = box.select(F.col("block").alias(name), F.col("low").alias(f"low_{name}"), F.col("high").alias(f"high_{name}"))
        for d, side in enumerate(sides):
            cell = lambda x: F.floor(x / side)  # noqa: E731, B023
            out = out.withColumn(f"c{d}", F.explode(F.sequence(cell(F.col(f"low_{name}")[d] - slack), cell(F.col(f"high_{name}")[d] + slack))))
        return out

    gaps = F.transform(F.arrays_zip("low_a", "high_a", "low_b", "high_b"), lambda z: F.greatest(F.lit(0.0), z["low_a"] - z["high_b"], z["low_b"] - z["high_a"]))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    met = dealt("a", 0.0).join(dealt("b", eps), [f"c{d}" for d in range(dims)])
    return met.filter((F.col("a") <= F.col("b")) & (apart <= eps * eps)).select("a", "b").distinct()


def _classes(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame, str]:
    """All rows (id, h1, h2), distinct vectors (cls, h1, h2, rep, n, vector binary), and the vectors' numpy kind."""
    element = rows.select(vector).schema[0].dataType.elementType.typeName()
    kind = "<f4" if element == "float" else "<f8"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _rows(batch.column(1), kind)
            data = [x.tobytes() if x is not None and i is not None else None for i, x in zip(batch.column(0).to_pylist(), found)]
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(d or b"") for d in data), np.int64).reshape(-1, 2)
            none = np.array([d is None for d in data], bool)
            columns = [batch.column(0), pa.array(data, pa.binary()), pa.array(digest[:, 0], mask=none), pa.array(digest[:, 1], mask=none)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "h1", "h2"])

    given = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("vector"))
    all_ = saved(given.mapInArrow(read, "id long, vector binary, h1 long, h2 long"))
    distinct = all_.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    return all_.drop("vector"), saved(distinct.withColumn("cls", F.monotonically_increasing_id())), kind


def _blocks(distinct: DataFrame, kind: str, basis: np.ndarray, eps: float, size: int) -> DataFrame:
    """Distinct vectors in grid order, as rows of up to ``size`` of them with the bounding box."""
    dims = basis.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = placed(units(stacked([np.frombuffer(b, kind) for b in batch.column(2).to_pylist()])), basis) if batch.num_rows else np.zeros((0, dims + 1))
            cells = np.floor(grid[:, :dims] / (eps / 2)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int64()))], ["cls", "n", "vector", "cells"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[tuple]) -> pa.RecordBatch:
            ids, n, data = zip(*held)
            x = stacked([np.frombuffer(b, kind) for b in data])
            grid = placed(units(x), basis)
            packed = [np.array(v, np.int64).tobytes() for v in (ids, n)] + [x.tobytes()]
            box = [pa.array([g.tolist()], pa.list_(pa.float64())) for g in (grid.min(axis=0), grid.max(axis=0))]
            return pa.RecordBatch.from_arrays([pa.array([ids[0]], pa.int64()), *(pa.array([p], pa.binary()) for p in packed), *box], ["block", "ids", "weights", "vectors", "low", "high"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append(row)
                if len(held) == size:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    order = [F.col("cells")[i] for i in range(dims)]
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(parts, -(-distinct.count() // size)))
    cells = distinct.select("cls", "n", "vector").mapInArrow(place, "cls long, n long, vector binary, cells array<long>")
    ordered = cells.repartitionByRange(parts, *order, "cls").sortWithinPartitions(*order, "cls")
    return saved(ordered.mapInArrow(cut, "block long, ids binary, weights binary, vectors binary, low array<double>, high array<double>"))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, block: int = BLOCK) -> DataFrame:
    """One row for each vector: its id, n_links, component_id and kept."""
    if not -1.0 < least <= 1.0:
        raise ValueError("the least cosine is above -1 and at most 1")
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    all_, distinct, kind = _classes(rows, key, vector)
    basis = _principal([bytes(r["vector"]) for r in distinct.orderBy("h1", "h2").limit(FIT_ROWS).select("vector").collect()], kind, DIMS)
    blocks = _blocks(distinct, kind, basis, eps, block)
    pairs = _box_pairs(blocks.select("block", "low", "high"), basis.shape[1], eps)
    named = lambda k: blocks.select(F.col("block").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("ids", "weights", "vectors")])
    pairs = pairs.join(named("a"), "a").join(named("b"), "b")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(i)[r].as_py() for i, name in enumerate(batch.schema.names)}
                a, b = (_Side(*(row[f"{c}_{k}"] for c in ("ids", "weights", "vectors")), kind, basis) for k in "ab")
                for side in (a, b):
                    side.widen(max(a.unit.shape[1], b.unit.shape[1]))
                count_a, count_b, edges = _join(a, b, row["a"] == row["b"], least, eps)
                ids = np.concatenate((a.ids[count_a > 0], b.ids[count_b > 0]))
                n = np.concatenate((count_a[count_a > 0], count_b[count_b > 0]))
                x, y = (np.array(c, np.int64) for c in (zip(*edges) if edges else ((), ())))
                full = lambda v, k, m: pa.array(np.concatenate((v, np.zeros(m, np.int64))) if k else np.concatenate((np.zeros(m, np.int64), v)))
                yield pa.RecordBatch.from_arrays(
                    [full(ids, 1, len(x)), full(n, 1, len(x)), full(x, 0, len(ids)), full(y, 0, len(ids))], ["cls", "n", "a", "b"]
                )

    met = saved(pairs.mapInArrow(meet, "cls long, n long, a long, b long"))
    links = met.filter("n > 0").groupBy("cls").agg(F.sum("n").alias("links"))
    linked = components(met.filter("a <> b").select("a", "b")).select(F.col("id").alias("cls"), "component")
    held = distinct.select("cls", "h1", "h2", "rep", F.col("n").alias("copies")).join(links, "cls", "left").join(linked, "cls", "left")
    held = saved(held.withColumn("component", F.coalesce("component", "cls")))
    least_id = held.groupBy("component").agg(F.min("rep").alias("component_id"))
    held = held.join(least_id, "component").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = all_.join(held, ["h1", "h2"], "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
