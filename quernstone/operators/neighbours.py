"""Nearest neighbours by straight distance, and estimators that stand on them or on random Fourier features.

Rows are dealt into cells around pivots (a bounded sample of rows), and a cell into rings by distance to its pivot.
By the triangle inequality a ring's least and widest distance bound how near a row of it can be to a query.  A query first meets its most
promising rings until they hold k rows; then only those rings that can still hold a nearer row than its kth one.  The
answer is that of comparing everything, whatever the pivots are.  Rings of many rows are split by a hash, queries of a ring
go in blocks, and pairs of blocks are compared with matrix products, so no task holds a cell or all queries of one.

Ids are unique.  Rows and queries whose vector is null, holds null or non-finite numbers, or has another length than most of the rows take no part.
Equal distances go by the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..session import saved

#: Rows of a block and queries of a block.
ROWS, QUERIES = 4096, 512
#: Cells and rings of a cell at most; what is known of all rings goes to every task.
CELLS, RINGS = 4096, 64
#: Bounds of queries and rings that a task makes at once.
BOUNDS = 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def _clean(df: DataFrame, key: str, vector: str, wide: int | None = None) -> DataFrame:
    out = df.select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).filter(usable(F.col("v")))
    return out if wide is None else out.filter(F.size("v") == wide)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances by a matrix product; good to about 1e-7 of the vectors' lengths."""
    squares = np.einsum("ij,ij->i", rows, rows)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _home(pivots: np.ndarray, v: Column) -> Column:
    """The nearest pivot and the distance to it, taken by differences."""

    @F.pandas_udf(StructType([StructField("cell", IntegerType()), StructField("gap", DoubleType())]))
    def near(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()).astype(float)
        cell = _distances(x, pivots).argmin(1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "gap": np.linalg.norm(x - pivots[cell], axis=1)})

    return near(v)


def _rings(rows: DataFrame) -> DataFrame:
    """``rows`` (id, v, cell, gap) with ring and part; rings hold about ROWS rows, of which parts are dealt by a hash where that is too few rings."""
    shares = [i / RINGS for i in range(1, RINGS)]
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("gap", F.array(*map(F.lit, shares)), 1000).alias("cuts"))
    every = F.greatest(F.lit(1), F.floor(F.lit(RINGS) / F.greatest(F.lit(1.0), F.col("n") / ROWS)))
    cells = cells.select("cell", F.when(F.col("n") <= ROWS, F.array().cast("array<double>")).otherwise(F.filter("cuts", lambda c, i: (i + 1) % every == 0)).alias("cuts"))
    rows = rows.join(cells, "cell").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("gap")))).drop("cuts")
    sizes = rows.groupBy("cell", "ring").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts"))
    return rows.join(sizes, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(11)), F.col("parts")).cast("int"))


def _wanted(pivots: np.ndarray, rings: pd.DataFrame, k: int, v: Column, limit: Column | None) -> Column:
    """The rings that a query meets: those of promise until they hold k rows (no limit), or all others within the limit."""
    kind = ArrayType(IntegerType())
    cell, low, high, n = (rings[c].to_numpy() for c in ("cell", "low", "high", "n"))
    step = max(1, BOUNDS // len(cell))

    def bounds(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The least and the widest distance to each ring, query by query; made for as many queries at once as memory is meant for."""
        for at in range(0, len(vectors), step):
            x = np.stack(vectors.iloc[at : at + step].to_numpy()).astype(float)
            slack = 1e-6 * (1 + np.linalg.norm(x, axis=1)[:, None] + high[None])
            gap = _distances(x, pivots)[:, cell]
            yield from zip(np.maximum(np.maximum(gap - high, low - gap), 0) - slack, gap + high)

    def first(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        order = np.lexsort((most, np.maximum(least, 0)))
        return order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]

    @F.pandas_udf(kind)
    def opening(vectors: pd.Series) -> pd.Series:
        return pd.Series([first(a, b).astype(np.int32).tolist() for a, b in bounds(vectors)], dtype=object)

    @F.pandas_udf(kind)
    def rest(vectors: pd.Series, limits: pd.Series) -> pd.Series:
        out = []
        for (a, b), far in zip(bounds(vectors), limits.fillna(np.inf)):
            keep = a <= far
            keep[first(a, b)] = False
            out.append(np.flatnonzero(keep).astype(np.int32).tolist())
        return pd.Series(out, dtype=object)

    return opening(v) if limit is None else rest(v, limit)


def _compared(queries: DataFrame, blocks: DataFrame, k: int, others: bool, kind: str) -> DataFrame:
    """Queries (id, v, unit) against the blocks (unit, part, rows) of their unit: the k nearest of each block (query_id, id, distance)."""
    sizes = queries.groupBy("unit").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("split"))
    packed = queries.join(sizes, "unit").withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("split")))
    packed = packed.groupBy("unit", "block").agg(F.collect_list(F.struct("id", "v")).alias("queries"))  # about QUERIES

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one pair at a time, its numbers read where Arrow holds them
                (names, q), (ids, x) = (block(batch.column(c)[at].values) for c in ("queries", "rows"))
                about, out = _distances(q, x), []
                length = np.linalg.norm(x, axis=1).max()
                for name, vector, near in zip(names, q, about):
                    reach = k + (1 if others else 0)
                    edge = np.partition(near, reach - 1)[reach - 1] if len(near) > reach else np.inf
                    some = np.flatnonzero(near <= edge + 1e-6 * (1 + length + np.linalg.norm(vector)))
                    if others:
                        some = some[ids[some] != name]
                    exact = np.linalg.norm(x[some] - vector, axis=1)
                    best = sorted(zip(exact.tolist(), ids[some].tolist()))[:k]
                    out += [(name, i, d) for d, i in best]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], of), pa.array(columns[1], of), pa.array(columns[2], pa.float64())], ["query_id", "id", "distance"])

    def block(values: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the matrix of a block."""
        vectors = values.field("v")
        return np.array(values.field("id").to_pylist(), dtype=object), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)

    of = to_arrow_type(queries.schema["id"].dataType)
    pairs = packed.join(blocks, "unit").select("queries", "rows")
    return pairs.mapInArrow(compare, f"query_id {kind}, id {kind}, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str = "id", vector: str = "vector", others: bool = False, cells: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of each query (all, if fewer), exactly; ``others``: without the query's own id."""
    kind = dict(rows.dtypes)[key]
    clean = _clean(rows, key, vector)
    wide, count = clean.agg(F.mode(F.size("v"), deterministic=True), F.count("*")).first()
    empty = f"query_id {kind}, rank int, id {kind}, distance double"
    if not count:
        return rows.sparkSession.createDataFrame([], empty)
    clean, asked = clean.filter(F.size("v") == wide), _clean(queries, key, vector, wide)
    cells = min(CELLS, cells or max(1, math.isqrt(count // 16)))
    pivots = np.array([r["v"] for r in clean.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(cells).collect()], float)  # at most CELLS rows
    home = _home(pivots, F.col("v"))
    dealt = saved(_rings(clean.withColumn("home", home).select("id", "v", "home.*")))
    rings = dealt.groupBy("cell", "ring").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count("*").alias("n")).orderBy("cell", "ring").toPandas()  # at most CELLS * RINGS
    number = rows.sparkSession.createDataFrame([(int(c), int(r), i) for i, (c, r) in enumerate(zip(rings["cell"], rings["ring"]))], "cell int, ring int, unit int")
    blocks = dealt.join(number, ["cell", "ring"]).groupBy("unit", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows"))  # about ROWS
    blocks, reach = saved(blocks), k + (1 if others else 0)
    opening = asked.withColumn("unit", F.explode(_wanted(pivots, rings, reach, F.col("v"), None)))
    found = saved(_best(_compared(opening, blocks, k, others, kind), k))
    limit = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("limit"))
    later = asked.join(limit, "id", "left").withColumn("unit", F.explode(_wanted(pivots, rings, reach, F.col("v"), F.col("limit")))).drop("limit")
    both = found.drop("rank").unionByName(_compared(later, blocks, k, others, kind))
    return _best(both, k).select("query_id", "rank", "id", "distance")


def votes(found: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(query_id, label, votes, n): the label that most neighbours have, the smaller one of equals; neighbours without a label don't vote."""
    by = found.join(labels.select(F.col(key).alias("id"), F.col(label).alias("label")).dropna(), "id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    best = F.min_by(F.struct("label", "votes"), F.struct(-F.col("votes"), F.col("label")))
    return by.groupBy("query_id").agg(best.alias("b"), F.sum("votes").alias("n")).select("query_id", "b.label", "b.votes", "n")


class _Columns(Params):
    """Names of the columns of features and label."""

    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)


class Neighbours(Estimator, _Columns):
    """Predicts the mean of the k nearest rows' labels; for classes 0 and 1 that is the share of ones, given as a probability too.

    ``weights``: uniform, or distance (the inverse of the distance; rows at no distance count alone).
    """

    n_neighbors = Param(Params._dummy(), "n_neighbors", "neighbours asked", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "whether labels are classes", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", n_neighbors: int = 5, weights: str = "uniform", classes: bool = False):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(featuresCol="features", labelCol="label", n_neighbors=5, weights="uniform", classes=False)

    def _fit(self, df: DataFrame) -> "NeighboursModel":
        rows = df.select(vector_to_array(self.getOrDefault("featuresCol")).alias("vector"), F.col(self.getOrDefault("labelCol")).cast("double").alias("y")).dropna()
        rows = saved(rows.withColumn("id", F.monotonically_increasing_id()))
        return NeighboursModel(rows, self.getOrDefault("featuresCol"), self.getOrDefault("n_neighbors"), self.getOrDefault("weights"), self.getOrDefault("classes"))


class NeighboursModel(Model):
    """The rows of a fit; a query without neighbours has no prediction."""

    def __init__(self, rows: DataFrame, features: str, k: int, weights: str, classes: bool):
        super().__init__()
        self.rows, self.features, self.k, self.weights, self.classes = rows, features, k, weights, classes

    def _transform(self, df: DataFrame) -> DataFrame:
        asked = saved(df.withColumn("_query", F.monotonically_increasing_id()))
        queries = asked.select(F.col("_query").alias("id"), vector_to_array(self.features).alias("vector"))
        found = nearest(queries, self.rows, self.k).join(self.rows.select("id", "y"), "id")
        mean = F.avg("y")
        if self.weights == "distance":
            far = F.col("distance")
            mean = F.coalesce(F.avg(F.when(far == 0, F.col("y"))), F.sum(F.when(far > 0, F.col("y") / far)) / F.sum(F.when(far > 0, 1 / far)))
        mean = saved(found.groupBy(F.col("query_id").alias("_query")).agg(mean.alias("_mean")))  # metrics read it several times
        out = asked.join(mean, "_query", "left").drop("_query")
        if not self.classes:
            return out.withColumnRenamed("_mean", "prediction")
        out = out.withColumn("probability", array_to_vector(F.array(1 - F.col("_mean"), F.col("_mean"))))
        return out.withColumn("prediction", (F.col("_mean") >= 0.5).cast("double")).drop("_mean")


class FourierFeatures(Estimator, _Columns):
    """Random features whose products come near the kernel exp(-gamma * squared distance); gamma is 1 / (features * variance) unless given."""

    outputCol = Param(Params._dummy(), "outputCol", "output", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "number of random features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width; zero: from the data", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", outputCol: str = "fourier", width: int = 256, gamma: float = 0.0, seed: int = 42):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(featuresCol="features", outputCol="fourier", width=256, gamma=0.0, seed=42)

    def _fit(self, df: DataFrame) -> "FourierModel":
        v = vector_to_array(self.getOrDefault("featuresCol"))
        x = df.select(v.alias("v")).filter("v is not null").select(F.size("v").alias("wide"), F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("s"), F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b).alias("ss"))
        wide, n, s, ss = x.agg(F.max("wide"), F.sum("wide"), F.sum("s"), F.sum("ss")).first()
        if not wide:
            raise ValueError("no features to fit on")
        variance = max(ss / n - (s / n) ** 2, 0.0)
        gamma = self.getOrDefault("gamma") or 1 / (wide * variance if variance > 0 else 1.0)
        rng = np.random.default_rng(self.getOrDefault("seed"))
        waves = rng.normal(0, math.sqrt(2 * gamma), (wide, self.getOrDefault("width")))
        return FourierModel(waves, rng.uniform(0, 2 * math.pi, waves.shape[1]), self.getOrDefault("featuresCol"), self.getOrDefault("outputCol"))


class FourierModel(Model, Transformer):
    """Drawn waves and phases."""

    def __init__(self, waves: np.ndarray, phases: np.ndarray, features: str, output: str):
        super().__init__()
        self.waves, self.phases, self.features, self.output = waves, phases, features, output

    def _transform(self, df: DataFrame) -> DataFrame:
        waves, phases = self.waves, self.phases

        @F.pandas_udf(ArrayType(DoubleType()))
        def wave(vectors: pd.Series) -> pd.Series:
            x = np.stack(vectors.to_numpy()).astype(float)
            return pd.Series(list(math.sqrt(2 / waves.shape[1]) * np.cos(x @ waves + phases)), dtype=object)

        return df.withColumn(self.output, array_to_vector(wave(vector_to_array(self.features))))
