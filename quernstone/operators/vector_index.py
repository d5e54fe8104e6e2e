"""An inverted-file index of vectors, searched by cosine.

Vectors are dealt into cells around centres that are fitted on a bounded sample; the table is
written with a folder for each cell, beside a small table of cells with their centre, the widest
angle of a member to it, and their number.  A search reads the cells that lie nearest to the query,
so Spark prunes all other folders before the scan.

``probes`` cells give an approximate answer.  Without ``probes`` the answer is that of a scan: after the
nearest cells, those are read whose widest angle still allows a cosine as high as the kth one found.  The bound
holds for any centres, so the sample affects speed alone.

Vectors without a direction (null, zero, not finite, of another length than the first centre) are kept in cell -1 and
come last, without a similarity.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .search import with_similarity

#: Rows sampled for each centre; centres at most (their matrix goes to every task).
PER_CELL, MOST_CELLS = 64, 16_384

#: Angles are doubles near arccos 1, where they are coarse.
SLACK = 1e-6


def directed(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def fit_centres(df: DataFrame, vector: str, cells: int, sample: int, seed: int = 7) -> np.ndarray:
    """Unit centres of spherical k-means on at most about ``sample`` vectors."""
    rows = df.filter(directed(F.col(vector))).select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    some = rows.sample(min(1.0, sample / n), seed) if n > sample else rows
    wide = some.agg(F.mode(F.size("v"), deterministic=True)).first()[0]
    if wide is None:
        some, wide = rows.limit(1), rows.first()["v"].__len__()
    model = KMeans(k=max(2, cells), seed=seed, distanceMeasure="cosine", maxIter=10).fit(some.filter(F.size("v") == wide).select(array_to_vector("v").alias("features")))
    return _unit(np.array([c for c in model.clusterCenters() if np.linalg.norm(c) > 0], float))


def _cell_of(centres: np.ndarray, vector: Column, nearest: int = 1) -> Column:
    """array<struct<cell, angle>> of the ``nearest`` cells of a vector, nearest first; null for one without a direction."""

    @F.pandas_udf("array<struct<cell:int,angle:double>>")
    def near(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        at = [i for i, v in enumerate(vectors) if v is not None and len(v) == centres.shape[1]]
        if at and len(centres):
            cos = np.clip(_unit(np.stack([np.asarray(vectors.iloc[i], float) for i in at])) @ centres.T, -1, 1)
            best = np.argsort(-cos, axis=1, kind="stable")[:, :nearest]
            for i, cells, row in zip(at, best, cos):
                out[i] = [{"cell": int(c), "angle": float(math.acos(row[c]))} for c in cells]
        return pd.Series(out, dtype=object)

    return near(F.when(directed(vector), F.transform(vector, lambda x: x.cast("double"))))


@dataclass
class VectorIndex:
    """The index written under ``path``; ``cells``: (cell, centre, radius, n) of each cell with a direction."""

    path: str
    key: str
    vector: str
    cells: pd.DataFrame
    without: int

    def rows(self, spark: SparkSession, cells: list[int] | None = None) -> DataFrame:
        """The rows of some cells; the filter is on the folders."""
        df = spark.read.schema(spark.read.parquet(f"{self.path}/columns").schema).parquet(f"{self.path}/vectors")
        return df if cells is None else df.filter(F.col("cell").isin([int(c) for c in cells]))

    def angles(self, query: list[float]) -> np.ndarray:
        q = np.asarray(query, float)
        return np.arccos(np.clip(self.centres() @ (q / np.linalg.norm(q)), -1, 1)) if len(self.cells) else np.zeros(0)

    def centres(self) -> np.ndarray:
        return np.array(self.cells["centre"].tolist(), float) if len(self.cells) else np.zeros((0, 0))

    def _best(self, rows: DataFrame, query: list[float], k: int) -> DataFrame:
        scored = with_similarity(rows, query, self.vector).withColumn("similarity", F.when(F.col("cell") >= 0, F.col("similarity")))
        return scored.orderBy(F.col("similarity").desc_nulls_last(), self.key).limit(k)

    def nearest(self, spark: SparkSession, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """The k rows with the largest cosine, ties to the smaller key, with all their columns and their similarity.

        The table of cells is on the driver (a row for each cell), so the cells to read are literals of the filter.
        """
        angle, cells, sizes = self.angles(query), self.cells["cell"].to_numpy(), self.cells["n"].to_numpy()
        order = np.argsort(angle, kind="stable")
        if probes is not None:
            return self._best(self.rows(spark, cells[order[:probes]].tolist()), query, k).drop("cell", "angle")
        enough = int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1  # the nearest cells that hold k rows
        first = order[:enough]
        if enough > len(order):  # there are not k vectors with a direction
            return self._best(self.rows(spark), query, k).drop("cell", "angle")
        kth = self._best(self.rows(spark, cells[first].tolist()), query, k).agg(F.min("similarity")).first()[0]
        reach = np.cos(np.maximum(0.0, angle - self.cells["radius"].to_numpy() - SLACK))
        open_ = np.flatnonzero(reach >= kth - SLACK)
        return self._best(self.rows(spark, cells[np.union1d(first, open_)].tolist()), query, k).drop("cell", "angle")

    def nearest_of_many(self, queries: DataFrame, query_key: str, query_vector: str, k: int, probes: int | None = None) -> DataFrame:
        """(query key, rank, key, similarity) of each query with a direction: a join of queries and rows by cell, in two passes if exact."""
        spark, query_id = queries.sparkSession, "_q"
        centres = self.centres()
        numbers, radii = self.cells["cell"].tolist(), self.cells["radius"].to_numpy()
        asked = queries.filter(directed(F.col(query_vector))).select(F.col(query_key).alias(query_id), F.transform(query_vector, lambda x: x.cast("double")).alias("_v"))
        near = asked.withColumn("_near", _cell_of(centres, F.col("_v"), probes or max(1, min(len(centres), 2))))
        number = F.array(*[F.lit(int(c)) for c in numbers])
        begun = near.select(query_id, "_v", F.explode("_near").alias("_c")).select(query_id, "_v", F.element_at(number, F.col("_c.cell") + 1).alias("cell"))
        table = self.rows(spark).select(F.col(self.key).alias("_key"), F.transform(self.vector, lambda x: x.cast("double")).alias("_x"), "cell").filter("cell >= 0")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        cosine = dot("_v", "_x") / (F.sqrt(dot("_v", "_v")) * F.sqrt(dot("_x", "_x")))
        rank = F.row_number().over(W.partitionBy(query_id).orderBy(F.col("similarity").desc(), "_key"))
        best = lambda df: df.withColumn("rank", rank).filter(F.col("rank") <= k)
        met = lambda pairs: best(pairs.join(table, "cell").select(query_id, "_key", cosine.alias("similarity")))
        found = met(begun)
        if probes is None:
            kth = found.groupBy(query_id).agg(F.when(F.count("*") == k, F.min("similarity")).alias("_kth"))

            @F.pandas_udf("array<int>")
            def still(vectors: pd.Series, least: pd.Series) -> pd.Series:
                angle = np.arccos(np.clip(_unit(np.stack([np.asarray(v, float) for v in vectors])) @ centres.T, -1, 1)) if len(vectors) else np.zeros((0, 1))
                reach = np.cos(np.maximum(0.0, angle - radii - SLACK))
                return pd.Series([np.flatnonzero(r >= (-2.0 if pd.isna(s) else s) - SLACK).tolist() for r, s in zip(reach, least)], dtype=object)

            rest = asked.join(kth, query_id, "left").select(query_id, "_v", F.explode(still("_v", "_kth")).alias("_c"))
            rest = rest.select(query_id, "_v", F.element_at(number, F.col("_c") + 1).alias("cell")).join(begun.select(query_id, "cell"), [query_id, "cell"], "left_anti")
            found = best(found.drop("rank").unionByName(met(rest).drop("rank")))
        return found.select(F.col(query_id).alias(query_key), "rank", F.col("_key").alias(self.key), "similarity")


def build(df: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int | None = None) -> VectorIndex:
    """Writes the index of ``df`` under ``path``; as many cells as the square root of the rows, if not said."""
    cells = cells or min(MOST_CELLS, max(2, math.isqrt(max(1, df.count()))))
    centres = fit_centres(df, vector, cells, sample or PER_CELL * cells)
    near = F.get(_cell_of(centres, F.col(vector)), F.lit(0))
    placed = df.withColumn("_at", near).withColumns({"cell": F.coalesce("_at.cell", F.lit(-1)), "angle": F.col("_at.angle")}).drop("_at")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")  # large cells are split into several files
    placed.limit(0).coalesce(1).write.parquet(f"{path}/columns")
    about = VectorIndex(path, key, vector, pd.DataFrame(), 0).rows(df.sparkSession)
    about = about.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).toPandas()  # a row for each cell
    known = about[about["cell"] >= 0].sort_values("cell", ignore_index=True)
    known["centre"] = [centres[c].tolist() for c in known["cell"]]
    stored = df.sparkSession.createDataFrame([(int(r.cell), r.centre, float(r.radius), int(r.n)) for r in known.itertuples()], "cell int, centre array<double>, radius double, n long")
    stored.coalesce(1).write.parquet(f"{path}/cells")
    return VectorIndex(path, key, vector, known, int(about.loc[about["cell"] < 0, "n"].sum()))


def load(spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """An index that ``build`` has written."""
    known = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()  # a row for each cell
    index = VectorIndex(path, key, vector, known, 0)
    index.without = index.rows(spark, [-1]).count()
    return index


def recall(index: VectorIndex, queries: DataFrame, query_key: str, query_vector: str, k: int, probes: int) -> float:
    """The share of the exact answers that ``probes`` cells give."""
    some, all_ = (index.nearest_of_many(queries, query_key, query_vector, k, p).select(query_key, F.col(index.key).alias("_found")) for p in (probes, None))
    hit = all_.join(some, [query_key, "_found"], "left_semi").count()
    return hit / max(1, all_.count())
