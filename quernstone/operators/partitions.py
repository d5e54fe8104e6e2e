"""Repairs that rewrite only the partitions that they touch.

A table is a folder of Parquet files in folders ``bucket=N``, the bucket being that of a key.  A repair reads the
buckets of its keys, writes what they become to a folder of its own, and then swaps those buckets in by
a dynamic partition overwrite, which Spark commits as a whole.  All other files stay as they are.  A repair that is
cut off before the swap leaves the table as it was; run again it gives the same table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import insert_new, replace_partition, update_from

BUCKET = "bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Writes a table; a bucket with very many rows is split into several files."""
    df.withColumn(BUCKET, bucket_of(F.col(key), buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)


def read(like: DataFrame, path: str) -> DataFrame:
    """The rows of a table with the columns of ``like``."""
    return _whole(like, path).select(*like.columns)


def _whole(like: DataFrame, path: str) -> DataFrame:
    columns = ", ".join(f"`{c}` {t}" for c, t in like.dtypes)
    return like.sparkSession.read.schema(f"{columns}, {BUCKET} int").parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def repair(fresh: DataFrame, path: str, key: str, buckets: int, change: Callable[[DataFrame, DataFrame], DataFrame], like: DataFrame | None = None) -> list[int]:
    """Puts ``change(rows, fresh)`` in the place of the rows of all buckets that hold a key of ``fresh``; returns those buckets.

    ``change`` sees whole buckets, and must give rows of the same keys back.
    """
    like = fresh if like is None else like
    spark = fresh.sparkSession
    marked = fresh.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    touched = sorted(r[0] for r in marked.select(BUCKET).distinct().collect())  # ``buckets`` at most
    if not touched:
        return []
    rows = _whole(like, path).filter(F.col(BUCKET).isin(touched)).select(*like.columns)
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    out = change(rows, fresh).select(*like.columns).withColumn(BUCKET, bucket_of(F.col(key), buckets))
    out.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(staged)
    now = _whole(like, staged)
    left = {r[0] for r in now.select(BUCKET).distinct().collect()}
    now.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    for gone in set(touched) - left:  # an overwrite leaves partitions alone that it has no rows for
        _delete(spark, f"{path.rstrip('/')}/{BUCKET}={gone}")
    _delete(spark, staged)
    return touched


def replace_chunks(fresh: DataFrame, path: str, buckets: int, key: str = "document_id", kind: str = "fulltext_section") -> list[int]:
    """The fresh documents' chunks of one kind take the place of the old ones."""
    return repair(fresh, path, key, buckets, lambda rows, new: replace_partition(rows, new, key, kind))


def insert(fresh: DataFrame, path: str, buckets: int, key: str, keys: list[str]) -> list[int]:
    """Inserts rows whose ``keys`` (with ``key`` among them) the table doesn't have."""
    return repair(fresh, path, key, buckets, lambda rows, new: rows.unionByName(insert_new(rows, new, keys)))


def update(source: DataFrame, path: str, buckets: int, key: str, columns: list[str], like: DataFrame) -> list[int]:
    """Updates columns of the rows that share a key with ``source``."""
    return repair(source, path, key, buckets, lambda rows, new: update_from(rows, new, [key], columns), like)
