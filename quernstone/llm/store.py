"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that are Python objects at a time.
ROWS = 256

Rows = TypeVar("Rows", pa.Array, pa.RecordBatch)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of its own only where none is set and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quernstone-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """``df``, computed once and read from the shared folder from now on; lost executors cost no work."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``saved``, as a Parquet table: smaller, and later steps read only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """The name, or one made of it that no column has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batches: Iterable[Rows], rows: int = ROWS) -> Iterator[Rows]:
    """The rows of Arrow batches, few at a time: a whole batch as Python objects takes a multiple of its bytes, which a reused worker keeps."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
