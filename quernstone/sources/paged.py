"""Services that answer page by page, as a Spark data source.

``register`` makes a format of a fetch function: each key (a query, a place, a first page) is a partition, and a task
follows the key's pages by the cursor that each answer gives for the next.  Nothing is fetched on the driver, and
a lost executor's keys are fetched again by another task, so a fetch must be safe to repeat.

Rows are (key, page, payload, error).  A page that fails is tried again, ``tries`` times in all; then it is a row with the error and
without a payload, and the key ends there, as there is no cursor to go on from.  Other keys go on.
A source is read again by every action on it: land it (``landed``) before it is parsed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: An answer: the payload and the cursor of the next page (None: it was the last).
Fetch = Callable[[str, str | None], tuple[str | None, str | None]]
SCHEMA = "key string, page int, payload string, error string"


class Key(InputPartition):
    def __init__(self, value: str):
        self.value = value


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Fetch, keys: list[str], most: int, tries: int, wait: float):
        self.fetch, self.keys, self.most, self.tries, self.wait = fetch, keys, most, tries, wait

    def partitions(self) -> list[InputPartition]:
        return [Key(k) for k in self.keys] or [Key("")]

    def _answer(self, key: str, cursor: str | None) -> tuple[str | None, str | None, str | None]:
        error = None
        for n in range(self.tries):
            try:
                return (*self.fetch(key, cursor), None)
            except Exception as e:  # whatever a service's client raises becomes a row
                error = f"{type(e).__name__}: {e}"
                time.sleep(self.wait * 2**n if n + 1 < self.tries else 0)
        return None, None, error

    def read(self, partition: Key) -> Iterator[tuple]:
        cursor, seen = None, set()
        for page in range(self.most if self.keys else 0):
            payload, after, error = self._answer(partition.value, cursor)
            yield partition.value, page, payload, error
            if error or after is None:
                return
            if after in seen:
                yield partition.value, page + 1, None, f"cursor {after} came twice"
                return
            seen.add(after)
            cursor = after
        if self.keys:
            yield partition.value, self.most, None, f"more than {self.most} pages"


def register(spark: SparkSession, name: str, fetch: Fetch) -> None:
    """Makes ``spark.read.format(name)``; options: keys (one a line), most (pages a key), tries, wait (seconds, doubled each time)."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> DataSourceReader:
            given = self.options
            keys = [k for k in given.get("keys", "").split("\n") if k.strip()]
            return PagedReader(fetch, list(dict.fromkeys(keys)), int(given.get("most", 1000)), max(1, int(given.get("tries", 3))), float(given.get("wait", 0.5)))

    spark.dataSource.register(Paged)


def landed(spark: SparkSession, name: str, keys: list[str], path: str, **options: str | int | float) -> DataFrame:
    """The pages of some keys, fetched once and written under ``path``; a key without a failure there is not fetched again."""
    try:
        state = latest(spark.read.schema(SCHEMA + ", run long").parquet(path)).groupBy("key").agg(F.bool_or(F.col("error").isNotNull()).alias("failed"))
        done = {r["key"] for r in state.filter("not failed").select("key").join(spark.createDataFrame([(k,) for k in keys], "key string"), "key").collect()}  # of the keys asked for
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = set()
    todo = [k for k in keys if k not in done]
    if todo:
        reader = spark.read.format(name).option("keys", "\n".join(todo))
        for option, value in options.items():
            reader = reader.option(option, str(value))
        run = reader.load().withColumn("run", F.lit(time.time_ns()))
        run.write.mode("append").parquet(path)
    return latest(spark.read.schema(SCHEMA + ", run long").parquet(path))


def latest(pages: DataFrame) -> DataFrame:
    """The pages of each key's last run."""
    last = pages.groupBy("key").agg(F.max("run").alias("run"))
    return pages.join(last, ["key", "run"]).select("key", "page", "payload", "error")


def failures(pages: DataFrame) -> DataFrame:
    """By key, the page that failed and why, and how many pages came before it."""
    return pages.filter(F.col("error").isNotNull()).select("key", "page", "error")
