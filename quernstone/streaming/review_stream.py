"""A living review as a stream with state: what is known is kept by key, so no batch reads the table it adds to.

The state holds one entry for each (external_id, source) that was ever let through, in RocksDB, dealt out by key
and checkpointed with the offsets.  A restart goes on with the state of the last batch that was committed; the
rows of a batch are written to a folder of its own, which a second run of the batch replaces.

A record counts by the day it was entered, not published: one that arrives late is let through as long as its entry
lies within the look-back of the day of the batch, and a repeated one is not, however much later it comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

KEYS = ["external_id", "source"]

#: Buckets of keys, for the life of a checkpoint: what a task holds at a time is the first records of one bucket's keys in one batch.
BUCKETS = 4096
_KEY, _BUCKET = "review_key", "review_bucket"  # Spark renames columns that begin with an underscore on their way to pandas

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Lets the first record of each key of a bucket through: the one entered first of those that come together."""

    def __init__(self, columns: list[str], entered: str):
        self.columns, self.order = columns, [entered, *[c for c in columns if c != entered]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "known boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if part.empty:  # a bucket of known keys only
                continue
            part = part[[_KEY, *self.columns]]
            first = part if first is None else pd.concat([first, part])
            if first[_KEY].duplicated().any():
                first = first.sort_values(self.order, kind="stable", na_position="last").drop_duplicates(_KEY)
        if first is None:
            return
        new = first[[not self.seen.containsKey((k,)) for k in first[_KEY]]]
        for k in new[_KEY]:
            self.seen.updateValue((k,), (True,))
        if len(new):
            yield new[self.columns]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for k in initialState[_KEY] if not initialState.empty else ():
            self.seen.updateValue((k,), (True,))

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, lookback_days: int, entered: str = "entered", known: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """The records of a stream that are new; ``known`` (external_id, source) is what was there before the stream began."""
    since = F.date_sub(now if now is not None else F.current_date(), lookback_days)
    fresh = stream.filter((F.col(entered) >= since) & F.col("external_id").isNotNull())
    types = [(c, fresh.schema[c].dataType) for c in KEYS]
    start = _dealt(known.select(*[F.col(c).cast(t) for c, t in types]).distinct()).select(_BUCKET, _KEY).groupBy(_BUCKET) if known is not None else None
    return _dealt(fresh).groupBy(_BUCKET).transformWithStateInPandas(
        statefulProcessor=FirstSeen(stream.columns, entered), outputStructType=stream.schema, outputMode="Append", timeMode="None", initialState=start
    )


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with their key as one text, in which null differs from any value, and its bucket."""
    return rows.withColumn(_KEY, F.to_json(F.struct(*KEYS))).withColumn(_BUCKET, F.pmod(F.xxhash64(_KEY), F.lit(BUCKETS)).cast("int"))


def review(
    stream: DataFrame, target: str, checkpoint: str, lookback_days: int = 30, entered: str = "entered", known: DataFrame | None = None, now: Column | None = None,
    once: bool = True, interval: str = "1 day", then: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Adds the new records of each batch to ``target``, in a folder ``epoch=N``; ``then`` gets the rows as written.

    ``known`` is read when the query starts for the first time, never again.
    """
    spark = stream.sparkSession

    def add(batch: DataFrame, epoch: int) -> None:
        folder = f"{target.rstrip('/')}/epoch={epoch}"
        batch.write.mode("overwrite").parquet(folder)
        if then is not None:
            then(batch.sparkSession.read.schema(stream.schema).parquet(folder), epoch)

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps the settings that it starts with
    try:
        writer = first_seen(stream, lookback_days, entered, known, now).writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def reviewed(target: str, like: DataFrame) -> DataFrame:
    """All records that were added, with the epoch that added them."""
    columns = ", ".join(f"`{c}` {t}" for c, t in like.dtypes)
    return like.sparkSession.read.schema(f"{columns}, epoch long").parquet(target)
