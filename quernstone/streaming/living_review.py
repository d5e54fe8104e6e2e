"""Continuous ingest of new records, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_records(existing: DataFrame, batch: DataFrame, lookback_days: Column, entered: str = "entered", now: Column | None = None) -> DataFrame:
    """Records entered within their scenario's look-back and not yet known by (external_id, source).

    The window is on the day a record was entered, not published, so late ones are found.
    """
    since = F.date_sub(now if now is not None else F.current_date(), lookback_days)
    fresh = batch.filter((F.col(entered) >= since) & F.col("external_id").isNotNull()).dropDuplicates(["external_id", "source"])
    return fresh.join(existing.select("external_id", "source"), ["external_id", "source"], "left_anti").select(*batch.columns)


def report(batch: DataFrame, added: DataFrame, group: str = "scenario_id") -> DataFrame:
    """By scenario: records found, new and skipped."""
    found = batch.groupBy(group).agg(F.count("*").alias("found"))
    new = added.groupBy(group).agg(F.count("*").alias("new"))
    out = found.join(new, group, "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return out.withColumn("skipped", F.col("found") - F.col("new"))


def ingest(stream: DataFrame, target: str, checkpoint: str, lookback_days: int = 30, once: bool = True, interval: str = "1 day", then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Appends the new records of each micro-batch to a Parquet table; a batch that runs again adds nothing."""

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(batch.schema).parquet(target).select("external_id", "source")  # two columns of the table
        out = new_records(known, batch, F.lit(lookback_days))
        out.write.mode("append").parquet(target)
        if then is not None:
            then(out)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, ts: str, size: str, by: list[str], aggs: list[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; on a stream, ``late`` is how long late rows are waited for."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = rows.groupBy(window.alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *out.columns[1:])


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *out.columns[1:])


def scenarios(presets: DataFrame, users: DataFrame, days: int = 30) -> DataFrame:
    """All scenarios under review: presets by their place, then users' own with an owner and a query.

    Gives scenario_id, place, lookback_days and project_context ("preset" or "user").
    """
    owned = users.filter("owner is not null and trim(query) <> ''")
    columns = ["scenario_id", "turn", "place", F.coalesce("lookback_days", F.lit(days)).alias("lookback_days"), "project_context"]
    rows = [df.withColumns({"turn": F.lit(i), "project_context": F.lit(c)}).select(*columns) for i, (df, c) in enumerate(((presets, "preset"), (owned, "user")))]
    return rows[0].unionByName(rows[1])


def review_all(existing: DataFrame, batch: DataFrame, under_review: DataFrame, entered: str = "entered", now: Column | None = None) -> DataFrame:
    """New records of all scenarios in one pass, each under the first scenario that finds it, as if they were reviewed in turn."""
    rows = batch.join(under_review, "scenario_id")
    since = F.date_sub(now if now is not None else F.current_date(), F.col("lookback_days"))
    fresh = rows.filter((F.col(entered) >= since) & F.col("external_id").isNotNull())
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in ("external_id", "source")]), F.struct("turn", "place", "scenario_id"))
    fresh = fresh.groupBy("external_id", "source").agg(first.alias("r")).select("external_id", "source", "r.*")
    return fresh.join(existing.select("external_id", "source"), ["external_id", "source"], "left_anti").select(*batch.columns, "project_context")
