"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

The total of all targets is cut into slots.  Slot i stands at the fractional part of
i / golden ratio; the source whose interval of the cumulative targets holds that point
gets the slot.  Sources with too few slots to be served evenly are dealt again among
themselves, in slots of fewer tokens.  Slots are numbered within their source, and a
source's documents are laid end to end in shuffled order, in a ring that is cut into
blocks of as many tokens as a slot counts; slot n of a source joins block n of its
ring.  Numbers and offsets are running sums in two levels (within a bucket, over the
buckets), so no source is ever ordered in one task.

Defined results: a null text has size zero and is never taken; a null source is a
source of its own, the last; equal rows stay separate rows; no tokens at all give
targets and takings of zero.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import saved, written
from .tokens import WORD

#: Slots that all tokens are cut into; rows of a bucket of a source's shuffled order, or of its slots; cells of the unit interval.
SLOTS, BUCKET, CELLS = 1 << 20, 1 << 15, 1024

_GOLDEN = 0.6180339887498949


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, most: float = 3.0, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Rows (source, size) -> one row for each source: rank, weight, source_size and target.

    Weights follow the sources in code point order, null last.  A target above ``most``
    times its source's size stops there and the excess is shared again: in order of
    limit / weight, the first source that stays under its share ends the search.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    by = by.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", weight)
    all_ = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.orderBy(F.col("limit") / F.col("weight"), "rank")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    by = by.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("limit").over(earlier), zero)
    heavy = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(earlier), zero)
    by = by.withColumn("level", left / heavy)
    by = by.withColumn("free", F.col("weight") * F.col("level") < F.col("limit"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(all_)["level"]
    share = F.least("limit", F.col("weight") * level)
    return by.withColumn("target", F.coalesce(share, F.col("limit"))).select("rank", "source", "weight", "source_size", "target")


def _deal(sources: DataFrame, total: float, tokens: int) -> DataFrame:
    """Rows (rank, target) -> the slots of ``tokens`` that the schedule gives to each source: (rank, at, nth, tokens)."""
    slots = ceil(total / tokens)
    s = sources.withColumn("high", F.sum("target").over(W.orderBy("rank"))).withColumn("low", (F.col("high") - F.col("target")) / total).withColumn("high", F.col("high") / total)
    s = s.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    point = F.col("id") * F.lit(_GOLDEN)
    points = sources.sparkSession.range(slots).withColumn("x", point - F.floor(point)).withColumn("cell", F.floor(F.col("x") * CELLS))
    used = points.join(s, "cell").filter("x >= low and x < high")  # a row for each source and cell at most
    used = used.select("rank", "id", F.floor(F.col("id") / BUCKET).alias("run"))
    runs = used.groupBy("rank", "run").agg(F.count("*").alias("n"))
    runs = runs.select("rank", "run", (F.sum("n").over(W.partitionBy("rank").orderBy("run")) - F.col("n")).alias("before"))
    turn = F.row_number().over(W.partitionBy("rank", "run").orderBy("id")) - 1
    numbered = used.withColumn("turn", turn).join(runs, ["rank", "run"])
    return numbered.select("rank", ((F.col("id") + 0.5) / slots).alias("at"), (F.col("before") + F.col("turn")).alias("nth"), F.lit(tokens).cast("long").alias("tokens"))


def schedule(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Sources -> their slots: rank, at (when in the mix, from 0 to 1), nth (of the source's slots) and tokens.

    A source that would get less than the root of ``slots`` (or than half an even share,
    if that is less) waits for the next round, so no target is small beside a slot of
    its round; in a round of no more words than slots, a slot is one word.
    """
    left = sources.filter("target > 0").select("rank", "target")
    done = left.select("rank", F.lit(0.5).alias("at"), F.lit(0).cast("long").alias("nth"), F.lit(0).cast("long").alias("tokens")).limit(0)
    while (all_ := left.agg(F.count("*").alias("n"), F.sum("target").alias("total")).first())["n"]:
        here = max(slots, 64 * all_["n"])
        least = min(isqrt(slots) * all_["total"] / here, all_["total"] / (2 * all_["n"])) if all_["total"] > here else 0.0
        served = left.filter(F.col("target") >= least)
        total = served.agg(F.sum("target").alias("total")).first()["total"]
        done = done.unionByName(_deal(served, total, max(1, ceil(total / here))))
        left = left.filter(F.col("target") < least)
    return done


def _ring(sized: DataFrame) -> DataFrame:
    """Rows (rank, size, h, id and more) with words -> the same with start, each one's place in its source's ring."""
    buckets = max(1, ceil(sized.count() / BUCKET))
    placed = sized.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    within = W.partitionBy("rank", "bucket").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum("size").over(within))
    sums = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("held"))
    sums = sums.select("rank", "bucket", (F.sum("held").over(W.partitionBy("rank").orderBy("bucket")) - F.col("held")).alias("before"))
    placed = placed.join(sums, ["rank", "bucket"])
    return placed.select(*sized.columns, (F.col("before") + F.col("end") - F.col("size")).alias("start"))


def _blocks(ring: DataFrame) -> DataFrame:
    """Parts of documents in the blocks of their ring: its columns, nth (of the block), skip (words of the document before the part) and part.

    As many laps as the source's slots make, cut where they end, and one at least.
    """
    laps = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("words") - 1) / F.col("source_size"))))
    parts = ring.withColumn("lap", F.explode(laps)).withColumn("base", F.col("lap") * F.col("source_size") + F.col("start"))
    block = lambda at: F.floor(at / F.col("tokens"))
    parts = parts.withColumn("nth", F.explode(F.sequence(block(F.col("base")), block(F.col("base") + F.col("size") - 1))))
    begins = F.greatest("base", F.col("nth") * F.col("tokens"))
    ends = F.least(F.col("base") + F.col("size"), (F.col("nth") + 1) * F.col("tokens"), "words")
    return parts.withColumn("skip", begins - F.col("base")).withColumn("part", F.greatest(F.lit(0), ends - begins))


def _parts(docs: DataFrame, text: str, source: str, key: str, size: Column | None, slots: int, most: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their source's numbers, their parts in blocks, and the slots."""
    size = n_words(text) if size is None else size
    h = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    sized = saved(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), size.cast("long").alias("size"), h.alias("h")))
    sources = saved(targets(sized, most))
    turns = saved(schedule(sources, slots))
    limit = F.floor(F.col("source_size") * F.lit(float(most)))
    given = turns.groupBy("rank").agg(F.sum("tokens").alias("words"), F.max("tokens").alias("tokens"))
    words, tokens = F.coalesce(F.least("words", limit), F.lit(0)), F.coalesce("tokens", "source_size")
    served = sources.join(given, "rank", "left").select(F.col("source").alias("of"), "rank", "source_size", "target", words.alias("words"), tokens.alias("tokens"))
    # a table of its own, so that its size is known and no source's documents are shuffled to one task
    ranked = sized.join(written(served), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return ranked, _blocks(_ring(ranked.filter("size > 0"))), turns


def stream(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", size: Column | None = None,
    slots: int = SLOTS, most: float = 3.0, seed: int = 42,
) -> DataFrame:
    """The mix itself, a row for each part of a document in a slot: at, nth, id, source, skip and part (in words).

    Rows in order of ``at`` have each source near its share at every point of the mix.
    """
    _, parts, turns = _parts(docs, text, source, key, size, slots, most, seed)
    out = parts.join(turns.select("rank", "nth", "at"), ["rank", "nth"]).filter("part > 0")
    return out.select("at", "nth", F.col("id").alias(key), F.col("source").alias(source), "skip", "part")


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", size: Column | None = None,
    slots: int = SLOTS, most: float = 3.0, seed: int = 42,
) -> DataFrame:
    """One row for each document: id, source, size, source_size, target (of its source) and taken, the sum of its parts in slots."""
    ranked, parts, turns = _parts(docs, text, source, key, size, slots, most, seed)
    met = parts.join(turns.select("rank", "nth", F.lit(1).alias("met")), ["rank", "nth"], "left")
    # a document's place in its ring tells equal rows apart
    taken = met.groupBy("rank", "start", "id", "source", "size", "source_size", "target").agg(F.sum(F.col("part") * F.coalesce("met", F.lit(0))).alias("taken"))
    none = ranked.filter("size = 0").withColumn("taken", F.lit(0))
    both = taken.drop("rank", "start").unionByName(none.select("id", "source", "size", "source_size", "target", "taken"))
    return both.select(F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
