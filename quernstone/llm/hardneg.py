"""Hard negatives by norm-bucketed search.

For each anchor, the rows of its label with the highest inner products are its positives; for
each positive, the best rows of other labels whose score lies within a window below the
positive's are its hard negatives.

Candidates are sorted by norm, largest first, and packed into shelves of consecutive norms; a
shelf is searched in buckets.  By Cauchy-Schwarz no row of a bucket scores above the anchor's
norm times the bucket's largest.  Two things are held against that bound:

* the lower limits of an anchor's windows.  Anchors are sorted into blocks by the least norm
  that any of their windows needs, and a block is only sent to the shelves that reach it.
* the running kth score of each window.  A block walks its shelves from large norms to small
  ones, so a bucket that can't better any window ends the walk.

Positives are found by the same walk over shelves of one label, with one window without limits.
A block's shelves are dealt into lanes of ``LANE``, so a few anchors against very many
candidates are many tasks; the best of each lane are merged by rank.

Defined results: rows whose id, label or vector is null, or whose vector holds null or
non-finite components, take no part; shorter vectors count as padded with zeros; rows with the
anchor's own id are neither its positives nor its negatives; each row of a repeated anchor id has its
own result, and rows of another repeated id count one by one; a window without whole numbers has no
negatives; equal scores go to the smaller id; no anchors give no rows.  Scores are exact at any size; those
beyond a long are ranked exactly (up to 2**125) and returned as the largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .covertree import _LONG, _LOW, exact_products, padded
from .store import saved

#: Rows on a shelf, in a bucket and in a block of anchors; shelves (partitions of them) in a lane.
SHELF, BUCKET, BLOCK, LANE = 8192, 1024, 512, 8

_PAYLOAD = "rows binary, ids binary, labels binary, kind string, vectors binary"
_ASKED = "array<struct<at int, turn int, positive long, high long, low long>>"


def integer_rows(df: DataFrame, key: str, label: Column, vector: str, scale: float) -> DataFrame:
    """Usable rows as (row, id, label, vector array<long>, norm): floor(scale * x) of each component x as double."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("vector"))
    rows = rows.filter("id is not null and label is not null and vector is not null").filter(F.forall("vector", finite))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long")))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return padded(rows, "vector").withColumn("norm", F.sqrt(square)).withColumn("row", F.monotonically_increasing_id()).select("row", "id", "label", "vector", "norm")


def whole(high: int, low: int) -> int:
    return (high << _LOW) + low


def halves(score: int) -> tuple[int, int]:
    return max(-_LONG, min(_LONG, score >> _LOW)), score & ((1 << _LOW) - 1)


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


class Walk:
    """The best candidates of each window of a block's anchors, over buckets of falling norm.

    A window belongs to the anchor ``at``, and takes scores from ``low`` to ``high`` (None: any).
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, at: np.ndarray, low: list[int | None], high: list[int | None], k: int, same: bool):
        self.ids, self.labels, self.x, self.at, self.k, self.same = ids, labels, x, at, k, same
        self.low, self.high = low, high
        self.norms = np.sqrt(np.einsum("ij,ij->i", y := x.astype(np.float64), y))
        self.most = float(np.abs(y).max(initial=0))
        self.found: list[list[tuple[int, int]]] = [[] for _ in low]  # (-score, id), ascending
        self.need = np.array([-np.inf if v is None else v - abs(v) * 1e-12 for v in map(_as_float, low)])
        self.products = 0

    def open(self, norm: float) -> np.ndarray:
        """The windows for which a row of this norm could still count."""
        could = self.norms[self.at] * norm
        return np.flatnonzero(could * (1 + 1e-9) + 1e-9 >= self.need)

    def shelf(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> bool:
        """Walks a shelf sorted by norm, largest first; False once no later bucket can count."""
        norms = np.sqrt(np.einsum("ij,ij->i", y := x.astype(np.float64), y))
        for b in range(0, len(ids), BUCKET):
            left = self.open(float(norms[b]))
            if not len(left):
                return False
            part = slice(b, b + BUCKET)
            self._bucket(left, ids[part], labels[part], x[part])
        return True

    def _bucket(self, left: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        rows, of = np.unique(self.at[left], return_inverse=True)
        most = max(1.0, self.most * float(np.abs(x.astype(np.float64)).max(initial=0)) * x.shape[1])
        scores = exact_products(self.x[rows].astype(np.int64), x.astype(np.int64), most)
        self.products += scores.size
        able = (self.labels[rows][:, None] == labels) == self.same
        able &= self.ids[rows][:, None] != ids
        edge = int(most) + 1  # no score is beyond it
        limit = lambda v, other: other if v is None else max(-edge, min(edge, v))
        lows = [limit(self.low[w], -edge) for w in left]
        lows = [max(v, limit(-self.found[w][-1][0], -edge)) if len(self.found[w]) == self.k else v for v, w in zip(lows, left)]
        low, high = (np.array(v, scores.dtype)[:, None] for v in (lows, [limit(self.high[w], edge) for w in left]))
        for a in range(0, len(left), BLOCK):  # windows at a time
            own = scores[of[a : a + BLOCK]]
            hit = able[of[a : a + BLOCK]] & (own >= low[a : a + BLOCK]).astype(bool) & (own <= high[a : a + BLOCK]).astype(bool)
            for i in np.flatnonzero(hit.any(axis=1)):
                self._add(int(left[a + i]), own[i], np.flatnonzero(hit[i]), ids)

    def _add(self, w: int, scores: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
        if len(at) > 4 * self.k and scores.dtype != object:  # all that tie with the kth stay in
            cut = np.partition(scores[at], len(at) - self.k)[len(at) - self.k]
            at = at[scores[at] >= cut]
        new = [(-int(s), i) for s, i in zip(scores[at].tolist(), ids[at].tolist())]
        self.found[w] = sorted(self.found[w] + new)[: self.k]
        if len(self.found[w]) == self.k:
            kth = _as_float(-self.found[w][-1][0])
            self.need[w] = max(self.need[w], kth - abs(kth) * 1e-12)


def _as_float(v: int | None) -> float | None:
    return None if v is None else float(v)


def _sorted(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """Rows in range partitions of about ``size``, which carry their number, each sorted; rows that tie are dealt by their row."""
    keys = [*order, F.xxhash64("row"), F.col("row")]
    parts = max(1, -(-df.count() // size))
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())


def _bytes(rows: list, kind: str) -> bytes:
    return np.asarray(rows).astype(kind).tobytes()


def _packed(df: DataFrame, size: int, width: int, by_label: bool, norms: np.ndarray | None = None) -> DataFrame:
    """Sorted rows (part, row, id, label, vector, ...) -> packs of consecutive ones: (pack, part, label, most, payload).

    With ``by_label`` a pack holds one label.  With ``norms``, the largest norm of each part of shelves,
    rows bring ``reach`` and ``asked``, and ``last`` is the last part whose norm reaches the pack's least.
    """
    asks = norms is not None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        place = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, place
            part, rows, ids, labels, norm, vectors, *rest = zip(*held)
            x = np.stack(vectors) if width else np.zeros((len(held), 0), np.int64)
            top = int(max(x.max(initial=0), -1 - x.min(initial=0)))
            kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
            out = [(part[0] << 30) + place, part[0], labels[0], float(max(norm)), *(_bytes(v, "<i8") for v in (rows, ids, labels)), kind, x.astype(kind).tobytes()]
            if asks:
                out += [int((norms >= min(rest[0]) * (1 - 1e-9) - 1e-9).sum()) - 1, [{"at": i} | a for i, many in enumerate(rest[1]) for a in many]]
            held, place = [], place + 1
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, out))], schema)

        for batch in batches:
            part, rows, ids, labels, norm = (batch.column(n).to_numpy(zero_copy_only=False).tolist() for n in range(5))
            flat = batch.column(5).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, width)
            more = [batch.column(6).to_pylist(), batch.column(7).to_pylist()] if asks else []
            for i in range(batch.num_rows):
                if held and (len(held) == size or by_label and held[0][3] != labels[i] or held[0][0] != part[i]):
                    yield flush()
                held.append((part[i], rows[i], ids[i], labels[i], norm[i], x[i], *(m[i] for m in more)))
        if held:
            yield flush()

    asked = pa.list_(pa.struct([("at", pa.int32()), ("turn", pa.int32()), ("positive", pa.int64()), ("high", pa.int64()), ("low", pa.int64())]))
    fields = [("pack", pa.int64()), ("part", pa.int32()), ("label", pa.int64()), ("most", pa.float64()), ("rows", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary())]
    schema = pa.schema(fields + ([("last", pa.int32()), ("asked", asked)] if asks else []))
    kinds = f"pack long, part int, label long, most double, {_PAYLOAD}" + (f", last int, asked {_ASKED}" if asks else "")
    return saved(df.select("part", "row", "id", "label", "norm", "vector", *(["reach", "asked"] if asks else [])).mapInArrow(pack, kinds))


def _walked(blocks: DataFrame, shelves: DataFrame, pairs: DataFrame, width: int, k: int, low: int | None, high: int | None) -> DataFrame:
    """What blocks find on the shelves of ``pairs`` (block, shelf, lane): rows (row, anchor, turn, positive, p_high, p_low, id, high, low).

    A task reads a block and then, one at a time and by falling norm, the shelves of its lane.
    """
    payload = [c.split()[0] for c in _PAYLOAD.split(", ")]
    same = low is None
    asked = F.col("asked") if "asked" in blocks.columns else F.lit(None).cast(_ASKED)
    heads = pairs.select("block", "lane").distinct().join(blocks.withColumnRenamed("pack", "block").select("block", *payload, asked.alias("asked")), "block")
    heads = heads.select("block", "lane", F.lit(-1).cast("long").alias("place"), *payload, "asked")
    visits = pairs.join(shelves.select(F.col("pack").alias("shelf"), *payload), "shelf")
    visits = visits.select("block", "lane", F.col("shelf").alias("place"), *payload, F.lit(None).cast(_ASKED).alias("asked"))
    names = ["row", "anchor", "turn", "positive", "p_high", "p_low", "id", "high", "low"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: Walk | None = None
        about: list[tuple] = []
        going = True

        def result() -> Iterator[pa.RecordBatch]:
            out = [(*a, i, *halves(-s)) for a, found in zip(about, here.found if here else []) for s, i in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                place, rows, ids, labels, kind, vectors, windows = (batch.column(c)[i] for c in range(2, 9))
                rows, ids, labels = (np.frombuffer(v.as_buffer(), "<i8") for v in (rows, ids, labels))
                x = np.frombuffer(vectors.as_buffer(), kind.as_py()).reshape(len(ids), width)
                if place.as_py() < 0:
                    yield from result()
                    going = True
                    if same:
                        about = [(r, a, 0, 0, 0, 0) for r, a in zip(rows.tolist(), ids.tolist())]
                        here = Walk(ids, labels, x, np.arange(len(ids)), [None] * len(ids), [None] * len(ids), k, True)
                    else:
                        each = windows.as_py()
                        about = [(int(rows[w["at"]]), int(ids[w["at"]]), w["turn"], w["positive"], w["high"], w["low"]) for w in each]
                        limits = [window(whole(w["high"], w["low"]), low, high) for w in each]
                        here = Walk(ids, labels, x, np.array([w["at"] for w in each], np.int64), [a for a, _ in limits], [b for _, b in limits], k, False)
                elif going and here is not None:
                    going = here.shelf(ids, labels, x)
        yield from result()

    stream = heads.unionByName(visits).repartition("block", "lane").sortWithinPartitions("block", "lane", "place")
    return stream.mapInArrow(walk, ", ".join(f"{n} long" for n in names))


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col("high").desc(), F.col("low").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def positives(rows: DataFrame, anchors: DataFrame, width: int, k: int, shelf: int = SHELF, block: int = BLOCK) -> DataFrame:
    """The k best rows of each anchor's own label: (row, rank, id, high, low)."""
    order = ["label", F.col("norm").desc()]
    shelves, blocks = (_packed(_sorted(df, n, *(F.col(c) if isinstance(c, str) else c for c in order)), n, width, True) for df, n in ((rows, shelf), (anchors, block)))
    lane = F.floor(F.col("part") / LANE)
    pairs = blocks.select("label", F.col("pack").alias("block")).join(shelves.select("label", F.col("pack").alias("shelf"), lane.alias("lane")), "label")
    return _best(_walked(blocks, shelves, pairs.select("block", "shelf", "lane"), width, k, None, None), k, "row").select("row", "rank", "id", "high", "low")


def _reach(low: int):
    """The least norm that a row needs for any of an anchor's windows; null for an anchor all of whose windows are empty."""
    score = lambda p: p["high"].cast("double") * float(1 << _LOW) + p["low"]
    least = F.array_min(F.transform("asked", lambda p: F.greatest(F.lit(0.0), score(p) * low / 100)))
    return F.when(F.col("norm") > 0, least / F.col("norm")).otherwise(0.0)


def mine(
    df: DataFrame, anchors: Column, label: Column, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, positive: int = 5, negative: int = 3,
    low: int = 50, high: int = 95, shelf: int = SHELF, block: int = BLOCK,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` says of an id (column ``id``) whether it is asked; scores of negatives lie from ``low`` to ``high`` percent of the positive's.
    """
    rows = saved(integer_rows(df, key, label, vector, scale))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    asked = rows.filter(anchors)
    best = positives(rows, asked, width, positive, shelf, block)
    own = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("turn"), F.col("id").alias("positive"), "high", "low"))).alias("asked"))
    wide = asked.join(own, "row").withColumn("asked", F.filter("asked", lambda p: p["high"] >= 0)).filter(F.size("asked") > 0)  # below zero a window is empty
    wide = saved(wide.withColumn("reach", _reach(low)))
    shelves = _packed(_sorted(rows, shelf, F.col("norm").desc()), shelf, width, False)
    most = {r["part"]: r["most"] for r in shelves.groupBy("part").agg(F.max("most").alias("most")).collect()}  # a number for each partition
    norms = np.array([most.get(p, np.inf) for p in range(max(most, default=-1) + 1)])
    norms = np.minimum.accumulate(norms) if len(norms) else norms  # an empty part stands with the one before
    blocks = _packed(_sorted(wide, block, F.col("reach").desc()), block, width, False, norms)
    reached = blocks.filter("last >= 0").select(F.col("pack").alias("block"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("part"))
    pairs = reached.join(shelves.select("part", F.col("pack").alias("shelf")), "part").withColumn("lane", F.floor(F.col("part") / LANE))
    found = _best(_walked(blocks, shelves, pairs.select("block", "shelf", "lane"), width, negative, low, high), negative, "row", "turn")
    score = lambda h, lo: F.when(F.col(h).between(-2, 1), F.shiftleft(h, _LOW) + F.col(lo)).when(F.col(h) > 0, F.lit(_LONG)).otherwise(F.lit(-_LONG) - 1)
    return found.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        score("p_high", "p_low").alias("positive_score"), score("high", "low").alias("negative_score"),
    )
