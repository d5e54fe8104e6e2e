"""What five quality filters remove, alone and in every order.

Texts are scanned in the buffers that Arrow brings: byte classes by table lookup, counts
by prefix sums, distinct words by sorting each document's word hashes; words of equal hash
are compared byte by byte, and a document with a clash is counted from the words themselves.
Each document ends as a mask of the filters that it fails.  The masks are counted by part,
32 numbers at most, and every order of the filters is read off those.

Exact copies are found by SHA-256: the smallest id of each digest comes from an aggregation,
and documents are joined to it by digest and id, so a text with many copies is many keys.

Defined results: a null text is empty; a null source is the part ''; a document without an id
is never a copy, is never the first of one, and has no labels; rows that share id and text are
no copies of each other; of several labels of an id, one that says 1 is enough; an empty table has
no parts.  Columns beyond those asked for are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .tokens import _DELIM, word_hashes

FILTERS = "ABCDE"

#: Bytes scanned at a time; longer texts are scanned in pieces that end between words.
BLOCK = 1 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True

Words = tuple[np.ndarray, np.ndarray]


def _words(flat: np.ndarray, bounds: np.ndarray) -> Words:
    """Starts and ends of words; none crosses one of the bounds of texts."""
    inside = ~_DELIM[flat]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = bounds[(bounds > 0) & (bounds < len(flat))]
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _differ(flat: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes (over 0) from a and from b differ, for each pair."""
    out = np.zeros(len(a), bool)
    at, ends = 0, np.cumsum(size)
    while at < len(a):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
        n = size[at:to]
        starts = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(starts, n)
        unlike = flat[np.repeat(a[at:to], n) + within] != flat[np.repeat(b[at:to], n) + within]
        out[at:to] = np.logical_or.reduceat(unlike, starts)
        at = to
    return out


def _distinct(flat: np.ndarray, words: Words, hashes: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each text (``of``: the text of each word), and the places of words that are first of their hash."""
    starts, ends = words
    order = np.lexsort((hashes, of))
    a, b = order[:-1], order[1:]
    again = (of[a] == of[b]) & (hashes[a] == hashes[b])
    a, b = a[again], b[again]
    sizes = ends - starts
    clash = sizes[a] != sizes[b]
    clash[~clash] = _differ(flat, starts[a[~clash]], starts[b[~clash]], sizes[a[~clash]])
    found = np.bincount(of, minlength=texts) - np.bincount(of[b], minlength=texts)
    mixed = np.unique(of[a[clash]])
    for t in mixed:
        found[t] = len({flat[s:e].tobytes() for s, e in zip(starts[of == t], ends[of == t])})
    lead = order[np.concatenate(([True], ~again))[: len(order)]] if not len(mixed) else order
    return found, lead


def _pieces(flat: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``BLOCK`` bytes; each but the last ends behind a delimiter."""
    at = 0
    while at < len(flat):
        to = at + BLOCK
        while to < len(flat) and not _DELIM[flat[to - 1]]:
            gap = _DELIM[flat[to : to + BLOCK]]
            to += int(gap.argmax()) + 1 if gap.any() else len(gap)
        yield at, min(to, len(flat))
        at = to


def _counts(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Code points, capitals and symbols of each text."""
    out = []
    for flags in ((flat & 0xC0) != 0x80, (flat >= 65) & (flat <= 90), _SYMBOL[flat]):
        sums = np.concatenate(([0], np.cumsum(flags)))
        out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return np.stack(out)


def scan(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts in one byte array -> five rows: their words, distinct words, code points, capitals and symbols."""
    n = len(bounds) - 1
    out = np.zeros((5, n), np.int64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, side="right")) - 1)
        part, cuts = flat[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        if len(part) <= BLOCK:
            words = _words(part, cuts)
            of = np.searchsorted(cuts[1:], words[0], side="right")
            out[0, at:to] = np.bincount(of, minlength=to - at)
            out[1, at:to] = _distinct(part, words, word_hashes(part, *words), of, to - at)[0]
            out[2:, at:to] = _counts(part, cuts)
        else:  # one long text
            kept: list[tuple[np.ndarray, ...]] = []
            for a, b in _pieces(part):
                piece = part[a:b]
                words = _words(piece, np.zeros(0, np.int64))
                hashes, of = word_hashes(piece, *words), np.zeros(len(words[0]), np.int64)
                lead = _distinct(piece, words, hashes, of, 1)[1]
                kept.append((words[0][lead] + a, words[1][lead] + a, hashes[lead]))
                out[0, at] += len(words[0])
                out[2:, at] += _counts(piece, np.array([0, b - a]))[:, 0]
            starts, ends, hashes = (np.concatenate(x) for x in zip(*kept))
            out[1, at] = _distinct(part, (starts, ends), hashes, np.zeros(len(starts), np.int64), 1)[0][0]
        at = to
    return out


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each begins (one more at the end)."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, bounds - bounds[0]


def fails(counts: np.ndarray) -> np.ndarray:
    """The filters A to D that texts with these counts fail, as bits 1, 2, 4 and 8."""
    words, distinct, points, capitals, symbols = counts
    return (words < 50) + 2 * (100 * distinct < 65 * words) + 4 * (100 * capitals > 5 * points) + 8 * (symbols > 0)


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows (id, part, digest, failed, n_words, n_distinct, n_points, n_capitals, n_symbols), one for each document."""
    names = ["n_words", "n_distinct", "n_points", "n_capitals", "n_symbols"]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), whole.alias("text"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = scan(*_buffer(batch.column(3)))
            columns = [*batch.columns[:3], pa.array(fails(counts).astype(np.int32)), *map(pa.array, counts)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "part", "digest", "failed", *names])

    return rows.mapInArrow(scanned, "id long, part string, digest binary, failed int, " + ", ".join(f"{n} long" for n in names))


def with_copies(rows: DataFrame) -> DataFrame:
    """Rows (id, digest, failed, ...) with bit 16 of ``failed`` where a smaller id has the same digest."""
    known = rows.filter("id is not null")
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull(), 16).otherwise(0)
    joined = known.join(first, ["digest", "id"], "left").withColumn("failed", F.col("failed") + copy)
    return joined.select(*rows.columns).unionByName(rows.filter("id is null"))


def _steps() -> tuple[list[tuple[str, int]], np.ndarray]:
    """(order, step) of all orders, and for each whether a mask counts as kept, removed, redundant or failing that filter only."""
    names, table = [], []
    masks = np.arange(32)
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order):
            own = 1 << FILTERS.index(letter)
            fail, gone = masks & own > 0, masks & before > 0
            names.append(("".join(order), step + 1))
            table.append([~fail & ~gone, fail & ~gone, fail & gone, masks == own])
            before |= own
    return names, np.array(table).transpose(1, 0, 2).astype(np.int64)


def interactions(counts: DataFrame) -> DataFrame:
    """Rows (part, failed, n, good, toxic) -> a row for each part, order of the filters and step."""
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, (kept, removed, redundant, only) = _steps()
        letter = np.array([FILTERS.index(order[step - 1]) for order, step in names])
        for batch in batches:
            for part, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = np.zeros((3, 32), np.int64)
                for r in rows:
                    seen[:, r["failed"]] = r["n"], r["good"], r["toxic"]
                n, good, toxic = seen
                gone = removed @ n
                of = np.array([gone[letter == i].sum() for i in range(len(FILTERS))])
                numbers = [kept @ n, gone, redundant @ n, only @ n, removed @ good, removed @ toxic, of[letter]]
                head = [pa.array([part] * len(names)), pa.array([o for o, _ in names]), pa.array([s for _, s in names], pa.int32())]
                yield pa.RecordBatch.from_arrays([*head, *map(pa.array, numbers)], columns)

    packed = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("rows"))  # 32 at most
    return packed.mapInArrow(orders, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns[3:]))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What each filter removes at each step of each order, by part; ``labels``: (key, quality, toxic)."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    said = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = written(marked(docs, key, text, part).select("id", "part", "digest", "failed"))
    rows = with_copies(rows)
    known = rows.filter("id is not null").join(said, "id", "left")
    rows = known.unionByName(rows.filter("id is null").withColumns({c: F.lit(False) for c in ("good", "toxic")}))
    counts = rows.groupBy("part", "failed").agg(F.count("*").alias("n"), F.count_if(F.col("good")).alias("good"), F.count_if(F.col("toxic")).alias("toxic"))
    return interactions(counts)


def failing(mask: Column, letter: str) -> Column:
    """Whether a mask has the bit of a filter."""
    return mask.bitwiseAND(1 << FILTERS.index(letter)) > 0
