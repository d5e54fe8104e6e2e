"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over every seven bytes of a text; where its low bits are all ones, a chunk ends.
Chunk ends depend on nearby bytes only, so an edit changes the chunks that it touches and no
others.  Where no chunk ends for four block sizes, as in a text that repeats itself, one is cut there.
The number of bits sets the block size (the mean size of a chunk): the smallest power of two that goes
into the text at most ``CHUNKS`` times and leaves fewer than twice as many triggers (one byte, for a short text).  A fingerprint is

    block size ":" signature ":" signature at twice the block size

with twelve bits of each chunk's hash as two letters.  Two fingerprints are compared at a block size
that both have: 1 less the edit distance of the signatures over the longer one's length; without
a common block size texts are of too different a size and their likeness is 0.

Rolling hash and chunk hashes both come from one prefix sum over the text (``tokens``), in blocks,
so a text of any length needs little more memory than itself.

``with_next`` compares each document with an edited copy and with the document after it in the
order of ids.  No task sees a global order: ids are cut into ranges at splitters drawn from a bounded
sample of them, each range is sorted by itself, and the first document of a range goes to the range before, too.

Defined results: a null text is empty; an empty text has no chunks, is like another empty
text (1) and unlike any other (0); documents without an id come after all others, rows that share one are
ordered by a hash of their texts; the only document of a table is its own next; bytes that are no
UTF-8 are kept and count one code point each; an empty table gives no rows.  Columns beyond those asked for are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import _BYTE, _K, _MIX, _power, mix

#: Bytes that the rolling hash sees; chunks of a signature, about; bits of the least block size; the longest chunk in block sizes; bytes hashed at a time.
WINDOW, CHUNKS, BITS, LONGEST, BLOCK = 7, 96, 0, 4, 1 << 20

#: Rows sampled for each range of ids.
PER_RANGE = 32

#: The letters of a signature, six bits each.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_FULL = 1 << 64


def _blocks(flat: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of a text: its place, how many bytes before it are there too, their prefix sums, and powers that shift a span to zero."""
    for at in range(0, len(flat), BLOCK):
        back = min(WINDOW - 1, at)
        symbols = _BYTE[flat[at - back : at + BLOCK]]
        up, down = _power(len(symbols))
        prefix = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=prefix[1:])
        yield at, back, prefix, down


def _triggers(blocks: Iterable, level: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The level that leaves fewer than twice ``CHUNKS`` triggers, from ``level`` on; where each stands, and its own level."""
    places, levels = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at, back, prefix, down in blocks:
        begin = np.maximum(np.arange(back + 1, len(prefix)) - WINDOW, 0)
        rolling = prefix[back + 1 :] - prefix[begin]
        rolling *= down[begin]
        rolling >>= np.uint64(24)
        ones = np.uint64((1 << (BITS + level)) - 1)
        hit = np.flatnonzero((rolling & ones) == ones)
        gap = ~rolling[hit] & (rolling[hit] + np.uint64(1))  # the lowest bit that is not set
        places = np.concatenate((places, hit + at + 1))
        levels = np.concatenate((levels, np.log2(gap.astype(np.float64)).astype(np.int64) - BITS))
        while len(places) >= 2 * CHUNKS:
            level += 1
            high = levels >= level
            places, levels = places[high], levels[high]
    return level, places, levels


def _ends(places: np.ndarray, size: int, most: int) -> np.ndarray:
    """Chunk ends: triggers, the end of the text, and cuts at every ``most`` bytes between them."""
    ends = np.append(places[places < size], size)
    starts = np.concatenate(([0], ends[:-1]))
    cuts = np.maximum(0, (ends - starts - 1) // most)
    of = np.repeat(np.arange(len(ends)), cuts)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts) + 1
    return np.sort(np.concatenate((ends, starts[of] + turn * most)))


def _sums(blocks: Iterable, places: np.ndarray) -> np.ndarray:
    """The prefix sum of the whole text at each place (ascending)."""
    out, total, done = np.zeros(len(places), np.uint64), np.uint64(0), 0
    for at, back, prefix, _ in blocks:
        to = int(np.searchsorted(places, at + len(prefix) - 1 - back, side="right"))
        shift = np.uint64(pow(_K, at - back, _FULL))
        out[done:to] = total + shift * (prefix[places[done:to] - at + back] - prefix[back])
        total, done = np.uint64((int(total) + int(shift) * (int(prefix[-1]) - int(prefix[back]))) % _FULL), to
    return out


def _signature(blocks: Callable[[], Iterable], places: np.ndarray) -> str:
    sums = _sums(blocks(), places)
    starts = np.concatenate(([0], places[:-1])).astype(np.int64)
    raw = sums - np.concatenate((np.zeros(1, np.uint64), sums[:-1]))
    if starts[-1] > BLOCK:
        raw = raw * np.array([pow(_K, -int(s), _FULL) for s in starts], np.uint64)
    else:
        raw = raw * _power(int(starts[-1]))[1][starts]
    symbols = (mix(raw + (places - starts).astype(np.uint64) * _MIX) >> np.uint64(52)).tolist()
    return "".join(LETTERS[s >> 6] + LETTERS[s & 63] for s in symbols)


def fingerprint(data: bytes) -> str:
    if not data:
        return f"{1 << BITS}::"
    flat = np.frombuffer(data, np.uint8)
    kept = list(_blocks(flat)) if len(flat) <= BLOCK else None
    blocks = lambda: _blocks(flat) if kept is None else kept
    level, places, levels = _triggers(blocks(), max(0, (-(-len(flat) // CHUNKS) - 1).bit_length() - BITS))
    size = 1 << (BITS + level)
    fine, coarse = (_signature(blocks, _ends(places[levels >= level + i], len(flat), (LONGEST * size) << i)) for i in (0, 1))
    return f"{size}:{fine}:{coarse}"


def distance(a: list[str], b: list[str]) -> int:
    """Edit distance, a column of the table at a time as the bits of whole numbers."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rise, fall, out = every, 0, len(a)
    for x in b:
        same = where.get(x, 0)
        across = ((same & rise) + rise ^ rise) | same
        up, down = (fall | ~(across | rise)) & every, rise & across
        out += (up & last > 0) - (down & last > 0)
        up, down = up << 1 | 1, down << 1
        rise, fall = (down | ~(same | fall | up)) & every, up & (same | fall) & every
    return out


def likeness(a: str, b: str) -> float:
    """How alike the texts of two fingerprints are, 0 to 1."""
    if a == b:
        return 1.0
    (n, *x), (m, *y) = a.split(":"), b.split(":")
    if int(n) > int(m):
        n, m, x, y = m, n, y, x
    if int(n) * 2 < int(m):
        return 0.0
    p, q = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (x[0 if n == m else 1], y[0]))
    return 1.0 - distance(p, q) / max(len(p), len(q), 1)


def fingerprint_of(text: Column | str) -> Column:
    """The fingerprint of a column of texts; null texts are empty."""

    @F.pandas_udf("string")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint((t or "").encode("utf-8", "surrogateescape")) for t in texts], dtype=object)

    return prints(text)


def likeness_of(a: Column | str, b: Column | str) -> Column:
    """The likeness of two columns of fingerprints; null where one is."""

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(p, q) if p is not None and q is not None else None for p, q in zip(x, y)], dtype=float)

    return alike(a, b)


def edited(text: str, following: str, share: int = 4) -> str:
    """The text with its last 1/share of code points replaced by as many of the first of the next (or all that it has)."""
    n = len(text) // share
    return text[: len(text) - n] + following[:n]


def _literal(keys: list) -> Column:
    one = lambda k: F.struct(F.lit(k["bare"]).alias("bare"), F.lit(k["id"]).alias("id"), F.lit(k["tie"]).alias("tie"))
    return F.array(*map(one, keys)) if keys else F.array().cast("array<struct<bare: boolean, id: bigint, tie: bigint>>")


def _ranges(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (bare, id, tie, ...) with part and guest: each in its range of keys, the first of a range also in the one before it.

    Splitters are keys of the table, every ``PER_RANGE``-th of a sample chosen by hash.
    """
    key = F.struct("bare", "id", "tie")
    n, least = rows.agg(F.count("*"), F.min(key)).first()
    if not n:
        return rows.withColumns({"part": F.lit(0), "guest": F.lit(0)})
    every = max(1, n // (parts * PER_RANGE))
    drawn = sorted(rows.filter(F.pmod(F.xxhash64("id", "tie"), F.lit(every)) == 0).select("bare", "id", "tie").distinct().collect())  # about parts * PER_RANGE
    step = max(1, -(-len(drawn) // parts))
    firsts = [least, *[k for k in drawn[step::step] if k > least]]
    bounds, wide = firsts[1:], max(1, round(len(firsts) ** 0.5))
    until = lambda keys: F.size(F.filter(keys, lambda b: b <= key))
    whole = until(_literal(bounds[wide - 1 :: wide])) * wide  # of splitters in groups that lie before the row
    out = rows.withColumn("whole", whole)
    out = out.withColumn("part", F.col("whole") + until(F.slice(_literal(bounds), F.col("whole") + 1, F.lit(wide)))).drop("whole")
    first = F.element_at(_literal(firsts), F.col("part") + 1) == key
    place = lambda part, guest: F.struct(part.cast("int").alias("part"), F.lit(guest).alias("guest"))
    own, before = place(F.col("part"), 0), place(F.pmod(F.col("part") - 1, F.lit(len(firsts))), 1)
    out = out.withColumn("to", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own)))).drop("part")
    return out.select(*rows.columns, "to.part", "to.guest")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 4, parts: int | None = None) -> DataFrame:
    """Rows (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one for each document."""
    parts = parts or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.select(F.col("id").isNull().alias("bare"), F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("tie"), "text")
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None  # part, id, text and fingerprint of the document that waits for the next
        for batch in batches:
            out: list[tuple] = []
            for part, bare, i, guest, data in zip(*(batch.column(n).to_pylist() for n in range(4)), batch.column(4)):
                if guest and (here is None or here[0] != part):
                    continue  # another row that ties with the first one
                data = data.as_py()
                now = data.decode("utf-8", "surrogateescape")
                mark = fingerprint(data)
                if here is not None and here[0] == part:
                    new = edited(here[2], now, share)
                    raw = new.encode("utf-8", "surrogateescape")
                    second = here[3] if new == here[2] else fingerprint(raw)
                    out.append((here[1], len(here[2]), hashlib.sha256(raw).hexdigest(), here[3], second, likeness(here[3], second), likeness(here[3], mark)))
                here = None if guest else (part, None if bare else i, now, mark)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * len(names), kinds)], names)

    dealt = _ranges(rows, parts).select("part", "bare", "id", "guest", "text", "tie").repartitionById(parts, F.pmod("part", F.lit(parts)))
    dealt = dealt.sortWithinPartitions("part", "guest", "bare", "id", "tie").drop("tie")
    return dealt.mapInArrow(compared, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
