"""Line dedup by a deletion-neighbourhood join.

A line is removed if an earlier line (by document id, then line number) is within its edit
bound.  The bound grows with the line: none for lines shorter than ``least`` characters, of which only the
same line is a copy ("17" and "18" are two lines), and one edit from there on: a character put in,
taken out or changed.  Lines are compared without white space at either end; every line that
is not blank is judged.

1. Each distinct line is known by a hash, its earliest place and four keys.  Two lines one
   edit apart share the first or the last half of the shorter one's length, so keys that
   only one line has rule that line out.
2. The other lines emit their neighbourhood: themselves and all variants with one
   character deleted outside the shared half, as hashes.  Lines with the same variant by
   the same deleted place differ in that character; a line that is another's variant
   lacks one character.  Per variant the earliest line is found by an aggregation, never
   by forming pairs.
3. Each line's earliest partner is verified by edit distance; the earliest line stays.

Defined results: a null text stays null.  Rows with null ids come last, in an order of
their texts' hashes, each text by itself.  Rows that share an id (or, without one, a text)
are judged as one document: the same line at the same number stays or goes in all of
them.  A text whose lines all go becomes empty; judging is on the input.  Columns of the
input keep their names; if it has an ``n_lines`` or ``n_removed``, the new one gets an
underscore more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import sliced, unused, written
from .tokens import Fingerprints, mix

#: Lines of fewer characters have an edit bound of zero.  Lines with shared halves up to which their list is broadcast (some 50 bytes each).
LEAST, BROADCAST = 12, 200_000

_SPACE = " \t\n\v\f\r"


def _judged(text: str | None, least: int) -> Iterator[tuple[int, str]]:
    """(line number, line without white space at its ends) of the lines that are judged."""
    for number, line in enumerate(text.split("\n") if text else ()):
        line = line.strip(_SPACE)
        if len(line) >= least:
            yield number, line


def _distinct(late: list, ids: list, texts: list, least: int) -> dict[bytes, tuple[tuple[bool, int, int], str]]:
    """By 128-bit hash, the earliest place (late, id, number) and the line."""
    found: dict[bytes, tuple[tuple[bool, int, int], str]] = {}
    for after, id_, text in zip(late, ids, texts):
        for number, line in _judged(text, least):
            digest = xxhash.xxh3_128_digest(line.encode())
            place = (after, id_, number)
            if digest not in found or place < found[digest][0]:
                found[digest] = (place, line)
    return found


def _halves(line: str) -> list[int]:
    """Keys of the first and last half, for this length and for one less."""
    n, out = len(line), []
    for size in (n, n - 1):
        for half, part in (("first", line[: size // 2]), ("last", line[n - (size - size // 2) :])):
            out.append(xxhash.xxh64_intdigest(f"{size} {half} {part}".encode()) - (1 << 63))
    return out


def _variants(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the line (place -1) and of the line without each of its characters, with the places."""
    code = mix(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    prints = Fingerprints(code)
    whole = prints.spans(np.zeros(1, np.int64), np.full(1, len(code)))
    return np.concatenate((whole, prints.without_each())), np.arange(-1, len(code))


def _first_hash(line: str) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(line.encode())[:8], "little", signed=True)


_PLACE = "late boolean, id long, number int, h1 long"


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, exact: int = 1) -> DataFrame:
    """``docs`` with the lines taken out of its text, and columns n_lines and n_removed; lines of fewer than ``exact`` characters are left alone."""
    exact = max(1, min(exact, least))
    names = [f"c{i}" for i in range(len(docs.columns))]  # names may clash with those used here
    key_at, text_at = names[docs.columns.index(key)], names[docs.columns.index(text)]
    rows = docs.toDF(*names).withColumn(key_at, F.col(key_at).cast("long"))
    # Without an id, a text's hash stands for it, so that no list of lines is of more than one document.
    place_of = [F.col(key_at).isNull().alias("late"), F.coalesce(F.col(key_at), F.xxhash64(F.col(text_at))).alias("id")]
    texts = rows.select(*place_of, F.col(text_at).alias("text"))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2048):
            found = _distinct(*(batch.column(i).to_pylist() for i in range(3)), exact)
            digest = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            late, ids, numbers = zip(*[v[0] for v in found.values()]) if found else ((), (), ())
            halves = pa.array([_halves(v[1]) if len(v[1]) >= least else [] for v in found.values()], pa.list_(pa.int64()))
            columns = [pa.array(late, pa.bool_()), pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), halves]
            yield pa.RecordBatch.from_arrays(columns, ["late", "id", "number", "h1", "h2", "halves"])

    place = F.struct("late", "id", "number", "h1")
    offered = texts.mapInArrow(offer, f"{_PLACE}, h2 long, halves array<long>")
    distinct = offered.groupBy("h1", "h2").agg(F.min(F.struct("late", "id", "number")).alias("p"), F.first("halves").alias("halves"))
    distinct = written(distinct.select("p.*", "h1", "halves"))

    keyed = distinct.select(*[c.split()[0] for c in _PLACE.split(", ")], F.posexplode("halves").alias("which", "half"))
    shared = keyed.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("half")
    asked = keyed.join(shared, "half").groupBy("late", "id", "number", "h1").agg(F.collect_set("which").alias("which"))
    asked = written(asked.groupBy("late", "id").agg(F.collect_list(F.struct("number", "h1", "which")).alias("asked")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                late, id_, lines = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py().split("\n")
                for w in batch.column(3)[i].as_py():
                    line = lines[w["number"]].strip(_SPACE) if w["number"] < len(lines) else ""
                    if len(line) < least or _first_hash(line) != w["h1"]:
                        continue  # the line of another row with this id
                    hashes, at = _variants(line)
                    n, rest = len(line), (len(line) - 1) // 2
                    open_ = at < 0
                    if {0, 2} & set(w["which"]):
                        open_ |= at >= rest
                    if {1, 3} & set(w["which"]):
                        open_ |= at <= n - (n - 1 - rest)
                    hashes, at = hashes[open_], at[open_]
                    fill = lambda v, kind: pa.repeat(pa.scalar(v, kind), len(at))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes.view(np.int64)), pa.array(at.astype(np.int32)), fill(late, pa.bool_()), fill(id_, pa.int64()), fill(w["number"], pa.int32()), fill(w["h1"], pa.int64()), pa.array([line] + [None] * (len(at) - 1), pa.string())],
                        ["variant", "at", "late", "id", "number", "h1", "line"],
                    )

    few = (asked.agg(F.sum(F.size("asked"))).first()[0] or 0) <= BROADCAST
    met = texts.filter("text is not null").join(F.broadcast(asked) if few else asked, ["late", "id"])
    near = written(met.select("late", "id", "text", "asked").mapInArrow(spread, f"variant long, at int, {_PLACE}, line string"))
    several = near.groupBy("variant").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("variant")
    near_again = written(near.select("variant", "at", place.alias("place")).join(several, "variant"))
    changed = near_again.filter("at >= 0").groupBy("variant", "at").agg(F.min("place").alias("partner"))
    shorter, longer = (F.min(F.when(c, F.col("place"))) for c in (F.col("at") < 0, F.col("at") >= 0))
    by_length = near_again.groupBy("variant").agg(shorter.alias("shorter"), longer.alias("longer"))
    earlier = near_again.join(changed, ["variant", "at"]).select("place", "partner")
    lacking = near_again.join(by_length, "variant").select("place", F.when(F.col("at") < 0, F.col("longer")).otherwise(F.col("shorter")).alias("partner"))
    pairs = earlier.unionByName(lacking).filter("partner < place").groupBy("place").agg(F.min("partner").alias("partner"))
    lines = near.filter("line is not null").select(place.alias("place"), "line")
    pairs = pairs.join(lines, "place").join(lines.select(F.col("place").alias("partner"), F.col("line").alias("other")), "partner")
    close = written(pairs.filter(F.levenshtein("line", "other", 1) >= 0).select("place.*"))

    kept = distinct.select("late", "id", "number", "h1").join(close, ["late", "id", "number", "h1"], "left_anti")
    kept = kept.groupBy("late", "id").agg(F.collect_list(F.struct("number", "h1")).alias("kept"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out, total, gone = [], [], []
            for value, stay in zip(batch.column(text_at).to_pylist(), batch.column("kept")):
                stay = set(zip(*(c.to_pylist() for c in stay.values.flatten()))) if stay.is_valid else ()
                all_ = [] if value is None else value.split("\n")
                bare = [line.strip(_SPACE) for line in all_]
                left = [x for k, (x, b) in enumerate(zip(all_, bare)) if len(b) < exact or (k, _first_hash(b)) in stay]
                out.append(None if value is None else "\n".join(left))
                total.append(len(all_))
                gone.append(len(all_) - len(left))
            columns = {n: batch.column(n) for n in names} | {text_at: pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*columns, "n_lines", "n_removed"])

    joined = rows.select("*", *place_of).join(kept.hint("shuffle_hash"), ["late", "id"], "left").drop("late", "id")
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in rows.schema), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    more = [unused(n, docs.columns) for n in ("n_lines", "n_removed")]
    return joined.mapInArrow(rebuild, schema).toDF(*docs.columns, *more)
