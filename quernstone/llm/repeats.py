"""Windows that repeat across documents: what word-level and byte-level substring dedup share.

A window is a run of ``n`` symbols (words or bytes) of one document.  It is removed if
the same run starts in a document with a smaller id.  The windows are too many to be
exchanged, so they are found through anchors:

1. Texts are packed into blocks and dealt out by block once; all later steps read that
   exchange.  A text too long for one block's memory is a block of its own, of several
   parts that overlap by a window on either side.  Whole texts that a smaller id has too
   lose everything and are left out of what follows.  In each window of the others, the
   ``k``-gram with the smallest fingerprint (by its upper half, the same in every block) is
   its anchor (the leftmost, if equal).  Equal windows have their anchors at the same
   place, so an anchor that occurs in one context only rules out all of its windows.
2. Blocks send the fingerprints of their distinct anchors, four bytes each and a count of
   the contexts, by ranges of fingerprints, and get back which occur elsewhere.
3. The suffixes at shared anchors go, with the few symbols before them, to groups by that
   prefix, for which its 64-bit fingerprint stands in the sort keys, as 64 bits do for a
   word.  A prefix with very many contexts would make a large group: it is extended to the
   whole window, for which 128 bits stand.  Such windows are combined, several blocks at a
   time: only the smallest id is sent, the others are marked at once.  A passage found
   everywhere so costs a few bytes for each block or less.  Other equal contexts are sent
   once a block.
4. A group's ``solve`` puts its suffixes in order with their common prefix lengths (a
   suffix tree, or merged runs); per offset, windows with equal symbols on both sides of
   the anchor form a class, and those above the class's smallest id are marked.
5. Marks return to their blocks.

Groups, exchanges and blocks are as many as the bytes of text ask for, so none grows with
the input.

Rows with a null id neither remove nor lose anything.  Rows with the same id do not
remove each other's windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Fingerprints, byte_symbols, flatten, mix, word_hashes, word_spans

#: Bytes of text in a block, in a part of a longer text, in a group and in a partition; contexts of an anchor from which on its windows are dealt out one by one.
BLOCK, PART, GROUP, SHARE, HOT = 1 << 20, 4 << 20, 4 << 20, 64 << 20, 1000


@dataclass(frozen=True)
class Plan:
    """Window length n, anchor length k, whether symbols are words (else bytes)."""

    n: int
    k: int
    words: bool

    @property
    def offsets(self) -> int:
        return self.n - self.k + 1

    @property
    def width(self) -> int:
        """Bytes of a symbol in a sort key."""
        return 8 if self.words else 1

    @property
    def code(self) -> str:
        return ">u8" if self.words else "u1"


def packed(docs: DataFrame, key: str, text: str, n: int, part: int) -> DataFrame:
    """Rows (block, ids, texts) of about BLOCK bytes, dealt out by block to n partitions; a text above ``part`` bytes has a row of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list = []
        held = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | made]), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))],
                ["block", "ids", "texts"],
            )

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = b"" if (b := t.as_buffer()) is None else b.to_pybytes()
                if len(data) > part and ids:
                    yield row()
                    ids, texts, held, made = [], [], 0, made + 1
                ids.append(i)
                texts.append(data)
                held += len(data) + 16 + (BLOCK if len(data) > part else 0)
                if held >= BLOCK:
                    yield row()
                    ids, texts, held, made = [], [], 0, made + 1
        if ids:
            yield row()

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(pack, "block long, ids array<long>, texts array<binary>").repartition(n, "block")


class Block:
    """Symbols, anchors and distinct contexts of one block."""

    def __init__(self, ids: list, texts: list[bytes], plan: Plan, copies: list[int] | None = None, part: int = 0, core: tuple[int, int] | None = None, total: int = 0):
        """``copies``: rows whose whole text a smaller id has; ``core``: of a part of a text of ``total`` symbols, those that it answers for."""
        self.plan, self.texts, self.copies, self.part, self.core, self.total = plan, texts, copies or [], part, core, total
        self.flat, begins = flatten(texts)
        if plan.words:
            self.starts, self.ends = word_spans(self.flat)
            self.symbols = word_hashes(self.flat, self.starts, self.ends)
            self.lows = np.searchsorted(self.starts, begins[:-1])
            self.highs = np.searchsorted(self.starts, begins[1:])
        else:
            self.symbols = byte_symbols(self.flat)
            self.lows, self.highs = begins[:-1], begins[1:] - 1
        known = np.array([i is not None for i in ids], bool)
        known[self.copies] = False
        self.ids = np.array([i if i is not None else 0 for i in ids], np.int64)
        self._find(known)

    def _find(self, known: np.ndarray) -> None:
        n, k, w = self.plan.n, self.plan.k, self.plan.offsets
        prints = Fingerprints(self.symbols)
        grams = prints.grams(k)
        sizes = np.where(known, self.highs - self.lows - n + 1, 0)
        docs = np.flatnonzero(sizes > 0)
        if len(docs):
            bits = np.uint64((1 << 32) - 1)  # not by the block's size: equal windows have to choose alike in every block
            least = (grams & ~bits) | np.arange(len(grams), dtype=np.uint64)
            reach = 1
            while reach < w:
                step = min(reach, w - reach)
                least = np.minimum(least[:-step], least[step:]) if len(least) > step else least
                reach += step
            windows = np.repeat(self.lows[docs] - np.cumsum(sizes[docs]) + sizes[docs], sizes[docs]) + np.arange(sizes[docs].sum())
            at = np.unique((least[windows] & bits).astype(np.int64))
        else:
            at = np.zeros(0, np.int64)
        doc = np.searchsorted(self.highs, at, side="right")
        left = np.minimum(at - self.lows[doc], w - 1)
        right = np.minimum(self.highs[doc] - at, n)
        context = prints.spans(at - left, at + right) + mix(left.astype(np.uint64))
        gram = mix(grams[at])  # smallest fingerprints crowd at the low end; their groups should not
        order = np.lexsort((at, self.ids[doc], context, gram))
        self.at, self.doc, self.left, self.right = at[order], doc[order], left[order], right[order]
        gram, context = gram[order], context[order]
        new = np.ones(len(at), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
        #: Entry (distinct anchor and context) of each anchor place; first place of each entry, which has its smallest id.
        self.entry = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        gram = gram[self.first]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = gram[1:] != gram[:-1]
        self.gram_of, self.grams = np.cumsum(fresh) - 1, gram[fresh]
        self.contexts = np.diff(np.append(np.flatnonzero(fresh), len(gram)))
        self.prints = prints

    def ranges(self, hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) of sorted hashes by their top bits."""
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        bounds = [0, *cuts.tolist(), len(hashes)] if len(hashes) else [0]
        for a, b in zip(bounds, bounds[1:]):
            yield int(bucket[a]), a, b

    def codes(self) -> np.ndarray:
        """Symbols as they stand in sort keys."""
        return self.symbols.astype(">u8") if self.plan.words else self.flat

    def anchor_keys(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sort keys (the anchor's fingerprint, the symbols after it, those before it, nearest first), right and left lengths."""
        n, k, w = self.plan.n, self.plan.k, self.plan.offsets
        place = self.first[entries]
        at, left, right = self.at[place], self.left[place], self.right[place]
        codes = self.codes()
        after, before = (np.zeros((len(at), w - 1), codes.dtype) for _ in range(2))
        step = np.arange(w - 1)
        ok = k + step < right[:, None]
        after[ok] = codes[(at[:, None] + k + step)[ok]]
        ok = step < left[:, None]
        before[ok] = codes[(at[:, None] - 1 - step)[ok]]
        gram = self.grams[self.gram_of[entries]].astype(">u8")
        parts = [x.view(np.uint8).reshape(len(at), -1) for x in (gram, after, before)]
        return np.concatenate(parts, axis=1), right, left

    def windows(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and offset of every window around these entries' first anchors."""
        place = self.first[entries]
        offset = np.tile(np.arange(self.plan.offsets), len(place))
        place, entry = np.repeat(place, self.plan.offsets), np.repeat(entries, self.plan.offsets)
        ok = (offset <= self.left[place]) & (self.plan.n - offset <= self.right[place])
        return entry[ok], offset[ok]

    def removed(self, replies: list[tuple[bytes, bytes]]) -> np.ndarray:
        """Which symbols go, given the marks (entries, masks) that came back."""
        n, w = self.plan.n, self.plan.offsets
        mask = np.zeros(len(self.first), np.uint64)
        for entries, masks in replies:
            np.bitwise_or.at(mask, np.frombuffer(entries, np.uint32), np.frombuffer(masks, np.uint64))
        mask = mask[self.entry] if len(mask) else np.zeros(0, np.uint64)
        owner = self.ids[self.doc[self.first]][self.entry] if len(mask) else np.zeros(0, np.int64)
        later = self.ids[self.doc] > owner
        edge = np.zeros(len(self.symbols) + n + 1, np.int64)
        for o in range(w):
            hit = (later | ((mask >> np.uint64(o)) & np.uint64(1)).astype(bool)) & (o <= self.left) & (n - o <= self.right)
            start = np.unique(self.at[hit] - o)
            edge[start] += 1
            edge[start + n] -= 1
        gone = np.cumsum(edge)[: len(self.symbols)] > 0
        for row in self.copies:
            if max(self.highs[row] - self.lows[row], self.total) >= n:
                gone[self.lows[row] : self.highs[row]] = True
        return gone


def parts_of(row: dict, plan: Plan, size: int) -> Iterator[Block]:
    """The block of a row; of a text above ``size`` bytes, its parts in order.

    A part's core is preceded by n symbols and followed by n - 1, so it holds every window
    that covers a symbol of the core or the one before it.
    """
    if len(row["texts"]) != 1 or len(row["texts"][0]) <= size:
        yield Block(row["ids"], row["texts"], plan, row["copies"])
        return
    text, n = row["texts"][0], plan.n
    if plan.words:
        starts, ends = word_spans(np.frombuffer(text, np.uint8))
        total, step = len(starts), max(1, int(len(starts) * size / len(text)))
    else:
        total, step = len(text), size
    for part, low in enumerate(range(0, max(1, total), step)):
        high = min(total, low + step)
        a, b = max(0, low - n), min(total, high + n - 1)
        cut = text[int(starts[a]) if a < total else 0 : int(ends[b - 1]) if b else 0] if plan.words else text[a:b]
        yield Block(row["ids"], [cut], plan, row["copies"], part, (low - a, high - a), total)


def marks(classes: Callable[[int], tuple[np.ndarray, np.ndarray]], right: np.ndarray, left: np.ndarray, before: np.ndarray, ids: np.ndarray, n: int, k: int) -> np.ndarray:
    """For suffixes in order: a mask of the offsets whose window has a smaller id.

    ``classes`` gives, for a length, the places of suffixes that share so many symbols with
    another one, and the number of the class of each.
    """
    mask = np.zeros(len(ids), np.uint64)
    behind = np.zeros(len(ids), np.uint64)
    for o in range(n - k + 1):
        if o:
            behind = mix(behind + before[:, o - 1].astype(np.uint64) + np.uint64(1))
        places, node = classes(n - o)
        able = (right[places] >= n - o) & (left[places] >= o)
        ok, node = places[able], node[able].astype(np.uint64)
        if len(ok) < 2:
            continue
        key = mix(mix(node) * np.uint64(3) + behind[ok])
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        least = np.minimum.reduceat(ids[ok][order], first)
        least = np.repeat(least, np.diff(np.append(first, len(key))))
        mask[ok[order][ids[ok][order] > least]] |= np.uint64(1 << o)
    return mask


def runs_of(lcp: np.ndarray) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
    """Classes of sorted suffixes: runs of neighbours that share a length."""
    keep = np.arange(len(lcp))
    return lambda length: (keep, np.cumsum(lcp < length))


def least_ids(w1: np.ndarray, w2: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window, by its two fingerprints, the smallest id that it is given with."""
    order = np.lexsort((ids, w2, w1))
    a, b = w1[order], w2[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    out = np.empty(len(ids), np.int64)
    out[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _copies(blocks: DataFrame) -> DataFrame:
    """By block, the rows whose whole text a smaller id has."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = batch.column(2)[i].as_py()
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), np.int64).reshape(-1, 2)
                block = pa.array([batch.column(0)[i].as_py()] * len(texts), pa.int64())
                ids = pa.array(batch.column(1)[i].as_py(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0]), pa.array(digest[:, 1]), ids, block, pa.array(range(len(texts)), pa.int32())], ["h1", "h2", "id", "block", "row"])

    rows = blocks.mapInArrow(hashes, "h1 long, h2 long, id long, block long, row int")
    least = rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(least, ["h1", "h2"]).filter("id > least").groupBy("block").agg(F.collect_list("row").alias("copies"))


#: A group's rows, the bytes of a sort key, and how many symbols so many shared bytes mean -> (order, classes by length, sort keys in order).
Solve = Callable[[pd.DataFrame, int, Callable[[np.ndarray], np.ndarray]], tuple[np.ndarray, Callable, np.ndarray]]
#: Sorts the keys of one block's part of a group -> (order, columns to send).
Code = Callable[[np.ndarray], tuple[np.ndarray, dict[str, bytes]]]

_SENT = "bucket long, kind int, block long, part int, head binary, body binary, rights binary, lefts binary, ids binary, refs binary, offs binary"
_FOUND = "block long, part int, entries binary, masks binary"
#: Hot windows that a task combines at a time.
HELD = 1 << 17


def find(docs: DataFrame, plan: Plan, code: Code, solve: Solve, finish: Callable, result: str, key: str, text: str, hot: int = HOT, part: int = PART) -> DataFrame:
    """All documents with what ``finish(ids, [(part, removed)])`` makes of the parts of a block."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))
    bits = max(4, (max(4 * shares, size // GROUP) - 1).bit_length())
    dealt = packed(docs, key, text, shares, part)
    # Left joins: an inner one would filter the blocks below their exchange, which then could not be used again.
    blocks = dealt.join(_copies(dealt).hint("shuffle_hash"), "block", "left")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}

    def offer(batches):
        for row in rows_of(batches):
            for b in parts_of(row, plan, part):
                got: dict[str, list] = {"bucket": [], "block": [], "part": [], "low": [], "contexts": []}
                low = ((b.grams << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                count = np.minimum(b.contexts, 255).astype(np.uint8)
                for bucket, i, j in b.ranges(b.grams, bits):
                    for name, value in zip(got, (bucket, row["block"], b.part, low[i:j].tobytes(), count[i:j].tobytes())):
                        got[name].append(value)
                yield pa.RecordBatch.from_pydict(got, pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("low", pa.binary()), ("contexts", pa.binary())]))

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.low])
        count = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.contexts])
        _, which = np.unique(low, return_inverse=True)
        total = np.bincount(which, count)[which]
        state = (total > 1).astype(np.uint8) + (total > hot)
        cuts = np.cumsum([len(x) // 4 for x in rows.low])[:-1]
        return pd.DataFrame({"block": rows.block, "part": rows.part, "bucket": rows.bucket, "state": [x.tobytes() for x in np.split(state, cuts)]})

    offered = blocks.mapInArrow(offer, "bucket long, block long, part int, low binary, contexts binary").repartition(shares, "bucket")
    answers = offered.groupBy("bucket").applyInPandas(answer, "block long, part int, bucket long, state binary")
    answers = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "bucket", "state"))).alias("states"))

    def send(batches):
        held: list[dict[str, np.ndarray]] = []  # hot windows of several blocks
        for row in rows_of(batches):
            for b in parts_of(row, plan, part):
                state = np.frombuffer(b"".join(x["state"] for x in row["states"] or [] if x["part"] == b.part), np.uint8)[b.gram_of]
                yield from send_suffixes(row["block"], b, np.flatnonzero(state == 1))
                if (state == 2).any():
                    held.append(hot_windows(row["block"], b, np.flatnonzero(state == 2)))
                if sum(len(h["w1"]) for h in held) > HELD:
                    yield send_windows(held)
                    held = []
        if held:
            yield send_windows(held)

    def table(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        named = [c.split() for c in _SENT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r.get(n, b"") for r in rows], kinds[k]) for n, k in named], [n for n, _ in named])

    def send_suffixes(block: int, b: Block, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(entries):
            return
        keys, right, left = b.anchor_keys(entries)
        rows = []
        for bucket, i, j in b.ranges(b.grams[b.gram_of[entries]], bits):
            order, coded = code(keys[i:j])
            own = entries[i:j][order]
            given = {"rights": right[i:j][order].astype(np.uint8), "lefts": left[i:j][order].astype(np.uint8), "ids": b.ids[b.doc[b.first[own]]], "refs": own.astype(np.uint32)}
            rows.append({"bucket": bucket, "kind": 0, "block": block, "part": b.part} | coded | {k: v.tobytes() for k, v in given.items()})
        yield table(rows)

    def hot_windows(block: int, b: Block, entries: np.ndarray) -> dict[str, np.ndarray]:
        entry, offset = b.windows(entries)
        start = b.at[b.first[entry]] - offset
        more = Fingerprints(mix(b.symbols + np.uint64(1)))
        return {
            "w1": b.prints.spans(start, start + plan.n), "w2": more.spans(start, start + plan.n), "ids": b.ids[b.doc[b.first[entry]]],
            "block": np.full(len(entry), block), "part": np.full(len(entry), b.part), "refs": entry.astype(np.uint32), "offs": offset.astype(np.uint8),
        }

    def send_windows(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        """Rows with a smaller id here are marked (kind 2), the others ask for the smallest id of all (kind 1)."""
        all_ = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        late = all_["ids"] > least_ids(all_["w1"], all_["w2"], all_["ids"])
        bucket = np.where(late, all_["block"] % (1 << bits), (all_["w1"] >> np.uint64(64 - bits)).astype(np.int64))
        order = np.lexsort((all_["part"], all_["block"], bucket, late))
        key = np.stack([late[order], bucket[order], all_["block"][order], all_["part"][order]])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        rows = []
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
            at = order[i:j]
            given = {"refs": all_["refs"], "offs": all_["offs"]} | ({} if late[at[0]] else {"head": all_["w1"], "body": all_["w2"], "ids": all_["ids"]})
            rows.append({"bucket": int(bucket[at[0]]), "kind": 2 if late[at[0]] else 1, "block": int(all_["block"][at[0]]), "part": int(all_["part"][at[0]])} | {k: v[at].tobytes() for k, v in given.items()})
        return table(rows)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        whole = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in rows[name]])
        refs, kind = whole("refs", np.uint32), rows.kind.iloc[0]
        if kind:
            back = np.uint64(1) << whole("offs", np.uint8).astype(np.uint64)
            if kind == 1:
                ids = whole("ids", np.int64)
                back[ids <= least_ids(whole("head", np.uint64), whole("body", np.uint64), ids)] = 0
        else:
            w, k = plan.offsets, plan.k
            order, classes, keys = solve(rows, 8 + 2 * (w - 1) * plan.width, lambda lcp: np.minimum(np.where(lcp < 8, 0, k + (lcp - 8) // plan.width), plan.n))
            before = np.ascontiguousarray(keys[:, keys.shape[1] - (w - 1) * plan.width :]).view(plan.code)
            back = np.zeros(len(refs), np.uint64)
            back[order] = marks(classes, whole("rights", np.uint8)[order], whole("lefts", np.uint8)[order], before, whole("ids", np.int64)[order], plan.n, k)
        cuts = np.cumsum([len(x) // 4 for x in rows.refs])[:-1]
        out = [(block, at, r[m > 0].tobytes(), m[m > 0].tobytes()) for block, at, r, m in zip(rows.block, rows.part, np.split(refs, cuts), np.split(back, cuts)) if m.any()]
        return pd.DataFrame(out, columns=["block", "part", "entries", "masks"])

    asked = blocks.join(answers.hint("shuffle_hash"), "block", "left")
    sent = asked.mapInArrow(send, _SENT).repartition(shares, "kind", "bucket")
    found = sent.groupBy("kind", "bucket").applyInPandas(group, _FOUND)
    found = found.groupBy("block").agg(F.collect_list(F.struct("part", "entries", "masks")).alias("marks"))

    def last(batches):
        for row in rows_of(batches):
            done = []
            for b in parts_of(row, plan, part):
                done.append(finish(b, row["ids"], b.removed([(m["entries"], m["masks"]) for m in row["marks"] or [] if m["part"] == b.part])))
            yield done[0] if len(done) == 1 else joined(done)

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """One row of the parts of a text: sums, and the kept pieces one after the other."""
        kept = [p.column(4)[0].as_py() for p in parts]
        if plan.words:
            kept = [" ".join(x for x in kept if x)]
        else:
            kept = [b"".join(kept)]
        sums = [pa.array([sum(p.column(i)[0].as_py() for p in parts)], pa.int64()) for i in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([parts[0].column(0), *sums, pa.array(kept, parts[0].schema.field(4).type)], parts[0].schema.names)

    return blocks.join(found.hint("shuffle_hash"), "block", "left").mapInArrow(last, result)
