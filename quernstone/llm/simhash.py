"""SimHash near-duplicates found with BK-trees.

Equal fingerprints collapse to one.  Fingerprints at distance r or less agree on at
least one of r + 1 bit blocks, so each goes to one shard for each block; a shard too
large for one tree is dealt out again by blocks of its other bits.  In a shard, a
BK-tree (children keyed by their Hamming distance to the parent) is searched for the
neighbours of each fingerprint before that is inserted, along the edges within the
radius only.  A shard emits a spanning forest of its links, never all pairs.

``near_copies`` adds links at a shingle similarity (Jaccard), which differs in far more
bits than a tree's radius can cover: texts that share a band of minimum hashes are
candidates, and the shingles of both are compared exactly.

Defined results: null and empty texts, and texts of white space, have fingerprint
zero; equal rows stay separate rows; rows with a null id take part, but a component's
id is the smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .store import saved, sliced
from .tokens import mix

#: Fingerprints of a shard from which on it is dealt out again.
SHARD = 1024
#: Bands of so many minimum hashes each; texts of a band that meet its others in the first round.  At a similarity of
#: 0.8 a pair shares no band with a probability of (1 - 0.8**4)**20, 0.00003.
BANDS, BAND, LEADERS = 20, 4, 4
#: Times as many leaders in each further round; texts to compare up to which their hashes are broadcast.
FASTER, BROADCAST = 64, 100_000
#: Bits of a text's parities: as many as a text has shingles, or so; longer texts are told apart less well, but rightly.
PARITIES = 512
#: Odd multipliers: one order of all hashes each.
_SEEDS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(text: str | None, words: int, lower: bool) -> np.ndarray:
    """64-bit hashes of the shingles of ``words`` words, of the whole text if it has fewer."""
    data = (text or "").encode()
    parts = (data.lower() if lower else data).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    spans = zip(starts[:n].tolist(), ends[len(parts) - n :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)


def _simhash(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _parities(hashes: np.ndarray) -> list[int]:
    """The parities of how many of a set of hashes fall on each of ``PARITIES`` bits.

    A shingle that only one of two sets has turns one bit, so two sets differ in at least as many shingles as their parities in bits.
    """
    odd = np.bincount((mix(hashes) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").tolist()


def _bands(hashes: np.ndarray) -> list[int]:
    """A hash for each band of minimum hashes; none for no shingles."""
    if not len(hashes):
        return []
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1 << 10):
        least = np.minimum(least, (hashes[at : at + (1 << 10), None] * _SEEDS).min(axis=0))
    return [xxhash.xxh64_intdigest(band.tobytes()) - (1 << 63) for band in least.reshape(BANDS, BAND)]


def fingerprint(text: Column | str, words: int = 3, lower: bool = True) -> Column:
    """64-bit SimHash of the shingles of ``words`` words, as a signed long."""

    def of(text: str | None) -> int:
        return _simhash(_hashes(text, words, lower))

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in sliced(batches):
            yield pa.array([of(t.as_py()) for t in part], pa.int64())

    return simhash(text)


def hex16(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class BKTree:
    """Children keyed by integer Hamming distance to their parent."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> list[int]:
        """Adds a value; gives the places of the earlier values within the radius."""
        at, near, r = len(self.values), [], self.radius
        if at:
            stack, down = [0], 0
            while stack:
                node = stack.pop()
                d = (self.values[node] ^ value).bit_count()
                if d <= r:
                    near.append(node)
                kids = self.children[node]
                if len(kids) <= 2 * r + 1:
                    stack += [c for k, c in kids.items() if d - r <= k <= d + r]
                else:
                    stack += [kids[k] for k in range(d - r, d + r + 1) if k in kids]
            while True:
                d = (self.values[down] ^ value).bit_count()
                if d not in self.children[down]:
                    self.children[down][d] = at
                    break
                down = self.children[down][d]
        self.values.append(value)
        self.children.append({})
        return near


def _forest(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    tree, root = BKTree(radius), list(range(len(values)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, v in enumerate(values):
        for j in tree.insert(v):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                yield i, j


def _blocks(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    cuts = [low + (high - low) * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def _field(fp: Column, low: int, high: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def near_links(fps: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (a, b) that connect all fingerprints within the radius."""
    blocks = _blocks(0, 64, radius + 1)
    keyed = fps.select("fp", F.posexplode(F.array(*[_field(F.col("fp"), a, b) for a, b in blocks])).alias("block", "v"))
    large = keyed.groupBy("block", "v").count().filter(F.col("count") > shard).select("block", "v", F.lit(True).alias("large"))
    keyed = keyed.join(large, ["block", "v"], "left")
    # The other bits as one number: those below the block, and those above it shifted down.
    rest = F.lit(None).cast("long")
    for i, (a, b) in enumerate(blocks):
        low = F.col("fp").bitwiseAND(F.lit((1 << a) - 1))
        high = F.shiftleft(F.shiftrightunsigned("fp", b), a) if b < 64 else F.lit(0).cast("long")
        rest = F.when(F.col("block") == i, low.bitwiseOR(high)).otherwise(rest)
    width = 64 - max(b - a for a, b in blocks)
    again = F.array(*[F.concat(F.lit(f"{i}:"), _field(rest, a, b).cast("string")) for i, (a, b) in enumerate(_blocks(0, width, radius + 1))])
    keyed = keyed.withColumn("sub", F.explode(F.when(F.col("large"), again).otherwise(F.array(F.lit("")))))
    keyed = keyed.select(F.xxhash64("block", "v", "sub").alias("shard"), "fp")
    dealt = keyed.repartition("shard").sortWithinPartitions("shard", "fp")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(shards: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(shards[1:] != shards[:-1]) + 1
            bounds = np.concatenate(([0], cuts, [len(shards)])) if len(shards) else np.zeros(1, int)
            left: list[int] = []
            right: list[int] = []
            for k in np.flatnonzero(np.diff(bounds) > 1):
                signed = np.unique(fps[bounds[k] : bounds[k + 1]])
                for i, j in _forest(signed.view(np.uint64).tolist(), radius):
                    left.append(signed[i])
                    right.append(signed[j])
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

        held_s, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            s = np.concatenate((held_s, batch.column(0).to_numpy(zero_copy_only=False)))
            f = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False)))
            whole = np.searchsorted(s, s[-1]) if len(s) else 0  # the last shard may go on in the next batch
            yield links(s[:whole], f[:whole])
            held_s, held_f = s[whole:], f[whole:]
        yield links(held_s, held_f)

    return dealt.mapInArrow(trees, "a long, b long")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, radius: int = 3, lower: bool = True, shard: int = SHARD
) -> DataFrame:
    """One row for each document: its id, fp (long) and component_id, the smallest id it reaches by links."""
    fps = saved(docs.select(F.col(key), fingerprint(F.col(text), words, lower).alias("fp")))
    distinct = fps.groupBy("fp").agg(F.min(key).alias("least"))
    linked = components(near_links(distinct.select("fp"), radius, shard)).select(F.col("id").alias("fp"), "component")
    classes = saved(distinct.join(linked, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(classes.select("fp", "component"), "fp").join(least, "component").select(key, "fp", "component_id")


def _shingles(asked: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, lower: bool) -> DataFrame:
    """Text hashes (h) -> (h, s), s the set of the text's shingles."""

    @F.arrow_udf("array<long>")
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in sliced(batches):
            yield pa.array([np.unique(_hashes(t.as_py(), words, lower)).view(np.int64) for t in part], pa.list_(pa.int64()))

    asked = saved(asked.join(nodes.select("h", "least"), "h").select(F.col("h").alias("_h"), F.col("least").alias("_of")))
    few = asked.count() <= BROADCAST
    found = texts.join(F.broadcast(asked) if few else asked, F.col("id").eqNullSafe(F.col("_of")) & (F.xxhash64("text") == F.col("_h"))).dropDuplicates(["_h"])
    return saved(found.select(F.col("_h").alias("h"), shingles("text").alias("s")))


def _shared(left: DataFrame, sets: DataFrame) -> DataFrame:
    """(h, shared): how many of a text's shingles a text of another component has too."""
    each = left.select("h", "component").distinct().join(sets, "h").select("h", "component", F.explode("s").alias("x"))
    common = each.groupBy("x").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q").select("x")
    return each.join(common, "x").groupBy("h").agg(F.count("*").alias("shared"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of text hashes, those whose sets of shingles are at least so similar."""
    of = lambda side: sets.select(F.col("h").alias(side), F.col("s").alias(f"s_{side}"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(common >= similarity * (F.size("s_a") + F.size("s_b") - common)).select("a", "b")


def _apart(banded: DataFrame, linked: DataFrame) -> DataFrame:
    """The texts of bands that hold more than one component, with their component and its size in the band."""
    now = banded.join(linked.select(F.col("id").alias("h"), "component"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    here = now.groupBy("band", "v", "component").agg(F.count("*").alias("size"))
    mixed = here.groupBy("band", "v").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q").select("band", "v")
    return saved(now.join(here.join(mixed, ["band", "v"], "left_semi"), ["band", "v", "component"]))


def _linked(nodes: DataFrame, links: DataFrame, texts: DataFrame, words: int, similarity: float, lower: bool, leaders: int) -> DataFrame:
    """Nodes (h, least, n, bands) and links (a, b) -> components (id, component) with links at the similarity too.

    Texts that share a band and no component yet are candidates.  In each round the first few
    of a band's texts, those of its smallest components first, meet all its texts of other
    components and leave; ``FASTER`` times as many in the next round.  A band is done when all it has left
    are of one component, so no link between components is missed and few pairs are formed
    where copies are many.

    Two sets of a and b shingles can only be similar if they have similarity / (1 + similarity) * (a + b)
    in common, and neither has more in common with the other than with all texts of other
    components.  That rules out exactly, before they meet, the texts whose own edits set them apart.  Of
    the rest, two only meet if their parities differ in no more bits than sets so similar can differ
    in shingles; what is left are pairs that are as similar as asked, or nearly.
    """
    banded = nodes.select("h", "n", "parities", F.posexplode("bands").alias("band", "v"))
    several = banded.groupBy("band", "v").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("band", "v")
    linked = saved(components(links))
    left = _apart(saved(banded.join(several, ["band", "v"], "left_semi")), linked)
    if left.isEmpty():
        return linked
    sets = _shingles(left.select("h").distinct(), nodes, texts, words, lower)
    enough = lambda common, a, b: common * (1 + similarity) >= similarity * (a + b) - 1e-6
    kept = ["band", "v", "h", "n", "shared", "parities"]
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    differ = lambda a, b: (a + b) * ((1 - similarity) / (1 + similarity)) + 1e-6
    left = left.join(_shared(left, sets), "h").filter(enough(F.col("shared"), F.col("n"), similarity * F.col("n"))).select(*kept)
    left = _apart(saved(left), linked)
    while not left.isEmpty():
        order = W.partitionBy("band", "v").orderBy("size", F.desc(F.col("shared") / F.col("n")), "component", "h")
        first = left.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= leaders)
        first = saved(first.select("band", "v", F.col("h").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("shared_a"), F.col("parities").alias("parities_a"), F.col("component").alias("of_a")))
        met = left.join(first, ["band", "v"]).filter("component <> of_a").filter(F.least("n", "n_a") >= similarity * F.greatest("n", "n_a"))
        met = met.filter(enough(F.least("shared", "shared_a"), F.col("n"), F.col("n_a")))
        met = met.filter(apart("parities", "parities_a") <= differ(F.col("n"), F.col("n_a")))
        pairs = saved(met.select(F.least("a", "h").alias("a"), F.greatest("a", "h").alias("b")).distinct())
        links = saved(links.unionByName(_verified(pairs, sets, similarity)))
        linked = saved(components(links))
        left = left.select(*kept).join(first.select("band", "v", F.col("a").alias("h")), ["band", "v", "h"], "left_anti")
        left = _apart(left, linked)
        leaders *= FASTER
    return linked


def near_copies(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, radius: int = 3, similarity: float = 0.8, lower: bool = True,
    shard: int = SHARD, leaders: int = LEADERS,
) -> DataFrame:
    """As ``near_duplicates``, with links also between documents whose sets of shingles have a Jaccard similarity from ``similarity`` on.

    Distinct texts are told apart by a 64-bit hash.  ``leaders`` changes the route, not the result.
    """

    @F.arrow_udf("struct<fp long, n int, bands array<long>, parities array<long>>")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in sliced(batches):
            hashes = [_hashes(t.as_py(), words, lower) for t in part]
            sets = [np.unique(h) for h in hashes]
            lists = [pa.array([f(x) for x in of], pa.list_(pa.int64())) for f, of in ((_bands, hashes), (_parities, sets))]
            columns = [pa.array([_simhash(h) for h in hashes], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), *lists]
            yield pa.StructArray.from_arrays(columns, ["fp", "n", "bands", "parities"])

    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = saved(texts.select("id", F.xxhash64("text").alias("h"), prints("text").alias("p")).select("id", "h", "p.*"))
    nodes = saved(rows.groupBy("h").agg(F.min("id").alias("least"), F.first(F.struct("fp", "n", "bands", "parities")).alias("p")).select("h", "least", "p.*"))
    prime = saved(nodes.groupBy("fp").agg(F.min("h").alias("h")))
    of = lambda side: prime.select(F.col("fp").alias(side), F.col("h").alias(f"h_{side}"))
    near = near_links(prime.select("fp"), radius, shard).join(of("a"), "a").join(of("b"), "b").select(F.col("h_a").alias("a"), F.col("h_b").alias("b"))
    same = nodes.select("fp", F.col("h").alias("a")).join(prime, "fp").filter("a <> h").select("a", F.col("h").alias("b"))
    linked = _linked(nodes, saved(near.unionByName(same)), texts, words, similarity, lower, leaders)
    classes = nodes.join(linked.select(F.col("id").alias("h"), "component"), "h", "left").select("h", "least", F.coalesce("component", "h").alias("component"))
    classes = saved(classes)
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.select(F.col("id").alias(key), "h", "fp").join(classes.select("h", "component"), "h").join(least, "component").select(key, "fp", "component_id")
