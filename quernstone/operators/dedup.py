"""Document dedup by keys and by similar titles, and what survives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written


def canonical_by(df: DataFrame, key: Column, id_: str = "doc_id") -> DataFrame:
    """``df`` with canonical_id (the smallest id of its key, itself without a key) and is_duplicate."""
    least = F.when(key.isNotNull(), F.min(id_).over(W.partitionBy(key)))
    out = df.withColumn("canonical_id", F.coalesce(least, F.col(id_)))
    return out.withColumn("is_duplicate", F.col("canonical_id") < F.col(id_))


def soft_dedup(df: DataFrame, keys: list[str], id_: str = "doc_id") -> DataFrame:
    """Passes over several keys; a row is matched by the first key that links it to a smaller id."""
    out = df.withColumn("canonical_id", F.lit(None).cast("long"))
    for k in keys:
        least = F.min(id_).over(W.partitionBy(k))
        out = out.withColumn("canonical_id", F.when(F.col("canonical_id").isNull() & F.col(k).isNotNull() & (least < F.col(id_)), least).otherwise(F.col("canonical_id")))
    return out.withColumn("is_duplicate", F.col("canonical_id").isNotNull())


def exact_groups(df: DataFrame, doi: str = "doi", pmid: str = "pmid", title: str = "title", id_: str = "id") -> DataFrame:
    """Groups (id, pass, group_key) of two or more by DOI, then PMID, then title; earlier passes use up ids."""
    rows = df.select(id_, T.normalize_doi(F.col(doi)).alias("doi"), F.trim(F.col(pmid)).alias("pmid"), T.title_hash(F.col(title)).alias("title"))
    found, left = None, rows
    for name in ("doi", "pmid", "title"):
        keyed = left.filter(F.col(name).isNotNull() & (F.col(name) != ""))
        n = F.count("*").over(W.partitionBy(name))
        hit = keyed.withColumn("_n", n).filter("_n > 1").select(id_, F.lit(name).alias("pass"), F.col(name).alias("group_key"))
        found = hit if found is None else found.unionByName(hit)
        left = left.join(hit.select(id_), id_, "left_anti")
    return found


#: Characters that meet in a task from one side, and what a title counts besides its own; pairs looked at, and characters passed on, at a time.
STRETCH, EACH, STEP, PASSED = 1 << 22, 100, 1 << 14, 1 << 22
#: Counters of a title's pieces of two characters; length of the pieces that longer titles than so many characters are held against each other by.
COUNTERS, LONG, LONGER = 256, 8, 1000


def _pieces(chars: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all pieces of so many characters."""
    out = np.zeros(max(0, len(chars) - length + 1), np.uint64)
    for k in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + chars[k : k + len(out)]
    return out ^ (out >> np.uint64(29))


class _Titles:
    """Titles by first word, length and id, with counts of their pieces."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, codes: dict[str, int]):
        plain = texts.to_pylist()
        n = np.array([len(t) for t in plain], np.int64)
        word = np.array([codes.setdefault(t.partition(" ")[0], len(codes)) for t in plain], np.int64)
        order = np.lexsort((ids, n, word))
        self.ids, self.n, self.texts, self.plain = ids[order], n[order], texts.take(pa.array(order)), [plain[i] for i in order]
        self.place = (word[order] << 40) + self.n
        self.counts = np.zeros((len(plain), COUNTERS), np.int16)
        for i, t in enumerate(self.plain):
            pieces = np.bincount((_pieces(self.chars(i), 2) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            self.counts[i] = np.minimum(pieces, np.iinfo(np.int16).max)

    def chars(self, i: int) -> np.ndarray:
        return np.frombuffer(self.plain[i].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def long(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_pieces(self.chars(i), LONG), return_counts=True)


def _likely(x: _Titles, y: _Titles, ratio: float, apart: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in x and y, few at a time, of titles with the same first word, like lengths and as many common pieces as so few edits leave.

    An edit changes at most two pieces of two characters into two others, and touches at most ``LONG`` longer ones.
    """
    same = x is y
    reach = x.place - x.n + np.floor((x.n + 1e-6) / (1 - apart)).astype(np.int64) + 1
    first = np.arange(1, len(x.n) + 1) if same else np.searchsorted(y.place, x.place - x.n + np.floor(x.n * (1 - apart)).astype(np.int64) - 1)
    many = np.maximum(0, np.searchsorted(y.place, reach, side="right") - first)
    upto = np.cumsum(many)
    last, pieces = -1, None
    for at in range(0, int(upto[-1]) if len(upto) else 0, STEP):
        f = np.arange(at, min(at + STEP, int(upto[-1])))
        i = np.searchsorted(upto, f, side="right")
        j = first[i] + f - (upto[i] - many[i])
        longer = np.maximum(x.n[i], y.n[j])
        most = np.floor((1 - ratio) * longer + 1e-9).astype(np.int64)
        near = np.flatnonzero((np.abs(x.n[i] - y.n[j]) <= apart * longer + 1e-9) & (np.abs(x.n[i] - y.n[j]) <= most))
        i, j, longer, most = i[near], j[near], longer[near], most[near]
        alike = np.abs(x.counts[i] - y.counts[j]).sum(axis=1, dtype=np.int64) <= 4 * most
        for k in np.flatnonzero(alike & (longer > LONGER)):  # the counts of long titles are much the same
            if i[k] != last:
                last, pieces = i[k], x.long(i[k])
            other = y.long(j[k])
            _, p, q = np.intersect1d(pieces[0], other[0], assume_unique=True, return_indices=True)
            alike[k] = np.minimum(pieces[1][p], other[1][q]).sum() >= longer[k] - LONG + 1 - LONG * most[k]
        yield i[alike], j[alike]


def _alike(pairs: DataFrame, ratio: float) -> DataFrame:
    """Those of (t_a, t_b, ...) whose distance is at most (1 - ratio) of the longer."""
    most = F.floor((1 - ratio) * F.greatest(F.length("t_a"), F.length("t_b")) + 1e-9).cast("int")
    within = " or ".join(f"levenshtein(t_a, t_b, {m}) >= 0" for m in ("least(most, 32)", "least(most, 512)", "most"))  # few edits are found soon
    return pairs.withColumn("most", most).filter(within)  # only as far from the diagonal as that many edits go


def similar_titles(titles: DataFrame, ratio: float = 0.92, gap: float = 0.15, stretch: int = STRETCH) -> DataFrame:
    """Distinct titles (id, t) -> pairs (a < b) with the same first word, like lengths and a distance of at most (1 - ratio) of the longer."""
    return _alike(likely_titles(titles, ratio, gap, stretch, texts=True), ratio).select("a", "b")


def likely_titles(titles: DataFrame, ratio: float = 0.92, gap: float = 0.15, stretch: int = STRETCH, texts: bool = False) -> DataFrame:
    """Pairs (a < b) that hold all ``similar_titles`` and few others; on demand with their texts, t_a and t_b (in any order).

    Titles are dealt out by their first word.  A word of many titles is cut into stretches of like length, and into parts of
    those, and only stretches with like lengths meet, two in a task: so no task grows, and a title is shuffled once for each
    stretch that it meets, its pieces never.  In a task counts of pieces rule out nearly all pairs that are not alike, and none that are.
    """
    apart = min(gap, 1 - ratio)
    parts = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = titles.select("id", "t", F.split("t", " ")[0].alias("word"), F.length("t").cast("long").alias("n"))
    sized = written(rows.groupBy("word", "n").agg(F.sum(F.col("n") + EACH).alias("chars")))
    before = F.coalesce(F.sum("chars").over(W.partitionBy("word").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    large = sized.groupBy("word").agg(F.sum("chars").alias("all")).filter(F.col("all") > stretch).select("word")
    cut = sized.join(large, "word").withColumn("s", F.floor(before / stretch)).groupBy("word", "s")
    cut = written(cut.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.ceil(F.sum("chars") / (2 * stretch)).alias("parts")))  # one for so many characters
    each = cut.select("word", "s", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"))
    one, two = (each.select("word", *[F.col(c).alias(f"{c}{k}") for c in ("s", "lo", "hi", "p")]) for k in (1, 2))
    meet = one.join(two, "word").filter("(s1 < s2 or s1 = s2 and p1 <= p2)").filter(F.col("lo2") * (1 - apart) <= F.col("hi1") + 1)
    meet = written(meet.select("word", "s1", "p1", "s2", "p2", F.concat_ws(" ", "word", "s1", "p1", "s2", "p2").alias("key")))
    sides = meet.select("word", F.col("s1").alias("s"), F.col("p1").alias("p"), "key", F.lit(0).alias("side"))
    sides = sides.unionByName(meet.filter("s1 <> s2 or p1 <> p2").select("word", F.col("s2").alias("s"), F.col("p2").alias("p"), "key", F.lit(1).alias("side")))
    few = max(parts, -(-(sized.agg(F.sum("chars")).first()[0] or 0) // stretch))
    within = F.broadcast(cut.select(F.col("word").alias("word_"), "s", "lo", "hi", "parts"))
    placed = rows.join(within, (F.col("word") == F.col("word_")) & F.col("n").between(F.col("lo"), F.col("hi")), "left").withColumn("p", F.pmod(F.xxhash64("id"), "parts"))
    dealt = placed.join(F.broadcast(sides), ["word", "s", "p"], "left")
    alone = F.concat(F.lit(" "), F.pmod(F.xxhash64("word"), F.lit(few)).cast("string"))  # words of few titles, several in a task
    dealt = dealt.select(F.coalesce("key", alone).alias("key"), F.coalesce("side", F.lit(0)).alias("side"), F.struct("id", "t").alias("title"))
    of = lambda k: F.collect_list(F.when(F.col("side") == k, F.col("title")))
    packed = dealt.repartition(few + meet.count(), "key").groupBy("key").agg(of(0).alias("x"), of(1).alias("y")).select("x", "y")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                codes: dict[str, int] = {}
                x, y = (_Titles(v.field("id").to_numpy(zero_copy_only=False), v.field("t"), codes) if len(v) else None for v in (batch.column(k)[at].values for k in "xy"))
                if x is None:
                    continue
                y = x if y is None else y
                for i, j in _likely(x, y, ratio, apart):
                    size = np.cumsum(x.n[i] + y.n[j]) // PASSED if texts else np.zeros(len(i))
                    for s in np.unique(size):
                        p, q = i[size == s], j[size == s]
                        pair = [pa.array(x.ids[p]), pa.array(y.ids[q])]
                        yield pa.RecordBatch.from_arrays([*pair, x.texts.take(pa.array(p)), y.texts.take(pa.array(q))] if texts else pair, names)

    names = ["i", "j", "t_a", "t_b"] if texts else ["i", "j"]
    both = packed.mapInArrow(compared, "i long, j long" + ", t_a string, t_b string" * texts)
    return both.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), *names[2:])


def fuzzy_groups(df: DataFrame, title: str = "title", id_: str = "id", ratio: float = 0.92, gap: float = 0.15) -> DataFrame:
    """Rows (id, group_id): groups of titles alike, each anchored at its first free document.

    In order of id, a document that no anchor has taken yet becomes an anchor and takes
    all free ones that are like it.  So a document is an anchor once all smaller ones that may be like it
    are taken or found unlike, and is taken by the smallest anchor like it: rounds of joins over the
    pairs decide that for all documents side by side.  What is taken takes none, so its pairs go before their distance is
    known: each round compares documents with the smallest ones left for them, four times as many as in the last.  Equal titles go as one.
    """
    rows = written(df.select(F.col(id_).cast("long").alias("id"), T.normalize_title(F.col(title)).alias("t")).filter("t is not null"))
    same = written(rows.groupBy("t").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    left = written(likely_titles(same.select("id", "t"), ratio, gap).withColumn("alike", F.lit(False)))  # not compared yet, or alike
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken, many = left.select(F.col("b").alias("id"), F.col("a").alias("group_id")).limit(0), 1
    texts = written(same.select("id", "t").join(left.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"))  # few: rounds don't shuffle the others
    text = lambda k: texts.select(F.col("id").alias(k), F.col("t").alias(f"t_{k}"))
    while not left.isEmpty():
        ranked = left.withColumn("rank", F.row_number().over(W.partitionBy("b").orderBy("alike", "a")))
        asked = ranked.filter((F.col("rank") <= many) & ~F.col("alike")).select("a", "b").repartition(parts, "a", "b")
        found = _alike(asked.join(text("a"), "a").join(text("b"), "b"), ratio).select("a", "b")
        known = ranked.filter((F.col("rank") > many) | F.col("alike")).select("a", "b", "alike").unionByName(found.withColumn("alike", F.lit(True)))
        known = written(known)
        anchors = written(known.select("a").distinct().join(known.select(F.col("b").alias("a")).distinct(), "a", "left_anti"))  # none smaller is left for them
        hit = known.filter("alike").join(anchors, "a").groupBy("b").agg(F.min("a").alias("group_id")).select(F.col("b").alias("id"), "group_id")
        taken = written(taken.unionByName(hit).groupBy("id").agg(F.min("group_id").alias("group_id")))
        gone, first = taken.select(F.col("id").alias("a")), taken.select(F.col("id").alias("b"), F.col("group_id").alias("first"))
        rest = known.join(gone, "a", "left_anti").join(anchors.withColumn("anchor", F.lit(True)), "a", "left").filter("anchor is null or not alike")
        left = written(rest.join(first, "b", "left").filter("first is null or a < first").select("a", "b", "alike"))
        many *= 4
    placed = taken.unionByName(taken.select("group_id").distinct().select(F.col("group_id").alias("id"), "group_id"))
    kept = same.join(placed, "id", "left").filter((F.col("n") > 1) | F.col("group_id").isNotNull())
    return rows.join(kept.select("t", F.coalesce("group_id", "id").alias("group_id")), "t").select("id", "group_id")


def quality_score(has_fulltext: Column, abstract: Column, citations: Column, doi: Column, authors: Column, journal: Column, year: Column) -> Column:
    """0 to 100, by how complete a record is."""
    filled = lambda c: F.coalesce(c.cast("string") != "", F.lit(False)).cast("int")
    length = F.coalesce(F.length(abstract), F.lit(0))
    points = 40.0 * F.coalesce(has_fulltext, F.lit(False)).cast("int")
    points = points + F.when(length > 200, 20.0).when(length > 0, 10.0).otherwise(0.0)
    points = points + F.least(F.coalesce(citations, F.lit(0)) / 10.0, F.lit(20.0))
    points = points + 5.0 * (filled(doi) + filled(authors) + filled(journal)) + F.when(year >= 2018, 5.0).otherwise(0.0)
    return F.least(points, F.lit(100.0))


def survivors(df: DataFrame, group: str, score: str, id_: str, fields: list[str], largest: list[str]) -> DataFrame:
    """One row for each group: the best row, its gaps filled from the next best; the largest of some columns."""
    order = W.partitionBy(group).orderBy(F.col(score).desc(), id_)
    rank = df.withColumn("_r", F.row_number().over(order))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("_r"))).alias(c)
    return rank.groupBy(group).agg(F.min_by(id_, "_r").alias(id_), F.count("*").alias("n_rows"), *[first(c) for c in fields], *[F.max(c).alias(c) for c in largest])


def removable(df: DataFrame, key: str) -> DataFrame:
    """Groups of equal keys, and the rows beyond the first of each."""
    groups = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_removable"))


def purge(docs: DataFrame, chunks: DataFrame, links: DataFrame, id_: str = "id") -> dict[str, DataFrame]:
    """Documents, chunks and links without duplicates, and backups of what went, by name."""
    doomed = docs.filter(F.coalesce("is_duplicate", F.lit(False))).select(F.col(id_).alias("document_id"))
    kept = docs.filter(~F.coalesce("is_duplicate", F.lit(False)))
    alive = kept.select(F.col(id_).alias("_c"))
    if "canonical_id" in docs.columns:
        kept = kept.join(alive, F.col("canonical_id") == F.col("_c"), "left").withColumn("canonical_id", F.col("_c")).drop("_c")
    out = {"documents": kept, "backup_documents": docs.join(doomed, F.col(id_) == F.col("document_id"), "left_semi")}
    for name, part in (("chunks", chunks), ("links", links)):
        out[name] = part.join(doomed, "document_id", "left_anti")
        out[f"backup_{name}"] = part.join(doomed, "document_id", "left_semi")
    return out


def legacy_chunks(chunks: DataFrame, least: int = 20, standard: tuple[str, ...] = ("title_abstract", "fulltext_section")) -> DataFrame:
    """Chunks of other kinds, each as junk (too short), redundant (part of the document's title_abstract) or unique."""
    whole = chunks.filter(F.col("chunk_type") == "title_abstract").groupBy("document_id").agg(F.collect_list("content").alias("_whole"))
    old = chunks.filter(~F.coalesce(F.col("chunk_type").isin(*standard), F.lit(False))).join(whole, "document_id", "left")
    inside = F.exists(F.coalesce("_whole", F.array().cast("array<string>")), lambda t: F.contains(t, F.trim(F.col("content"))))
    kind = F.when(F.length(F.trim(F.coalesce("content", F.lit("")))) < least, "junk").when(inside, "redundant").otherwise("unique")
    return old.withColumn("status", kind).drop("_whole")


def keep_one(df: DataFrame, group: str, embedding: str, id_: str) -> DataFrame:
    """One row for each group: with an embedding if there is one, then the smallest id."""
    n = F.row_number().over(W.partitionBy(group).orderBy(F.col(embedding).isNotNull().desc(), id_))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")
