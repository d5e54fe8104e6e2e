"""Toxicity by class-conditional Kneser-Ney models.

Two letter models, of toxic and of ordinary texts, give each word a log-likelihood.
The longest contexts have counts of their own class, interpolated Kneser-Ney style with
one backoff distribution that both classes share: continuation counts over the distinct
words of all documents.  A rare expression thus differs between the classes only where a
class has seen it.  A text's features are the length-normalised difference of the two
log-likelihoods over the whole text and over the hundredth of its words that differ most;
a logistic function of the two, fitted on a fifth of the training texts that the class
counts leave out, is the score.

The class counts are of at most ``FIT_ROWS`` labelled texts of each class, those with the
smallest hash of their id.  The continuation counts need no labels and grow with the
documents; they stay a distributed table.  A letter that neither class has seen after its
context has the same ratio whatever its backoff, so only the backoff of runs in the
labelled texts is looked up there, and what is sent to the executors is bounded.

Defined results: a null or empty text, or one with no letters, has features of zero and
so the score of the bias; without both classes among the training texts every score is
the share of toxic ones among them (zero if there are none); equal rows stay separate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved, sliced, unused

#: Labelled texts of each class that the models are fitted on; longest letter run; Kneser-Ney discount.
FIT_ROWS, ORDER, DISCOUNT = 3000, 6, 0.75
#: Share of a text's words that stand for its most toxic part.
TOP = 0.01

_WORD = re.compile(r"[^\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall((text or "").lower())


def letter_runs(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run length m: (m, word, run, context, place of its last letter, where it ends among runs of m - 1).

    A word is its letters between a start and an end sign; runs do not cross words.  Run
    and context (the run without its last letter) are 64-bit hashes.
    """
    flat = "".join(f"\x02{w}\x03" for w in words)
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    before = np.zeros(0, np.int64)
    for m in range(1, ORDER + 1):
        ends = np.flatnonzero(place >= max(1, m - 1))
        run = context = np.full(len(ends), m, np.uint64)
        for i in range(m):
            context = run
            run = (run ^ code[ends - (m - 1) + i]) * _MULT
            run = run ^ (run >> np.uint64(29))
        yield m, owner[ends], run, context, place[ends], np.searchsorted(before, ends)
        before = ends


def smooth(n: np.ndarray, kinds: np.ndarray, total: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Discounted share of n in the total, with the rest dealt out by the backoff; the backoff alone where the context is new."""
    return np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * below) / np.maximum(total, 1.0), below)


class Counts:
    """Sorted hashes, each with a row of values; zeros for what is not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.uint64(0))
        self.columns = np.vstack((values[order], np.zeros((1, values.shape[1])))).T.astype(np.float32).copy()

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key; the last row is all zeros."""
        at = np.searchsorted(self.keys[:-1], keys)
        return np.where(self.keys[at] == keys, at, len(self.keys) - 1)

    def of(self, rows: np.ndarray, *columns: int) -> tuple[np.ndarray, ...]:
        return tuple(self.columns[c][rows].astype(np.float64) for c in columns)


class Model:
    """The two letter models: by run length, counts of runs (toxic, ordinary, shared backoff) and of contexts."""

    def __init__(self, table: dict[str, np.ndarray], letters: int):
        """Columns m, run, context, tail, toxic, ordinary, ahead, total and kinds, a row for each run; tail is the run without its first letter.

        Ahead is how many letters the corpus has before the run; total and kinds are the sum of
        these over the runs with the same context, and the number of such runs.
        """
        self.runs: dict[int, Counts] = {}
        self.contexts: dict[int, Counts] = {}
        self.cache: dict[str, float] = {}
        shared = Counts(np.zeros(0, np.uint64), np.zeros((0, 1)))
        for m in range(1, ORDER + 1):
            here = table["m"] == m
            run = table["run"][here]
            own = [table[c][here].astype(float) for c in ("toxic", "ordinary")]
            below = np.full(len(run), 1.0 / letters) if m == 1 else shared.of(shared.rows(table["tail"][here]), 0)[0]
            self.runs[m] = Counts(run, np.column_stack((*own, below)))
            if m < ORDER:
                ahead, total, kinds = (table[c][here].astype(float) for c in ("ahead", "total", "kinds"))
                shared = Counts(run, smooth(ahead, kinds, total, below)[:, None])
            context, which = np.unique(table["context"][here], return_inverse=True)
            add = lambda v: np.bincount(which, v, len(context))
            self.contexts[m] = Counts(context, np.column_stack((add(own[0]), add(own[1]), add(own[0] > 0), add(own[1] > 0))))

    def differences(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word as toxic, less that as ordinary."""
        out = np.zeros(len(words))
        if not words:
            return out
        for m, owner, run, context, place, _ in letter_runs(words):
            if m == 1:
                continue
            if m < ORDER:
                # A letter is scored in the longest run that its word has for it.
                longest = np.flatnonzero(place == m - 1)
                owner, run, context = owner[longest], run[longest], context[longest]
            runs, contexts = self.runs[m], self.contexts[m]
            r, c = runs.rows(run), contexts.rows(context)
            below = runs.of(r, 2)[0]
            below[below == 0] = 1.0  # in neither class: the ratio is the same for any backoff
            toxic, ordinary = (smooth(*runs.of(r, k), *contexts.of(c, 2 + k, k), below) for k in (0, 1))
            out += np.bincount(owner, np.log(toxic / ordinary), len(words))
        return out

    def features(self, texts: list[str | None]) -> list[tuple[float, float]]:
        """Of each text, the differences by letter over the whole, and by word over its most toxic part."""
        found = [words_of(t) for t in texts]
        cache = self.cache
        if len(cache) > 800_000:
            cache.clear()
        fresh = list({w for words in found for w in words if w not in cache})
        cache.update(zip(fresh, self.differences(fresh).tolist()))
        out = []
        for words in found:
            if not words:
                out.append((0.0, 0.0))
                continue
            values = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
            top = max(1, int(len(values) * TOP))
            letters = sum(map(len, words)) + len(words)
            out.append((float(values.sum() / letters), float(np.partition(values, len(values) - top)[-top:].mean())))
        return out


def held_out(key: Column | str) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False)) if isinstance(key, str) else F.crc32(key.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled texts of each class: (text, toxic, part); part 0 is for the logistic function."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key))
    known = known.groupBy(key).agg(F.max(label).alias("toxic"))
    by_hash = lambda c: known.filter(F.col("toxic") == c).orderBy(F.xxhash64(key), key).limit(most)
    chosen = by_hash(0).unionByName(by_hash(1))
    part = F.floor(F.crc32(F.col(key).cast("string").cast("binary")) / 4) % 5
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key)  # at most 2 * most ids
    rows = rows.groupBy(key).agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))  # one text of an id, however often it is there
    return rows.select("text", F.col("toxic").cast("int"), part.cast("int").alias("part"))


def _class_counts(rows: DataFrame) -> DataFrame:
    """Training texts -> letter runs with their counts in toxic and in ordinary ones."""

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1024):
            found: dict[int, Counter[str]] = {}
            for text, toxic in zip(part.column("text"), part.column("toxic").to_pylist()):
                found.setdefault(toxic, Counter()).update(words_of(text.as_py()))
            for toxic, words in found.items():
                columns = [pa.array(list(words), pa.string()), pa.repeat(pa.scalar(toxic, pa.int32()), len(words)), pa.array(list(words.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "toxic", "n"])

    def count_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic, n = batch.toxic.to_numpy(), batch.n.to_numpy()
            for rows, owner in _run_rows(batch.word.tolist()):
                rows = rows.assign(toxic=toxic[owner], n=n[owner])
                yield rows.groupby(["m", "run", "context", "tail", "toxic"], as_index=False).sum()

    words = rows.mapInArrow(count_words, "word string, toxic int, n long").groupBy("word", "toxic").agg(F.sum("n").alias("n"))
    runs = words.mapInPandas(count_runs, "m int, run long, context long, tail long, toxic int, n long")
    own = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0))
    return runs.groupBy("m", "run", "context", "tail").agg(own(1).alias("toxic"), own(0).alias("ordinary"))


def _run_rows(words: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """By run length, rows (m, run, context, tail) of the words' runs, and the word of each."""
    before = np.zeros(0, np.uint64)
    for m, owner, run, context, _, lower in letter_runs(words):
        tail = before[lower] if m > 1 else np.zeros(len(run), np.uint64)
        before = run
        yield pd.DataFrame({"m": m, "run": run.view(np.int64), "context": context.view(np.int64), "tail": tail.view(np.int64)}), owner


def corpus_runs(texts: DataFrame) -> DataFrame:
    """Texts (one column) -> the distinct letter runs (m, run, context, tail) of all their words."""

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1024):
            found: set[str] = set()
            for text in part.column(0):
                found.update(words_of(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["word"])

    def distinct_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, _ in _run_rows(batch.word.tolist()):
                yield rows.drop_duplicates()

    words = texts.mapInArrow(distinct_words, "word string").distinct()
    return words.mapInPandas(distinct_runs, "m int, run long, context long, tail long").distinct()


def shared_counts(own: DataFrame, runs: DataFrame) -> DataFrame:
    """``own`` (runs of the training texts) with the corpus's continuation counts: ahead, total and kinds.

    ``own`` is bounded and so broadcast; the runs of the corpus are joined by key.
    """
    ahead = runs.filter("m > 1").groupBy((F.col("m") - 1).alias("m"), F.col("tail").alias("run")).agg(F.count("*").alias("ahead"))
    contexts = own.filter(F.col("m") < ORDER).select("m", "context").distinct()
    asked = runs.filter(F.col("m") < ORDER).select("m", "run", "context").join(F.broadcast(contexts), ["m", "context"], "left_semi")
    # A run at the start of a word has no letter before it, and counts once.
    counted = asked.join(ahead, ["m", "run"], "left").select("m", "run", "context", F.coalesce("ahead", F.lit(1)).alias("ahead"))
    counted = counted.join(F.broadcast(own.select("m", "run", F.lit(True).alias("kept"))), ["m", "run"], "left")
    of_context = counted.groupBy("m", "context").agg(
        F.sum("ahead").alias("total"), F.count("*").alias("kinds"), F.collect_list(F.when(F.col("kept"), F.struct("run", "ahead"))).alias("found")
    )
    found = of_context.select("m", "total", "kinds", F.explode("found").alias("f")).select("m", "f.run", "f.ahead", "total", "kinds")
    return own.join(found, ["m", "run"], "left").na.fill(0, ["ahead", "total", "kinds"])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of (1, *features) by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(len(w))
        w -= np.linalg.solve(slope, x.T @ (p - y) + ridge * w)
    return w


def score(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    fit_rows: int = FIT_ROWS, threshold: float = 0.3, score: str = "score", predicted: str = "predicted",
) -> DataFrame:
    """``docs`` with a score (0 to 1) and a prediction (1 from the threshold on) as the last two columns; columns of those names stay, the new ones get an underscore more."""
    spark = docs.sparkSession
    score = unused(score, docs.columns)
    predicted = unused(predicted, [*docs.columns, score])
    rows = saved(training_rows(docs, labels, key, text, label, fit_rows))
    seen = {(r["toxic"], r["part"] == 0): r["count"] for r in rows.groupBy("toxic", "part").count().collect()}
    both = all(any(c == k for c, _ in seen) for k in (0, 1))
    if not both:
        constant = 1.0 if any(c == 1 for c, _ in seen) else 0.0
        value = F.lit(constant)
        return docs.withColumn(score, value).withColumn(predicted, (value >= threshold).cast("int"))
    own = saved(_class_counts(rows.filter("part <> 0")))  # bounded by fit_rows
    runs = saved(corpus_runs(docs.select(F.col(text).alias("text"))))
    letters = max(2, runs.filter("m = 1").count())
    arrow = shared_counts(own, runs).toArrow()
    table = {name: arrow.column(name).to_numpy() for name in arrow.column_names}
    table |= {name: table[name].view(np.uint64) for name in ("run", "context", "tail")}
    model = spark.sparkContext.broadcast(Model(table, letters))
    del arrow, table

    @F.arrow_udf("struct<whole double, top double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in sliced(batches):
            pairs = np.array(model.value.features(part.to_pylist()), np.float64)
            yield pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["whole", "top"])

    fitted = rows.filter("part = 0").select("toxic", features("text").alias("f")).select("toxic", "f.*").toPandas()
    if fitted.toxic.nunique() < 2:  # too few texts to set any aside
        fitted = rows.select("toxic", features("text").alias("f")).select("toxic", "f.*").toPandas()
    # The classes of the sample are in other proportions than all labels; the bias is moved back to those.
    x, y = fitted[["whole", "top"]].to_numpy(), fitted.toxic.to_numpy()
    scale = np.maximum(x.std(axis=0), 1e-9)
    mean = x.mean(axis=0)
    w = fit_logistic((x - mean) / scale, y)
    slope = w[1:] / scale
    all_labels = labels.filter(~held_out(key) & F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
    share = y.mean()
    shift = np.log(all_labels / (1 - all_labels)) - np.log(share / (1 - share)) if 0 < all_labels < 1 else 0.0
    bias = float(w[0] - slope @ mean + shift)
    f = unused("features", docs.columns)
    z = F.lit(bias) + F.col(f)["whole"] * float(slope[0]) + F.col(f)["top"] * float(slope[1])
    out = docs.withColumn(f, features(F.col(text))).withColumn(score, 1 / (1 + F.exp(-z))).drop(f)
    return out.withColumn(predicted, (F.col(score) >= threshold).cast("int"))
