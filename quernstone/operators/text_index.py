"""An inverted index of texts, ranked by BM25.

Postings (term, document, count) are written with a folder for each bucket of terms and sorted by
term, so a search reads the folders of its terms only, and of their files the row groups that hold
them.  A posting carries its weight, the part of BM25 that depends on the document:

    count * (k1 + 1) / (count + k1 * (1 - b + b * length / mean length))

and a term's inverse frequency is ln(1 + (N - n + 0.5) / (n + 0.5)); a document's score is the sum over the
query's distinct terms.

Documents stand in blocks of similar length, on which weights depend most.  The index knows the largest weight of
each term in each block, so a search first scores the blocks that promise most, and then only those whose
sum of largest weights reaches the kth score found.  What it returns is exact.

Defined results: a null text has no terms; documents without a term of the query are not found; equal scores go to
the smaller key; a key that repeats counts as one document of all its texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import words

#: Documents in a block, about; blocks that a search begins with.
BLOCK, FIRST = 4096, 4

K1, B = 1.2, 0.75

Analyse = Callable[[Column], Column]


@dataclass
class TextIndex:
    path: str
    key: str
    buckets: int
    kind: str = "bigint"
    analyse: Analyse = words

    def _read(self, spark: SparkSession, name: str, columns: str) -> DataFrame:
        return spark.read.schema(f"{columns}, bucket int").parquet(f"{self.path}/{name}")  # an empty table has no file to tell its columns

    def postings(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """(term, key, block, weight) of some terms; the filters are on folders and on the sorted column."""
        rows = self._read(spark, "postings", f"term string, {self.key} {self.kind}, block long, count long, weight double")
        return rows.filter(F.col("bucket").isin(self._buckets(spark, terms)) & F.col("term").isin(terms)).drop("bucket")

    def _buckets(self, spark: SparkSession, terms: list[str]) -> list[int]:
        row = spark.range(1).select(F.array(*[_bucket(F.lit(t), self.buckets) for t in terms])).first()
        return sorted(set(row[0]))

    def terms(self, spark: SparkSession, terms: list[str]) -> dict[str, float]:
        """The inverse frequency of those of the terms that a document has."""
        rows = self._read(spark, "terms", "term string, df long, idf double").filter(F.col("bucket").isin(self._buckets(spark, terms)) & F.col("term").isin(terms))
        return {r["term"]: r["idf"] for r in rows.select("term", "idf").collect()}  # a row for each term of the query

    def scored(self, spark: SparkSession, idf: dict[str, float], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """(key, score) of every document with a term; ``keep`` narrows the postings first."""
        worth = F.create_map(*[F.lit(x) for t in sorted(idf) for x in (t, idf[t])])
        rows = keep(self.postings(spark, sorted(idf)))
        each = rows.groupBy(self.key).agg(F.array_sort(F.collect_list(F.struct("term", (F.col("weight") * worth[F.col("term")]).alias("w")))).alias("t"))
        return each.select(self.key, F.aggregate("t", F.lit(0.0), lambda s, t: s + t["w"]).alias("score"))  # in the order of terms, so sums agree

    def promises(self, spark: SparkSession, idf: dict[str, float]) -> DataFrame:
        """(block, most): what a document of a block can score at most."""
        worth = F.create_map(*[F.lit(x) for t in sorted(idf) for x in (t, idf[t])])
        rows = self._read(spark, "blocks", "term string, block long, weight double").filter(F.col("bucket").isin(self._buckets(spark, sorted(idf))) & F.col("term").isin(sorted(idf)))
        return rows.groupBy("block").agg((F.sum(F.col("weight") * worth[F.col("term")]) * (1 + 1e-9)).alias("most"))

    def top(self, spark: SparkSession, query: str, k: int) -> DataFrame:
        """(key, score) of the k best documents."""
        asked = spark.range(1).select(F.array_distinct(self.analyse(F.lit(query)))).first()[0]
        idf = self.terms(spark, asked) if asked else {}
        if not idf:
            return spark.createDataFrame([], f"{self.key} {self.kind}, score double")
        most = self.promises(spark, idf)
        begin = [r["block"] for r in most.orderBy(F.col("most").desc(), "block").limit(FIRST).collect()]
        best = lambda df: df.orderBy(F.col("score").desc(), self.key).limit(k)
        found = best(self.scored(spark, idf, lambda df: df.filter(F.col("block").isin(begin)))).agg(F.count("*"), F.min("score")).first()
        if found[0] < k:
            return best(self.scored(spark, idf))
        left = most.filter(F.col("most") >= found[1]).select("block")
        return best(self.scored(spark, idf, lambda df: df.join(left, "block", "left_semi")))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _counts(texts: DataFrame, analyse: Analyse) -> DataFrame:
    """(key, term, count); texts are less to shuffle than their terms, which stay where their key is."""
    said = texts.repartition("key").select("key", F.explode(analyse(F.col("text"))).alias("term"))
    return said.groupBy("key", "term").agg(F.count("*").alias("count"))


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int = 64, block: int = BLOCK, analyse: Analyse = words) -> TextIndex:
    """Writes the index of ``docs`` under ``path``; ``buckets`` should grow with the vocabulary.

    Texts are dealt out by key once, and their terms counted there; a bucket with a frequent term is split into several files.
    """
    spark = docs.sparkSession
    said = docs.select(F.col(key).alias("key"), analyse(F.col(text)).alias("w"))
    sizes = said.groupBy("key").agg(F.sum(F.size("w")).cast("long").alias("length"))
    level = F.floor(4 * F.log2(1.0 + F.col("length"))).cast("int")
    levels = sizes.groupBy(level.alias("level")).agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))  # a few hundred rows
    placed = sizes.withColumn("level", level).join(F.broadcast(levels), "level")
    placed.select("key", "length", (F.col("level").cast("long") * (1 << 32) + F.pmod(F.xxhash64("key"), "parts")).alias("block")).write.parquet(f"{path}/documents")
    documents = spark.read.parquet(f"{path}/documents")
    n, mean = documents.agg(F.count("*"), F.avg("length")).first()
    counts = _counts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), analyse)
    share = F.col("length") / (mean or 1.0)
    weight = F.col("count") * (K1 + 1) / (F.col("count") + K1 * (1 - B + B * share))
    rows = counts.join(documents, "key").select("term", F.col("key").alias(key), "block", "count", weight.alias("weight"), _bucket(F.col("term"), buckets).alias("bucket"))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = spark.read.schema(rows.schema).parquet(f"{path}/postings")
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = postings.groupBy("bucket", "term").agg(F.count("*").alias("df")).withColumn("idf", idf)
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    blocks = postings.groupBy("bucket", "term", "block").agg(F.max("weight").alias("weight"))
    blocks.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/blocks")
    return TextIndex(path, key, buckets, dict(docs.dtypes)[key], analyse)
