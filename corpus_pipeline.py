"""From raw documents to token ids: toxicity, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns the columns of ``documents``; the last returns ids.  ``doc_id`` is a key of the
documents; rows that share one are kept or dropped together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe, kneserney, lines, mixing, simhash
from quernstone.llm.queries import tokenizer_path
from quernstone.llm.store import shared_folder, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models call toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = kneserney.score(docs, labels, threshold=0.3, score="score", predicted="predicted")
    return scored.filter(~F.col(scored.columns[-1]).eqNullSafe(F.lit(1))).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go; a document that loses all of them stays, empty."""
    out = lines.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays.

    Links are SimHashes of five-word shingles within three of 64 bits, and shingle sets of
    a similarity of 0.8 or more.
    """
    groups = simhash.near_copies(docs.select("doc_id", "text"), words=5, radius=3, similarity=0.8)
    kept = unused("_kept", docs.columns)
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col(kept)), "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes its words, to the nearest whole number."""
    of, times, turn = (unused(n, docs.columns) for n in ("_of", "_times", "_turn"))
    mixed = mixing.mix(docs.select("doc_id", "source", "text")).filter("size > 0")
    taken = mixed.groupBy(F.col("doc_id").alias(of)).agg(F.max(F.round(F.col("taken") / F.col("size")).cast("int")).alias(times)).filter(F.col(times) > 0)
    out = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(of)))
    return out.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document (packed little-endian uint32), with digests of them and of the text decoded from them."""
    coded = bpe.tokenize(docs.select("doc_id", "source", "text"), tokenizer_path(), decoded="decoded")
    digests = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]
    return coded.select("doc_id", "source", bpe.n_tokens("ids").alias("n_tokens"), *digests, "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: Neither the models nor the tokenizer can be expressed in SQL; tests/llm has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again.

    A stage's table takes the place of the one before its predecessor's, so two are there at most.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{n % 2}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    return docs
