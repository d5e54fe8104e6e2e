"""Lexical, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine


def with_similarity(df: DataFrame, query: list[float], vector: str = "embedding", name: str = "similarity") -> DataFrame:
    """Rows with the cosine to one query vector (a literal, so nothing is joined)."""
    return df.withColumn(name, cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))


def nearest(df: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id", floor: float | None = None, keep: Column | None = None) -> DataFrame:
    """The k rows with the largest cosine, ties to the smaller key."""
    rows = with_similarity(df if keep is None else df.filter(keep), query, vector)
    if floor is not None:
        rows = rows.filter(F.col("similarity") >= floor)
    return rows.orderBy(F.col("similarity").desc_nulls_last(), key).limit(k)


def term_counts(text: Column, terms: list[str]) -> list[Column]:
    """Occurrences of each term in a text, in any case."""
    low = F.lower(text)
    return [((F.length(low) - F.length(F.replace(low, F.lit(t)))) / len(t)).cast("double") for t in terms]


def lexical(df: DataFrame, terms: list[str], text: str = "text", name: str = "lexical") -> DataFrame:
    """Score: sum over the terms of log(1 + occurrences) times log(1 + N / documents that have it).

    The two totals per term come from one aggregation of one row, which is joined back.
    """
    terms = sorted({t.lower() for t in terms if t})
    rows = df.withColumn("_tf", F.array(*term_counts(F.col(text), terms)))  # lower-cased once: the optimizer shares the expression
    totals = rows.agg(F.count("*").alias("_n"), F.array(*[F.count_if(F.col("_tf")[i] > 0) for i in range(len(terms))]).alias("_df"))
    rows = rows.crossJoin(F.broadcast(totals))  # one row
    parts = F.zip_with("_tf", "_df", lambda tf, d: F.when(d > 0, F.ln(1 + tf) * F.ln(1 + F.col("_n") / d)).otherwise(0.0))
    return rows.withColumn(name, F.coalesce(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))).drop("_tf", "_n", "_df")


def hybrid(df: DataFrame, terms: list[str], query: list[float], alpha: float = 0.5, text: str = "text", vector: str = "embedding", key: str = "doc_id", first: int | None = 60, k: int = 10) -> DataFrame:
    """The best ``first`` rows by words (None for all), ranked again by a blend of scaled lexical score and cosine; alpha weighs the cosine."""
    rows = lexical(df, terms, text).filter("lexical > 0")
    if first is not None:
        rows = rows.orderBy(F.col("lexical").desc(), key).limit(first)
    return reranked(rows, query, alpha, vector, key, k)


def reranked(rows: DataFrame, query: list[float], alpha: float = 0.5, vector: str = "embedding", key: str = "doc_id", k: int = 10) -> DataFrame:
    """The best k of rows with a ``lexical`` score by a blend of that, scaled to 1, and the cosine; alpha weighs the cosine."""
    rows = with_similarity(rows, query, vector)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("lexical").alias("_most"))))  # one row
    rows = rows.withColumn("score", alpha * F.coalesce("similarity", F.lit(0.0)) + (1 - alpha) * F.col("lexical") / F.col("_most")).drop("_most")
    return rows.orderBy(F.col("score").desc(), key).limit(k)


def screened(df: DataFrame, query: list[float], k: int = 8, floor: float = 0.18, decision: str = "decision", duplicate: str = "is_duplicate", included_first: bool = False, vector: str = "embedding", key: str = "doc_id") -> DataFrame:
    """Retrieval for answers: no duplicates, nothing excluded, a floor on the cosine; included rows first if asked."""
    rows = df.filter(~F.coalesce(duplicate, F.lit(False)) & ~F.col(decision).eqNullSafe(F.lit("excluded")))
    rows = with_similarity(rows, query, vector).filter(F.col("similarity") >= floor)
    order = [F.col(decision).eqNullSafe(F.lit("included")).desc()] if included_first else []
    return rows.orderBy(*order, F.col("similarity").desc(), key).limit(k)


def live_order(df: DataFrame, by: str, key: str = "doc_id") -> DataFrame:
    return df.orderBy(F.coalesce(by, F.lit(0)).desc(), key)
