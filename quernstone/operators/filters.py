"""Filters, membership and set-valued updates as DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Filters that compare one column; year_min and year_max bound it.
KEYS = ("source", "lang", "disease_or_condition", "study_design", "country", "evidence_level", "project_context", "journal")


def where(docs: DataFrame, filters: dict | None, membership: DataFrame | None = None, key: str = "doc_id", contexts: dict[str, str] | None = None) -> DataFrame:
    """Rows that pass the filters; blank values and unknown keys are ignored.

    ``scenario_type`` keeps the documents that ``membership`` (scenario_id, document_id)
    links to that scenario.  ``contexts`` gives the current name of older project contexts.
    """
    given = {k: v for k, v in (filters or {}).items() if v is not None and str(v).strip() != ""}
    conditions: list[Column] = []
    for k, v in given.items():
        if k in KEYS and k in docs.columns:
            conditions.append(F.col(k) == ((contexts or {}).get(v, v) if k == "project_context" else v))
        elif k == "year_min" and "year" in docs.columns:
            conditions.append(F.col("year") >= int(v))
        elif k == "year_max" and "year" in docs.columns:
            conditions.append(F.col("year") <= int(v))
    out = docs.filter(reduce(lambda a, b: a & b, conditions)) if conditions else docs
    if "scenario_type" in given and membership is not None:
        linked = membership.filter(F.col("scenario_id") == given["scenario_type"]).select(F.col("document_id").alias("_linked"))
        out = out.join(linked, F.col(key) == F.col("_linked"), "left_semi")
    return out


def equal_ignoring_case(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Equality filters on raw columns; case counts neither in names nor in values."""
    names = {c.lower().strip(): c for c in df.columns}
    for k, v in filters.items():
        if v and k.lower().strip() in names:
            df = df.filter(F.lower(F.trim(F.col(names[k.lower().strip()]).cast("string"))) == v.lower().strip())
    return df


def between_dates(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive window on dates written year first; either end may be open."""
    if start:
        df = df.filter(F.col(column) >= start)
    return df.filter(F.col(column) <= end) if end else df


def long_enough(df: DataFrame, least: int, *texts: str) -> DataFrame:
    return df.filter(F.length(F.concat_ws("", *texts)) >= least)


def flag_linked(df: DataFrame, other: DataFrame, key: str, other_key: str, flag: str) -> DataFrame:
    """``df`` with whether ``other`` has the key."""
    keys = other.select(F.col(other_key).alias("_k")).distinct().withColumn("_has", F.lit(True))
    return df.join(keys, F.col(key) == F.col("_k"), "left").withColumn(flag, F.coalesce("_has", F.lit(False))).drop("_k", "_has")


def insert_new(target: DataFrame, fresh: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The rows of ``fresh`` that an insert with ON CONFLICT DO NOTHING would add."""
    if order:
        first = F.row_number().over(W.partitionBy(*keys).orderBy(order))
        fresh = fresh.withColumn("_n", first).filter("_n = 1").drop("_n")
    else:
        fresh = fresh.dropDuplicates(keys)
    return fresh.join(target.select(*keys), keys, "left_anti").select(*fresh.columns)


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``target`` with the source's values where they are distinct and the source has the key."""
    named = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = target.join(named, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_hit") & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.select(*target.columns)


def delete_with_backup(df: DataFrame, doomed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, backup)."""
    ids = doomed.select(*keys).distinct()
    return df.join(ids, keys, "left_anti"), df.join(ids, keys, "left_semi")


def repoint(links: DataFrame, moved: DataFrame) -> DataFrame:
    """Links (scenario_id, document_id, ...) of duplicates, moved (old_id, keep_id) to the kept document; existing links win."""
    joined = links.join(moved, F.col("document_id") == F.col("old_id"), "left")
    joined = joined.withColumn("_new", F.col("keep_id").isNotNull()).withColumn("document_id", F.coalesce("keep_id", "document_id"))
    first = F.row_number().over(W.partitionBy("scenario_id", "document_id").orderBy("_new", F.col("old_id").asc_nulls_first()))
    return joined.withColumn("_n", first).filter("_n = 1").select(*links.columns)


def replace_partition(chunks: DataFrame, fresh: DataFrame, key: str = "document_id", kind: str = "fulltext_section") -> DataFrame:
    """Chunks in which the fresh documents' chunks of one kind take the place of the old ones."""
    ids = fresh.select(key).distinct().withColumn("_re", F.lit(True))
    kept = chunks.join(ids, key, "left").filter(F.col("_re").isNull() | ~F.col("chunk_type").eqNullSafe(F.lit(kind))).select(*chunks.columns)
    return kept.unionByName(fresh, allowMissingColumns=True)


def cap_per_source(df: DataFrame, most: int, source: str = "source", newest: str = "year", key: str = "doc_id") -> DataFrame:
    """The newest rows of each source."""
    n = F.row_number().over(W.partitionBy(source).orderBy(F.col(newest).desc_nulls_last(), key))
    return df.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def page(df: DataFrame, score: str, threshold: float, limit: int, offset: int = 0, key: str = "doc_id") -> DataFrame:
    """A page of a corpus: rows above the threshold first, then by score."""
    return df.orderBy((F.coalesce(score, F.lit(0.0)) >= threshold).desc(), F.coalesce(score, F.lit(0.0)).desc(), key).offset(offset).limit(limit)
