"""Filling in documents from landed tables of works."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Fields that a backfill may write.
FIELDS = (
    "authors", "doi", "journal", "keywords", "language", "study_design", "sample_size", "country", "citation_count", "open_access", "pmid", "openalex_id",
    "volume", "issue", "pages", "issn", "publication_type", "structured_abstract", "mesh_terms", "affiliations", "funding",
)


def enrich(docs: DataFrame, works: DataFrame, fields: list[str], publishers: DataFrame | None = None, more: list[str] | None = None, key: str = "work_id", doi: str = "doi", title: str = "title") -> DataFrame:
    """``docs`` with fields of ``works``, by DOI and, where no work has that, by normalised title; ``more`` of ``publishers`` by DOI only.

    Of several works with one DOI or title, the one with the smallest key counts.
    """
    best = lambda df, k, names: df.filter(k.isNotNull()).groupBy(k.alias("_k")).agg(F.min_by(F.struct(*names), key).alias("_w"))
    of_doi, of_title = T.normalize_doi(F.col(doi)), T.normalize_title(F.col(title))
    by_doi = best(works, of_doi, fields).select(F.col("_k").alias("_kd"), F.col("_w").alias("_d"))
    by_title = best(works, of_title, fields).select(F.col("_k").alias("_kt"), F.col("_w").alias("_t"))
    rows = docs.withColumns({"_doi": of_doi, "_title": of_title})
    rows = rows.join(by_doi, F.col("_doi") == F.col("_kd"), "left")
    rows = rows.withColumn("_ask", F.when(F.col("_d").isNull(), F.col("_title"))).join(by_title, F.col("_ask") == F.col("_kt"), "left")
    out = [F.when(F.col("_d").isNotNull(), F.col("_d")[f]).otherwise(F.col("_t")[f]).alias(f) for f in fields]
    if publishers is not None:
        found = best(publishers, of_doi, more or []).select(F.col("_k").alias("_kp"), F.col("_w").alias("_p"))
        rows = rows.join(found, F.col("_doi") == F.col("_kp"), "left")
        out += [F.col("_p")[f].alias(f) for f in more or []]
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {*fields, *(more or [])}], *out)


def backfill(docs: DataFrame, sources: list[DataFrame], key: str = "id", missing_only: bool = False) -> DataFrame:
    """``docs`` with each field from the first source that fills it, else as it was; with ``missing_only`` documents with authors and DOI stay as they are.

    Sources have one row for each key; their columns other than FIELDS are left out.  Empty texts fill nothing.
    """
    rows = docs
    for i, s in enumerate(sources):
        rows = rows.join(s.select(F.col(key).alias(f"_k{i}"), *[F.col(c).alias(f"_{i}_{c}") for c in s.columns if c in FIELDS]), F.col(key) == F.col(f"_k{i}"), "left")
    fields = [f for f in FIELDS if any(f in s.columns for s in sources)]
    open_ = reduce(lambda a, c: a | F.col(c).isNull(), [c for c in ("authors", "doi") if c in docs.columns], F.lit(False)) if missing_only else F.lit(True)
    given = lambda f: [_filled(s, f, f"_{i}_{f}") for i, s in enumerate(sources) if f in s.columns]
    new = {f: F.coalesce(*[F.when(open_, c) for c in given(f)], *([F.col(f)] if f in docs.columns else [])) for f in fields}
    kept = [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*kept, *[new[f].alias(f) for f in fields if f not in docs.columns])


def _filled(source: DataFrame, field: str, column: str):
    kind = dict(source.dtypes)[field]
    if kind == "string":
        return F.nullif(F.col(column), F.lit(""))
    return F.when(F.size(column) > 0, F.col(column)) if kind.startswith("array") else F.col(column)
