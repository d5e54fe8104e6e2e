"""Keeping a corpus: search vectors, embeddings, exports, inserts under conditions, chunk repair, job states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stem
from ..functions import text as T


def search_vector(label: Column, content: Column) -> Column:
    """array<struct<term, weight, positions>> of a chunk: words of the label weigh A, of the content B, positions run on from one to the other.

    Words are lower-case runs of letters and digits, not stemmed.  A word of both keeps A.
    """
    return weighted(stem.words(label), stem.words(content))


def with_search_vector(df: DataFrame, label: str, content: str, name: str = "search_vector") -> DataFrame:
    """``df`` with a search vector of English stems; stop words have a place but are no terms."""
    rows = df.withColumns({"_a": stem.stems(stem.words(F.col(label))), "_b": stem.stems(stem.words(F.col(content)))})
    return rows.withColumn(name, weighted(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def weighted(a: Column, b: Column) -> Column:
    """A search vector of two arrays of terms; null stands for a word that is no term."""
    placed = F.filter(F.transform(F.concat(a, b), lambda w, i: F.struct(w.alias("term"), (i + 1).alias("at"))), lambda p: p["term"].isNotNull())

    def runs(p: Column) -> Column:
        """Of places sorted by term, those of each term; a text is walked once, however many terms it has."""
        starts = F.filter(F.transform(p, lambda x, i: F.when((i == 0) | (F.get(p, i - 1)["term"] != x["term"]), i)), lambda i: i.isNotNull())
        return F.element_at(F.transform(F.array(starts), lambda s: F.transform(s, lambda at, n: one(p, at, F.coalesce(F.get(s, n + 1), F.size(p)) - at))), 1)

    def one(p: Column, at: Column, n: Column) -> Column:
        first = F.get(p, at)
        weight = F.when(first["at"] <= F.size(a), "A").otherwise("B")
        return F.struct(first["term"].alias("term"), weight.alias("weight"), F.transform(F.slice(p, at + 1, n), lambda x: x["at"]).alias("positions"))

    return F.element_at(F.transform(F.array(F.array_sort(placed)), runs), 1)  # the sorted array and the starts get names, so that each is made once


def embedding_input(text: Column, most_chars: int = 20_000, most_tokens: int = 7_500) -> Column:
    """What is embedded of a text: one line, at most so many words and characters; null for blank texts, which get no vector."""
    line = F.trim(F.regexp_replace(text, r"[\r\n]+", " "))
    words = F.split(line, " +")
    short = F.when(F.size(words) > most_tokens, F.array_join(F.slice(words, 1, most_tokens), " ")).otherwise(line)
    return F.when(line != "", F.rtrim(F.substring(short, 1, most_chars)))


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], key: str, text: str, vector: str = "embedding", batch: int = 50) -> DataFrame:
    """(key, vector) of rows without a vector, ``batch`` texts at a time; blank texts get null."""
    todo = rows.filter(F.col(vector).isNull()) if vector in rows.columns else rows
    todo = todo.select(F.col(key).alias("key"), embedding_input(F.col(text)).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                full = some["text"].notna()
                got = iter(embedder(some["text"][full].tolist())) if full.any() else iter(())
                yield pd.DataFrame({"key": some["key"], "vector": [next(got) if f else None for f in full]})

    return todo.mapInPandas(run, f"key {dict(rows.dtypes)[key]}, vector array<float>").toDF(key, vector)


def insert_where(target: DataFrame, fresh: DataFrame, keys: list[str], when: Column, order: str) -> DataFrame:
    """The rows of ``fresh`` that an insert under a conditional unique key would add.

    Rows outside the condition conflict with nothing; of fresh ones with equal keys the first by ``order`` goes in.
    """
    outside = fresh.filter(~F.coalesce(when, F.lit(False)))
    inside = fresh.filter(when).withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
    return inside.join(target.filter(when).select(*keys).distinct(), keys, "left_anti").select(*fresh.columns).unionByName(outside)


def backfill_links(docs: DataFrame, links: DataFrame, scenario: str, key: str = "doc_id") -> DataFrame:
    """Links (scenario_id, document_id, similarity_score) of documents whose scenario column has no link yet; not scored."""
    wanted = docs.filter(F.col(scenario).isNotNull() & (F.trim(F.col(scenario)) != "")).select(F.col(scenario).alias("scenario_id"), F.col(key).alias("document_id")).distinct()
    return wanted.join(links.select("scenario_id", "document_id"), ["scenario_id", "document_id"], "left_anti").withColumn("similarity_score", F.lit(None).cast("double"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """One row: rows of ``child``, and those whose key no ``parent`` has; null keys are orphans."""
    known = parent.select(F.col(parent_key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    joined = child.join(known, F.col(child_key) == F.col("_k"), "left")
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col("_hit").isNull()).alias("n_orphans"))


def flag_new(docs: DataFrame, scenarios: DataFrame, created: str = "created_at", scenario: str = "scenario_id") -> DataFrame:
    """``docs`` with is_new: entered when their scenario was made or later."""
    born = scenarios.select(F.col(scenario).alias("_s"), F.col("created_at").alias("_born"))
    out = docs.join(born, F.col(scenario) == F.col("_s"), "left")
    return out.withColumn("is_new", F.coalesce(F.col(created) >= F.col("_born"), F.lit(False))).drop("_s", "_born")


def corpus_union(local: DataFrame, fresh: DataFrame, keep: Column, native: Column, key: str = "doc_id", shortest: int = 30, text: str = "text") -> DataFrame:
    """Ids of a corpus: local documents that ``keep`` takes, and fresh ones that it takes or whose source applied the query itself (``native``).

    Fresh documents with fewer than ``shortest`` characters are left out.
    """
    new = fresh.filter((F.length(text) >= shortest) & (keep | F.coalesce(native, F.lit(False)))).select(key)
    return local.filter(keep).select(key).unionByName(new).distinct()


def repair_chunks(chunks: DataFrame, docs: DataFrame, key: str = "document_id", id_: str = "chunk_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks with one title_abstract each, chunks to add for documents that have text but no chunk, one-row report).

    Of several title_abstract chunks, one with an embedding stays, then that of the smallest id.
    """
    head = F.col("chunk_type") == "title_abstract"
    n = F.row_number().over(W.partitionBy(key).orderBy(F.col("embedding").isNotNull().desc(), id_))
    kept = chunks.filter(~F.coalesce(head, F.lit(False))).unionByName(chunks.filter(head).withColumn("_n", n).filter("_n = 1").drop("_n"))
    whole = F.concat_ws("\n\n", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("abstract"), F.lit("")))
    bare = docs.join(chunks.select(key).distinct(), key, "left_anti").withColumn("content", whole)
    added = bare.filter(F.col("content") != "").select(key, F.lit("title_abstract").alias("chunk_type"), F.lit(0).alias("chunk_index"), "content")
    counts = [chunks.agg(F.count("*").alias("n_before")), kept.agg(F.count("*").alias("n_kept")), bare.agg(F.count_if(F.col("content") != "").alias("n_recovered"), F.count_if(F.col("content") == "").alias("n_empty"))]
    return kept, added, counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


def content_groups(docs: DataFrame, keys: list[Column], key: str = "doc_id") -> DataFrame:
    """Duplicates (doc, canonical) by the first of several content keys that a document has; the smallest id stays."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(*keys).alias("k")).filter("k is not null")
    return rows.withColumn("canonical_id", F.min("id").over(W.partitionBy("k"))).filter("canonical_id < id").select(F.col("id").alias(key), "canonical_id")


def chunk_types(chunks: DataFrame, kind: str = "chunk_type", embedding: str = "embedding") -> DataFrame:
    return chunks.groupBy(F.coalesce(kind, F.lit("none")).alias("chunk_type")).agg(F.count("*").alias("n"), F.count(embedding).alias("n_embedded"))


def distributions(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of each column's values, blanks left out, in one pass over the documents."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return docs.select(pairs).select("x.*").filter(F.trim("value") != "").groupBy("field", "value").agg(F.count("*").alias("n"))


def job_active(status: Column, started: Column, now: Column, stale_seconds: int = 3600) -> Column:
    """Whether a job runs and its start is not older than the staleness window."""
    return F.coalesce((status == "running") & (now - started <= stale_seconds), F.lit(False))


def pooled_provenance(df: DataFrame, value: str, weight: str, article: str, group: list[str]) -> DataFrame:
    """A pooled estimate of each group with the number of studies and the ids of its articles in order, each once; weights below or at zero, or missing, count as 1."""
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(1.0)
    rows = df.filter(F.col(value).isNotNull()).withColumns({"_v": F.col(value).cast("double"), "_w": w})
    sums = rows.groupBy(*group).agg(F.count("*").alias("n_studies"), F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("_v")).alias("_sv"), F.sum(F.col("_w") * F.col("_v") * F.col("_v")).alias("_svv"), F.array_sort(F.collect_set(article)).alias("provenance"))
    mean = F.col("_sv") / F.col("_sw")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_svv") / F.col("_sw") - mean * mean))
    return sums.select(*group, "n_studies", mean.alias("value"), (mean - 1.96 * sd).alias("ci_low"), (mean + 1.96 * sd).alias("ci_high"), "provenance")


def pico_export(docs: DataFrame, payload: str = "pico_json", key: str = "doc_id") -> DataFrame:
    """The rows that an export of extracted records holds: documents with a whole record, its confidence in whole per cent."""
    rows = docs.withColumn("_p", T.pico(F.col(payload))).filter("_p is not null")
    return rows.select(key, "title", "year", "journal", F.col("_p.study_design").alias("study_design"), F.floor(F.col("_p.pico_confidence") * 100 + 0.5).cast("int").alias("confidence_pct"), *[F.col(f"_p.{c}").alias(c) for c in ("P", "I", "C", "O", "pico_notes")])
