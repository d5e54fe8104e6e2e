"""The queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, covertree, ctph, egojoin, hardneg, html, kneserney, lines, mixing, simhash, substrings, suffixes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The production tokenizer; its files belong to an installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = kneserney.score(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.select("doc_id", kneserney.held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeated_words(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = covertree.integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = covertree.top_k(vectors.filter("id % 100 = 0"), vectors, k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.drop_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_lines_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its earlier name: op5_lines judges every line that is not blank, too."""
    return op5_lines(spark, sf_dir)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.length("text").cast("long").alias("n_chars"), "text")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.tokenize(docs, tokenizer_path(), decoded="decoded")
    return coded.select(
        "doc_id",
        bpe.n_tokens("ids").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op11_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.with_next(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label, scale=256.0)


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_substring": op2_substring,
    "op3_topk": op3_topk,
    "op4_suffix": op4_suffix,
    "op5_lines": op5_lines,
    "op5_lines_all": op5_lines_all,
    "op6_html": op6_html,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_embeddings": op10_embeddings,
    "op11_ctph": op11_ctph,
    "op12_negatives": op12_negatives,
    "op13_filters": op13_filters,
}

_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS s
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (
  SELECT a, p, ps, b, s, row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b) AS rank
  FROM p JOIN s USING (a) WHERE NOT same AND 50 * ps <= 100 * s AND 100 * s <= 95 * ps
)
SELECT a AS anchor_id, p AS positive_id, rank::INT AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE rank <= 3
"""

_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (
  SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w
),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
n AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT v.c || w.c || x.c || y.c || z.c AS filter_order FROM c v, c w, c x, c y, c z
  WHERE w.c <> v.c AND x.c NOT IN (v.c, w.c) AND y.c NOT IN (v.c, w.c, x.c) AND z.c NOT IN (v.c, w.c, x.c, y.c)
),
b AS (SELECT filter_order, i AS step, (1 << (ascii(substr(filter_order, i, 1)) - 65))::INT AS own FROM o, generate_series(1, 5) s(i)),
s AS (SELECT *, coalesce(sum(own) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before FROM b),
r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE mask & (own | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM n, s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM r
"""

#: Where SQL can't express a query or would be too slow on whole tables, there is none; tests/llm has brute-force versions.
SQL: dict[str, str] = {"op12_negatives": _NEGATIVES, "op13_filters": _AUDIT}
