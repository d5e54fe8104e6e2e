"""Queries over texts and vectors: the boolean language, facets, search and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import density, graph, neighbours, search, text_index, vector_index
from ..session import table, unused_path
from . import boolean as B

_LOW = "lower(text)"


def _matches(query: str, *extra: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
        found = B.search(docs, query, "text")
        return found.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("n_long"))

    return run


def _matches_sql(condition: str) -> str:
    return f"SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE n_chars > 1000) AS n_long FROM documents WHERE {condition} GROUP BY lang, source"


def bool_not_per_document(spark: SparkSession, sf: str) -> DataFrame:
    """A document's turns are its chunks; NOT excludes the whole document."""
    turns = table(spark, sf, "conversations")
    docs = turns.select(F.col("conv_id").alias("doc_id")).distinct().withColumn("title", F.lit(None).cast("string"))
    chunks = turns.select(F.col("conv_id").alias("doc_id"), F.col("text").alias("content"))
    return B.search_with_chunks(docs, chunks, "the NOT this", "title").select("doc_id")


_A, _B, _C = "the", "of AND and", '"in the" OR est'
_SA, _SB, _SC = (
    f"contains({_LOW}, 'the')", f"(contains({_LOW}, 'of') AND contains({_LOW}, 'and'))", f"(contains({_LOW}, 'in the') OR contains({_LOW}, 'est'))",
)


def _facets(ops: list[str | None], combinator: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        facets = [{"kind": "boolean", "text": t, "op": op} for t, op in zip((_A, _B, _C), ops)]
        return B.facet_ids(table(spark, sf, "documents").select("doc_id", "text"), facets, combinator)

    return run


def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    return B.facet_counts(table(spark, sf, "documents").select("doc_id", "text"), [_A, _B, _C], "text")


def evidence_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """A fingerprint for the ids of each source."""
    ids = table(spark, sf, "documents").groupBy("source").agg(F.collect_list("doc_id").alias("ids"))
    return ids.select("source", B.evidence_fingerprint(F.col("ids"), 0.45, None, "brief").alias("fingerprint"))


#: A fixed query vector of 64 components.
QUERY = [round(((i * 37) % 17 - 8) / 8.0, 4) for i in range(64)]
_COS = "list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))"
_VEC = f"SELECT vec_id, label, embedding::DOUBLE[] AS e, [{', '.join(map(str, QUERY))}]::DOUBLE[] AS q FROM embeddings"


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = search.nearest(table(spark, sf, "embeddings"), QUERY, 12)
    return found.select("vec_id", F.round("similarity", 5).alias("similarity"))


def vector_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors by an index of all of them, read cell by cell until no other can hold a nearer one."""
    index = vector_index.build(table(spark, sf, "embeddings"), unused_path(spark, "vectors"))
    return index.nearest(spark, QUERY, 12).select("vec_id", F.round("similarity", 5).alias("similarity"))


def vector_index_many(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of each label to its mean's direction, among all labels, by the same index for all queries."""
    e = table(spark, sf, "embeddings")
    index = vector_index.build(e, unused_path(spark, "vectors"))
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    found = index.nearest_of_many(means, "label", "mean", 5)
    return found.select("label", "rank", "vec_id", F.round("similarity", 5).alias("similarity"))


#: Words of a search, rare and frequent, one of them twice and one in no text.
BM25_QUERY = "Water energy, the und zzyzx of Water est"


def bm25_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best documents by BM25, from an inverted index of all texts."""
    index = text_index.build(table(spark, sf, "documents").select("doc_id", "text"), unused_path(spark, "texts"), buckets=16)
    return index.top(spark, BM25_QUERY, 20).select("doc_id", F.round("score", 5).alias("score"))


def bm25_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """The 60 best by words from the inverted index, ranked again by a blend with the cosine."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, sf, "documents").select("doc_id", "text").join(e, "doc_id", "left_semi")
    index = text_index.build(docs, unused_path(spark, "texts"), buckets=16)
    first = index.top(spark, BM25_QUERY, 60).withColumnRenamed("score", "lexical")
    return search.reranked(first.join(e, "doc_id"), QUERY, k=10).select("doc_id", F.round("score", 5).alias("score"))


def screened_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Labels stand for decisions: 0 excluded, 1 included; those of label 2 are duplicates."""
    rows = table(spark, sf, "embeddings").withColumn("decision", F.when(F.col("label") == 0, "excluded").when(F.col("label") == 1, "included"))
    rows = rows.withColumn("is_duplicate", F.col("label") == 2)
    found = search.screened(rows, QUERY, 8, 0.0, included_first=True, key="vec_id")
    return found.select("vec_id", F.round("similarity", 5).alias("similarity"))


def scenario_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and best similarity of each label's vectors to the query."""
    rows = search.with_similarity(table(spark, sf, "embeddings"), QUERY)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 5).alias("mean_similarity"), F.round(F.max("similarity"), 5).alias("best"))


_TERMS = ["the", "of", "und"]


def lexical_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.lexical(table(spark, sf, "documents").select("doc_id", "text"), _TERMS)
    return rows.select("doc_id", F.round("lexical", 4).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(20)


def _lexical_sql() -> str:
    tf = ", ".join(f"(length({_LOW}) - length(replace({_LOW}, '{t}', ''))) / {len(t)}.0 AS t{i}" for i, t in enumerate(sorted(_TERMS)))
    df = ", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS d{i}" for i in range(3))
    score = " + ".join(f"CASE WHEN d{i} > 0 THEN ln(1 + t{i}) * ln(1 + n::DOUBLE / d{i}) ELSE 0 END" for i in range(3))
    return f"WITH r AS (SELECT doc_id, {tf} FROM documents), d AS (SELECT count(*) AS n, {df} FROM r) SELECT doc_id, round({score}, 4) AS score FROM r, d ORDER BY score DESC, doc_id LIMIT 20"


def hybrid_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the vector of the same id; all with any of the terms are ranked."""
    docs = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return search.hybrid(docs, _TERMS, QUERY, first=None).select("doc_id", F.round("score", 5).alias("score"))


def hybrid_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """As hybrid_rank, with the feature's first stage: the 60 best by words alone are ranked again."""
    docs = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return search.hybrid(docs, _TERMS, QUERY, first=60).select("doc_id", F.round("score", 5).alias("score"))


def _hybrid_sql(first: str = "") -> str:
    tf = ", ".join(f"(length({_LOW}) - length(replace({_LOW}, '{t}', ''))) / {len(t)}.0 AS t{i}" for i, t in enumerate(sorted(_TERMS)))
    df = ", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS d{i}" for i in range(3))
    score = " + ".join(f"CASE WHEN d{i} > 0 THEN ln(1 + t{i}) * ln(1 + n::DOUBLE / d{i}) ELSE 0 END" for i in range(3))
    return (
        f"WITH v AS ({_VEC}), r AS (SELECT doc_id, e, q, {tf} FROM documents JOIN v ON vec_id = doc_id), d AS (SELECT count(*) AS n, {df} FROM r), "
        f"s AS (SELECT doc_id, {score} AS lex, {_COS} AS c FROM r, d), f AS (SELECT * FROM s WHERE lex > 0{first}) "
        "SELECT doc_id, round(0.5 * c + 0.5 * lex / (SELECT max(lex) FROM f), 5) AS score FROM f ORDER BY 0.5 * c + 0.5 * lex / (SELECT max(lex) FROM f) DESC, doc_id LIMIT 10"
    )


_NORM = lambda v: f"sqrt(list_dot_product({v}, {v}))"


def _bm25_sql(docs: str = "documents") -> str:
    """Scores of all documents with a term of the query, by the formula."""
    terms = "SELECT DISTINCT unnest(regexp_extract_all(lower('" + BM25_QUERY + "'), '[\\p{L}\\p{N}]+')) AS term"
    return (
        f"w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {docs}), "
        "s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w), "
        f"c AS (SELECT doc_id, term, len(w) AS length, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM w) WHERE term IN ({terms}) GROUP BY ALL), "
        "f AS (SELECT term, count(*) AS df FROM c GROUP BY term), "
        "b AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))) AS score FROM c JOIN f USING (term), s GROUP BY doc_id)"
    )


#: Nodes of a drawn graph: as many as come nearest to the query.
_NODES = 300


def knn_graph_degree(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees in the similarity graph of a drawing's nodes, of which there are at most 400."""
    nodes = search.nearest(table(spark, sf, "embeddings"), QUERY, _NODES)
    return graph.degrees(nodes, graph.similarity_edges(nodes, 0.35))


def graph_communities(spark: SparkSession, sf: str) -> DataFrame:
    nodes = search.nearest(table(spark, sf, "embeddings"), QUERY, _NODES)
    return graph.communities(nodes, graph.similarity_edges(nodes, 0.5))


def knn_votes(spark: SparkSession, sf: str) -> DataFrame:
    """The label that the nine nearest other vectors give each fiftieth one."""
    e = table(spark, sf, "embeddings")
    found = neighbours.nearest(e.filter("vec_id % 50 = 0"), e, 9, "vec_id", "embedding", others=True)
    return neighbours.votes(found, e, "vec_id", "label")


def nearest_customers(spark: SparkSession, sf: str) -> DataFrame:
    """For each supplier, the three customers nearest in balance (in thousands) and nation."""
    place = lambda p: F.array(F.col(f"{p}_acctbal").cast("double") / 1000, F.col(f"{p}_nationkey").cast("double"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), place("c").alias("vector"))
    asked = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), place("s").alias("vector"))
    found = neighbours.nearest(asked, rows, 3)
    return found.select(F.col("query_id").alias("s_suppkey"), "rank", F.col("id").alias("c_custkey"), F.round("distance", 6).alias("distance"))


def cluster_vectors(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.clusters(table(spark, sf, "embeddings"), 8)
    return out.groupBy("cluster", "method").agg(F.count("*").alias("n"), F.count_if("noise").alias("n_noise"))


def cluster_density(spark: SparkSession, sf: str) -> DataFrame:
    return density.clusters(table(spark, sf, "embeddings"), samples=5, least=10)


def cluster_words(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_words(table(spark, sf, "documents").select("lang", "text"), "text", "lang").select("lang", "rank", "word", "n")


def cluster_topics(spark: SparkSession, sf: str) -> DataFrame:
    return graph.topics(table(spark, sf, "documents").select("text"), "text", 4).select("topic", "word", F.round("weight", 6).alias("weight"))


def label_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of each vector to its label's mean vector, by label."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    rows = e.join(means, "label").select("label", cosine(F.col("embedding"), F.col("mean")).alias("s"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("s"), 5).alias("mean_similarity"))


QUERIES = {
    "bool_and_or_not": _matches("(the OR and) NOT zzz"),
    "bool_phrase_groups": _matches('("in the" OR "of the"[Title/Abstract]) AND (and OR that)'),
    "bool_implicit_and": _matches("of and NOT the"),
    "bool_empty_false": _matches("[dp] ()"),
    "bool_not_per_document": bool_not_per_document,
    "facet_union": _facets([None] * 3, "union"),
    "facet_intersection": _facets([None] * 3, "intersection"),
    "facet_left_fold": _facets([None, "or", "and"], "union"),
    "facet_counts": facet_counts,
    "evidence_fingerprint": evidence_fingerprint,
    "vector_topk": vector_topk,
    "vector_index_topk": vector_index_topk,
    "vector_index_many": vector_index_many,
    "bm25_rank": bm25_rank,
    "bm25_hybrid": bm25_hybrid,
    "screened_retrieval": screened_retrieval,
    "scenario_scores": scenario_scores,
    "lexical_rank": lexical_rank,
    "hybrid_rank": hybrid_rank,
    "hybrid_rerank": hybrid_rerank,
    "knn_graph_degree": knn_graph_degree,
    "knn_votes": knn_votes,
    "nearest_customers": nearest_customers,
    "graph_communities": graph_communities,
    "cluster_vectors": cluster_vectors,
    "cluster_density": cluster_density,
    "cluster_words": cluster_words,
    "cluster_topics": cluster_topics,
    "label_neighbours": label_neighbours,
}

_EDGES = f"WITH v AS (SELECT vec_id, e FROM ({_VEC}) ORDER BY {_COS} DESC, vec_id LIMIT {_NODES}), x AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {{least}})"

SQL = {
    "bool_and_or_not": _matches_sql(f"(contains({_LOW}, 'the') OR contains({_LOW}, 'and')) AND NOT contains({_LOW}, 'zzz')"),
    "bool_phrase_groups": _matches_sql(f"(contains({_LOW}, 'in the') OR contains({_LOW}, 'of the')) AND (contains({_LOW}, 'and') OR contains({_LOW}, 'that'))"),
    "bool_implicit_and": _matches_sql(f"contains({_LOW}, 'of') AND contains({_LOW}, 'and') AND NOT contains({_LOW}, 'the')"),
    "bool_empty_false": _matches_sql("FALSE"),
    "bool_not_per_document": "SELECT conv_id AS doc_id FROM conversations GROUP BY conv_id HAVING bool_or(contains(lower(text), 'the')) AND NOT bool_or(contains(lower(text), 'this'))",
    "facet_union": f"SELECT DISTINCT doc_id FROM documents WHERE {_SA} OR {_SB} OR {_SC}",
    "facet_intersection": f"SELECT DISTINCT doc_id FROM documents WHERE {_SA} AND {_SB} AND {_SC}",
    "facet_left_fold": f"SELECT DISTINCT doc_id FROM documents WHERE ({_SA} OR {_SB}) AND {_SC}",
    "facet_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS facet, count(*) AS n FROM documents WHERE {c}"
        for n, c in (("facet_1", _SA), ("facet_2", _SB), ("facet_3", _SC), ("union", f"{_SA} OR {_SB} OR {_SC}"), ("intersection", f"{_SA} AND {_SB} AND {_SC}"))
    ),
    "evidence_fingerprint": "SELECT source, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) || '|0.45|fr|brief') AS fingerprint FROM documents GROUP BY source",
    "vector_index_topk": f"WITH v AS ({_VEC}) SELECT vec_id, round({_COS}, 5) AS similarity FROM v ORDER BY {_COS} DESC, vec_id LIMIT 12",
    "vector_index_many": (
        "WITH p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i), "
        "m AS (SELECT label, list(m ORDER BY i) AS mean FROM p GROUP BY label), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), "
        f"s AS (SELECT label, vec_id, list_dot_product(mean, e) / ({_NORM('mean')} * {_NORM('e')}) AS s FROM m, v) "
        "SELECT label, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id)::INT AS rank, vec_id, round(s, 5) AS similarity FROM s "
        "QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) <= 5"
    ),
    "bm25_rank": f"WITH {_bm25_sql()} SELECT doc_id, round(score, 5) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 20",
    "bm25_hybrid": (
        f"WITH v AS ({_VEC}), d AS (SELECT * FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)), {_bm25_sql('d')}, "
        f"l AS (SELECT doc_id, score AS lex FROM b ORDER BY score DESC, doc_id LIMIT 60), x AS (SELECT doc_id, 0.5 * {_COS} + 0.5 * lex / (SELECT max(lex) FROM l) AS x FROM l JOIN v ON vec_id = doc_id) "
        "SELECT doc_id, round(x, 5) AS score FROM x ORDER BY x DESC, doc_id LIMIT 10"
    ),
    "vector_topk": f"WITH v AS ({_VEC}) SELECT vec_id, round({_COS}, 5) AS similarity FROM v ORDER BY {_COS} DESC, vec_id LIMIT 12",
    "screened_retrieval": f"WITH v AS ({_VEC}), s AS (SELECT vec_id, label, {_COS} AS c FROM v) SELECT vec_id, round(c, 5) AS similarity FROM s WHERE label <> 0 AND label <> 2 AND c >= 0.0 ORDER BY (label = 1) DESC, c DESC, vec_id LIMIT 8",
    "scenario_scores": f"WITH v AS ({_VEC}) SELECT label, count(*) AS n, round(avg({_COS}), 5) AS mean_similarity, round(max({_COS}), 5) AS best FROM v GROUP BY label",
    "lexical_rank": _lexical_sql(),
    "hybrid_rank": _hybrid_sql(),
    "hybrid_rerank": _hybrid_sql(" ORDER BY lex DESC, doc_id LIMIT 60"),
    "knn_votes": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
n AS (SELECT query_id, label, count(*) AS votes, sum(count(*)) OVER (PARTITION BY query_id)::BIGINT AS n FROM d WHERE rank <= 9 AND label IS NOT NULL GROUP BY query_id, label)
SELECT query_id, label, votes, n FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) = 1""",
    "nearest_customers": """
WITH d AS (
  SELECT s_suppkey::BIGINT AS s_suppkey, c_custkey::BIGINT AS c_custkey, sqrt((s_acctbal::DOUBLE / 1000 - c_acctbal::DOUBLE / 1000) ** 2 + (s_nationkey::DOUBLE - c_nationkey::DOUBLE) ** 2) AS distance
  FROM supplier, customer)
SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, c_custkey)::INT AS rank, c_custkey, round(distance, 6) AS distance FROM d QUALIFY rank <= 3""",
    "knn_graph_degree": _EDGES.format(least=0.35) + ", d AS (SELECT unnest([a, b]) AS vec_id FROM x) SELECT v.vec_id, count(d.vec_id) AS degree FROM v LEFT JOIN d USING (vec_id) GROUP BY v.vec_id",
    "graph_communities": "WITH RECURSIVE " + _EDGES.format(least=0.5).removeprefix("WITH ") + ", y AS (SELECT a, b FROM x UNION ALL SELECT b, a FROM x), r(id, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, y.b FROM r JOIN y ON y.a = r.seen) SELECT id AS vec_id, min(seen) AS community FROM r GROUP BY id",
    "label_neighbours": "WITH p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i), m AS (SELECT label, list(m ORDER BY i) AS mean FROM p GROUP BY label), s AS (SELECT label, list_dot_product(embedding::DOUBLE[], mean) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(mean, mean))) AS s FROM embeddings JOIN m USING (label)) SELECT label, count(*) AS n, round(avg(s), 5) AS mean_similarity FROM s GROUP BY label",
    "cluster_words": r"WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents), n AS (SELECT lang, word, count(*) AS n FROM w WHERE length(word) >= 4 GROUP BY lang, word), g AS (SELECT word, count(*) AS groups FROM n GROUP BY word), s AS (SELECT lang, word, n, n * ln(1 + (SELECT count(DISTINCT lang) FROM documents)::DOUBLE / groups) AS weight FROM n JOIN g USING (word)) SELECT lang, rank::INT AS rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, word) AS rank FROM s) WHERE rank <= 8",
}
