"""Queries over corpora: membership, dedup, screening and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks, corpus, dedup, filters
from ..session import table
from ..sources import enrichment


def _title(text: Column | None = None) -> Column:
    """A document's first line."""
    return F.substring_index(F.col("text") if text is None else text, "\n", 1)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def filter_blank_ignored(spark: SparkSession, sf: str) -> DataFrame:
    return filters.where(_docs(spark, sf), {"lang": "en", "source": "", "journal": None}).groupBy("source").agg(F.count("*").alias("n"))


def membership_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents of good quality are a scenario's members."""
    links = table(spark, sf, "labels").filter("quality = 1").select(F.lit("sc-a").alias("scenario_id"), F.col("doc_id").alias("document_id"))
    found = filters.where(_docs(spark, sf).select("doc_id", "lang"), {"scenario_type": "sc-a"}, links)
    return found.groupBy("lang").agg(F.count("*").alias("n"))


def membership_diff(spark: SparkSession, sf: str) -> DataFrame:
    """By source: long documents against labelled ones."""
    docs = _docs(spark, sf).select("doc_id", "source", "n_chars")
    labelled = table(spark, sf, "labels").select("doc_id").join(docs, "doc_id")
    return corpus.membership_diff(docs.filter("n_chars > 1000"), labelled, "source", "doc_id")


def dedup_exact_min_id(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.canonical_by(_docs(spark, sf).select("doc_id", F.md5("text").alias("key")), F.col("key")).filter("is_duplicate").select("doc_id", "canonical_id")


def dedup_title_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of titles in any script that are equal after normalisation, accents folded."""
    return _title_groups(_docs(spark, sf).select("doc_id", _title().alias("title")))


def _title_groups(rows: DataFrame) -> DataFrame:
    keyed = rows.select("doc_id", T.title_hash(F.col("title")).alias("key")).filter("key is not null")
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("canonical_id")).filter("n > 1")


def dedup_impact(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.removable(_docs(spark, sf).select(F.md5("text").alias("key")), "key")


def dedup_soft(spark: SparkSession, sf: str) -> DataFrame:
    """By the whole text, then by the first line within a source."""
    rows = _docs(spark, sf).select("doc_id", F.md5("text").alias("a"), F.md5(F.concat_ws("|", "source", _title())).alias("b"))
    return dedup.soft_dedup(rows, ["a", "b"]).filter("is_duplicate").select("doc_id", "canonical_id")


def dedup_fuzzy_block(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select(F.col("doc_id").alias("id"), _title().alias("title"))
    return dedup.fuzzy_groups(rows)


def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).withColumn("year", (2010 + F.col("doc_id") % 15).cast("int"))
    score = dedup.quality_score(F.col("n_chars") > 2000, F.col("text"), F.col("doc_id") % 300, F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.col("year"))
    return docs.select("doc_id", F.round(score, 4).alias("score"))


def canonical_pick(spark: SparkSession, sf: str) -> DataFrame:
    """The best order of each customer: the dearest, then the smallest key."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    out = dedup.survivors(orders, "o_custkey", "o_totalprice", "o_orderkey", ["o_orderpriority", "o_orderstatus"], ["o_totalprice"])
    return out.select("o_custkey", "o_orderkey", "n_rows", "o_orderpriority", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


def survivorship(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of a nation, some values blanked; gaps are filled from the next best."""
    c = table(spark, sf, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")))
    c = c.withColumn("c_name", F.when(F.col("c_custkey") % 2 == 0, F.lit(None)).otherwise(F.col("c_name")))
    out = dedup.survivors(c, "c_nationkey", "c_acctbal", "c_custkey", ["c_name", "c_mktsegment"], ["c_acctbal"])
    return out.select("c_nationkey", "c_custkey", "n_rows", "c_name", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select("doc_id", F.posexplode(chunks.paragraphs(F.col("text"))).alias("chunk_index", "content"))
    return rows.select("doc_id", "chunk_index", F.length("content").alias("n_chars"), T.token_count(F.col("content")).alias("n_tokens"))


def chunk_structured(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and abstracts as weighted chunks."""
    docs = _docs(spark, sf).select(F.col("doc_id").alias("id"), _title().alias("title"), F.expr("substring(text, length(substring_index(text, chr(10), 1)) + 2)").alias("abstract"))
    out = chunks.structured(docs, sections=None)
    return out.groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.round(F.sum("chunk_weight"), 2).alias("weight"), F.sum(F.col("char_end").cast("long")).alias("chars"))


def chunk_keep_one(spark: SparkSession, sf: str) -> DataFrame:
    """Of each conversation, one turn: an assistant's if there is one, then the first."""
    turns = table(spark, sf, "conversations").withColumn("embedding", F.when(F.col("role") == "assistant", F.lit(1)))
    return dedup.keep_one(turns, "conv_id", "embedding", "turn").select("conv_id", "turn", "role")


def legacy_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as chunks of unknown kind; the first turn is also the document's title_abstract."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), "turn", F.col("text").alias("content"))
    whole = turns.filter("turn = 0").select("document_id", F.lit(-1).cast("long").alias("turn"), "content", F.lit("title_abstract").alias("chunk_type"))
    rows = turns.withColumn("chunk_type", F.lit(None).cast("string")).unionByName(whole)
    return dedup.legacy_chunks(rows).groupBy("status").agg(F.count("*").alias("n"))


def _screened(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as decisions: good and harmless ones are included, toxic ones excluded, the rest pending."""
    docs = _docs(spark, sf).select("doc_id", "source", "lang", "n_chars")
    decision = F.when(F.col("toxic") == 1, "excluded").when(F.col("quality") == 1, "included").when(F.col("quality") == 0, "pending")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left").withColumn("decision", decision)


_SCREEN_SQL = "SELECT d.doc_id, source, lang, n_chars, CASE WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 THEN 'included' WHEN quality = 0 THEN 'pending' END AS decision FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def prisma_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.prisma_funnel(_screened(spark, sf), F.col("n_chars").cast("double"), 1000.0, F.col("n_chars") > 3000, F.col("decision"), ["lang"])


def screening_progress(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.screening_progress(_screened(spark, sf), F.col("decision"), ["source"])


def cohen_kappa(spark: SparkSession, sf: str) -> DataFrame:
    """Quality and harmlessness as two raters."""
    rows = table(spark, sf, "labels").select(F.col("quality").cast("string").alias("a"), (1 - F.col("toxic")).cast("string").alias("b"))
    out = corpus.cohen_kappa(rows, "a", "b")
    return out.select("n", "agreements", "conflicts", *[F.round(c, 6).alias(c) for c in ("po", "pe", "kappa")], "reading")


def agreement_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.agreement_matrix(table(spark, sf, "labels"), "quality", "toxic")


def corpus_stats_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.heatmap(_docs(spark, sf), "lang", "source", F.col("n_chars") > 3000)


def fulltext_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.coverage(_docs(spark, sf), {"fulltext": F.col("n_chars") > 3000, "short": F.col("n_chars") < 200}, ["source"])


def embedding_status(spark: SparkSession, sf: str) -> DataFrame:
    """By language: documents, and those with a vector of their id."""
    docs = filters.flag_linked(_docs(spark, sf).select("doc_id", "lang"), table(spark, sf, "embeddings").select("vec_id"), "doc_id", "vec_id", "embedded")
    return corpus.coverage(docs, {"embedded": F.col("embedded")}, ["lang"])


def filter_options(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.options(_docs(spark, sf), ["lang", "source"])


def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.null_profile(_screened(spark, sf), ["decision", "lang", "source"]).withColumn("null_share", F.round("null_share", 6))


def evidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).withColumn("year", (2000 + F.col("doc_id") % 24).cast("int"))
    return corpus.evidence_summary(docs, "year", "n_chars", {"with_text": F.length("text") > 0, "english": F.col("lang") == "en"})


def evidence_top(spark: SparkSession, sf: str) -> DataFrame:
    """A brief's ten articles: of good quality first, then the longest, with an excerpt of each."""
    docs = _docs(spark, sf).join(table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    order = [F.col("quality").desc_nulls_last(), F.col("n_chars").desc_nulls_last(), F.col("doc_id")]
    return corpus.top_articles(docs, order, 10, ["doc_id", "lang", "n_chars", "quality"], "text")


def keyword_classifier(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("promo", "offer"), ("steel", "metal"), ("brass", "metal"), ("tin", "metal"), ("small", "size"), ("large", "size")]
    rows = table(spark, sf, "part").select(T.first_rule(F.concat_ws(" ", "p_type", "p_name"), rules).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def doc_tags(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select(T.document_tags(F.col("text")).alias("t")).select("t.*")
    return rows.agg(*[F.count_if(F.col(t)).alias(t) for t in T.TAGS])


def section_weight(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(k) for k in T.WEIGHTS]), (F.col("doc_id") % len(T.WEIGHTS) + 1).cast("int"))
    rows = _docs(spark, sf).select("doc_id", kinds.alias("kind"), "text")
    return rows.select("doc_id", T.chunk_weight(F.col("kind"), F.col("text")).alias("weight")).groupBy("weight").agg(F.count("*").alias("n"))


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.token_count(F.col("text")).cast("long").alias("n_tokens"))


def title_norms(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.title_norm(_title()).alias("title_norm")).filter(F.length("title_norm") >= 20)


def identifier_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers made of order keys, in the forms that sources write them."""
    o = table(spark, sf, "orders").select("o_orderkey")
    key = F.col("o_orderkey").cast("string")
    o = o.select("o_orderkey", F.concat(F.lit("HTTPS://doi.org/10.1/"), key, F.lit("/")).alias("doi"), F.concat(F.lit("pmid:"), key).alias("ext"), F.concat(F.lit("PMC"), F.lpad(key, 7, "0")).alias("pmc"), F.concat(F.lit("https://openalex.org/W"), key).alias("oa"))
    return o.select("o_orderkey", T.normalize_doi(F.col("doi")).alias("doi"), T.content_key(F.col("ext")).alias("key"), T.clean_pmcid(F.col("pmc")).alias("pmcid"), T.clean_id(F.col("oa")).alias("openalex"))


def inverted_index_text(spark: SparkSession, sf: str) -> DataFrame:
    """The words of each order's priority put back in order from an inverted index."""
    o = table(spark, sf, "orders").select("o_orderkey", F.map_from_arrays(F.array(F.concat(F.lit("p"), F.col("o_orderpriority")), F.lit("of"), F.lit("order")), F.array(F.array(F.lit(2).cast("bigint"), F.lit(0).cast("bigint")), F.array(F.lit(1).cast("bigint")), F.array(F.lit(3).cast("bigint")))).alias("index"))
    return o.select("o_orderkey", T.inverted_index_text(F.col("index")).alias("text"))


def insert_new(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that an insert keyed by (source, first line) would add to those with even ids."""
    rows = _docs(spark, sf).select("doc_id", "source", F.md5(_title()).alias("k"))
    return filters.insert_new(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"), ["source", "k"], order="doc_id").select("doc_id")


def update_from(spark: SparkSession, sf: str) -> DataFrame:
    """Account balances of customers after an update from a part of them, by segment."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.filter("c_custkey % 5 = 0").select("c_custkey", F.lit("MERGED").alias("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 10).alias("c_acctbal"))
    out = filters.update_from(c, new, ["c_custkey"], ["c_mktsegment", "c_acctbal"])
    return out.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("c_acctbal").alias("n_balance"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def hard_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, chunks and links before and after duplicates go with what hangs on them."""
    docs = dedup.canonical_by(_docs(spark, sf).select(F.col("doc_id").alias("id"), F.md5("text").alias("k")), F.col("k"), "id").select("id", "canonical_id", "is_duplicate")
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), "turn")
    links = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), F.lit("sc").alias("scenario_id"))
    parts = dedup.purge(docs, turns, links)
    out = None
    for name, df in sorted(parts.items()):
        row = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def repointed_links(spark: SparkSession, sf: str) -> DataFrame:
    docs = dedup.canonical_by(_docs(spark, sf).select("doc_id", F.md5("text").alias("k")), F.col("k"))
    moved = docs.filter("is_duplicate").select(F.col("doc_id").alias("old_id"), F.col("canonical_id").alias("keep_id"))
    links = table(spark, sf, "labels").select(F.concat(F.lit("sc-"), F.col("quality").cast("string")).alias("scenario_id"), F.col("doc_id").alias("document_id"))
    return filters.repoint(links, moved).groupBy("scenario_id").agg(F.count("*").alias("n"), F.sum("document_id").alias("ids"))


def capped_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 longest documents of each source; the cap is the feature."""
    return filters.cap_per_source(_docs(spark, sf), 20, newest="n_chars").groupBy("source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def corpus_page(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return filters.page(docs, "score", 5000.0, 25, 25).select("doc_id", "score")


def enrichment_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as documents, orders as works: by identifier, then by title; the status by identifier only."""
    name = lambda n: F.concat(F.lit("report number "), n.cast("string"))
    docs = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("10.1/"), F.col("c_custkey").cast("string"))).alias("doi"), name(F.col("c_custkey") % 9).alias("title"))
    works = table(spark, sf, "orders").select(F.col("o_orderkey").alias("work_id"), F.concat(F.lit("10.1/"), F.col("o_orderkey").cast("string")).alias("doi"), name(F.col("o_orderkey") % 7).alias("title"), F.col("o_orderkey").alias("cited"), F.col("o_orderstatus").alias("type"))
    return enrichment.enrich(docs, works, ["cited"], works, ["type"]).select("c_custkey", "cited", "type")


def backfill_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' segments and countries from three sources, the first that has a value."""
    c = table(spark, sf, "customer")
    docs = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("journal"), F.lit(None).cast("string").alias("country"))
    a = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("").alias("journal"), F.lit("A").alias("country"))
    b = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("B").alias("journal"), F.lit("B").alias("country"))
    d = c.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.lit("D").alias("journal"))
    return enrichment.backfill(docs, [a, b, d]).groupBy("journal", "country").agg(F.count("*").alias("n"))


_MD = "md5(text)"
_T1 = "split_part(text, chr(10), 1)"

QUERIES = {f.__name__: f for f in (
    filter_blank_ignored, membership_semi, membership_diff, dedup_exact_min_id, dedup_title_hash, dedup_impact, dedup_soft, dedup_fuzzy_block,
    quality_score, canonical_pick, survivorship, chunk_rows, chunk_structured, chunk_keep_one, legacy_partition, prisma_funnel, screening_progress,
    cohen_kappa, agreement_matrix, corpus_stats_heatmap, fulltext_coverage, embedding_status, filter_options, null_profile, evidence_summary, evidence_top,
    keyword_classifier, doc_tags, section_weight, token_counts, title_norms, identifier_forms, inverted_index_text, insert_new, update_from,
    hard_dedup, repointed_links, capped_sources, corpus_page, enrichment_lookup, backfill_fields,
)}


def _any(words: list[str], text: str = "text") -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def _weight_sql(kind: str, text: str) -> str:
    base = "CASE " + kind + " " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in T.WEIGHTS.items()) + " ELSE 1.0 END"
    bonus = " + ".join(f"CASE WHEN {_any(w, text)} THEN {b}::DOUBLE ELSE 0 END" for w, b in T.BONUSES)
    return f"round(({base})::DOUBLE + {bonus} + CASE WHEN regexp_matches({text}, '\\b\\d{{4}}\\b') THEN 0.03::DOUBLE ELSE 0 END, 3)"


_CANON = f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {_MD}) AS canonical_id FROM documents"
_TOKENS = "len(regexp_extract_all({0}, '[^ \\t\\n\\x0B\\f\\r]+'))"

SQL = {
    "filter_blank_ignored": "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source",
    "membership_semi": "SELECT lang, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) GROUP BY lang",
    "membership_diff": "WITH a AS (SELECT DISTINCT source, doc_id FROM documents WHERE n_chars > 1000), b AS (SELECT DISTINCT source, d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id), x AS (SELECT coalesce(a.source, b.source) AS source, a.doc_id AS a, b.doc_id AS b FROM a FULL JOIN b ON a.source = b.source AND a.doc_id = b.doc_id) SELECT source, count(a) AS n_a, count(b) AS n_b, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (WHERE b IS NULL) AS n_lost, count(*) FILTER (WHERE a IS NULL) AS n_gained, count(a) > 0 AND count(b) = 0 AS emptied FROM x GROUP BY source",
    "dedup_exact_min_id": f"SELECT * FROM ({_CANON}) WHERE canonical_id < doc_id",
    "dedup_title_hash": f"WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower({_T1})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents) SELECT md5(t) AS key, count(*) AS n, min(doc_id) AS canonical_id FROM t WHERE length(t) >= 10 GROUP BY t HAVING count(*) > 1",
    "dedup_impact": f"SELECT count(*) AS n_groups, coalesce(sum(n - 1), 0)::BIGINT AS n_removable FROM (SELECT count(*) AS n FROM documents GROUP BY {_MD} HAVING count(*) > 1)",
    "dedup_soft": f"WITH m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_MD}) AS a, min(doc_id) OVER (PARTITION BY source, {_T1}) AS b FROM documents) SELECT doc_id, CASE WHEN a < doc_id THEN a ELSE b END AS canonical_id FROM m WHERE a < doc_id OR b < doc_id",
    "quality_score": "SELECT doc_id, round(least(CASE WHEN n_chars > 2000 THEN 40.0 ELSE 0 END + CASE WHEN length(text) > 200 THEN 20.0 WHEN length(text) > 0 THEN 10.0 ELSE 0 END + least((doc_id % 300) / 10.0, 20.0) + CASE WHEN source <> '' THEN 5.0 ELSE 0 END + CASE WHEN lang <> '' THEN 5.0 ELSE 0 END + CASE WHEN 2010 + doc_id % 15 >= 2018 THEN 5.0 ELSE 0 END, 100.0)::DOUBLE, 4) AS score FROM documents",
    "canonical_pick": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n_rows FROM orders) SELECT o_custkey, o_orderkey, n_rows, o_orderpriority, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM r WHERE r = 1",
    "survivorship": "WITH c AS (SELECT c_nationkey, c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) SELECT c_nationkey, arg_min(c_custkey, r) AS c_custkey, count(*) AS n_rows, arg_min(name, r) FILTER (WHERE name <> '') AS c_name, arg_min(seg, r) FILTER (WHERE seg <> '') AS c_mktsegment, round(max(c_acctbal), 2) AS c_acctbal FROM c GROUP BY c_nationkey",
    "chunk_keep_one": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'assistant') DESC, turn) AS n FROM conversations) WHERE n = 1",
    "legacy_partition": "WITH w AS (SELECT conv_id, text AS whole FROM conversations WHERE turn = 0) SELECT CASE WHEN length(trim(text)) < 20 THEN 'junk' WHEN EXISTS (SELECT 1 FROM w WHERE w.conv_id = c.conv_id AND contains(whole, trim(text))) THEN 'redundant' ELSE 'unique' END AS status, count(*) AS n FROM conversations c GROUP BY 1",
    "prisma_funnel": f"WITH s AS ({_SCREEN_SQL}), f AS (SELECT lang, n_chars >= 1000 AS above, n_chars > 3000 AS ft, coalesce(decision = 'included', FALSE) AS inc, coalesce(decision = 'excluded', FALSE) AS exc FROM s) SELECT lang, count(*) AS identified, count(*) FILTER (WHERE above) AS above_threshold, count(*) FILTER (WHERE NOT above) AS below_threshold, count(*) FILTER (WHERE above AND ft) AS with_fulltext, count(*) FILTER (WHERE inc) AS included, count(*) FILTER (WHERE exc) AS excluded, count(*) FILTER (WHERE inc AND NOT above) AS rescued, count(*) FILTER (WHERE exc AND above) AS vetoed, count(*) FILTER (WHERE inc OR (above AND NOT exc)) AS evidence FROM f GROUP BY lang",
    "screening_progress": f"WITH s AS ({_SCREEN_SQL}) SELECT source, count(*) AS total, count(*) FILTER (WHERE decision IN ('included', 'excluded', 'maybe')) AS screened, count(*) FILTER (WHERE decision = 'included') AS included, count(*) FILTER (WHERE decision = 'excluded') AS excluded, count(*) FILTER (WHERE decision = 'maybe') AS maybe, round(100.0::DOUBLE * count(*) FILTER (WHERE decision IN ('included', 'excluded', 'maybe')) / count(*), 1) AS pct FROM s GROUP BY source",
    "cohen_kappa": "WITH r AS (SELECT quality AS a, 1 - toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS agreements FROM r), m AS (SELECT sum(x.c::DOUBLE * y.c) AS ab FROM (SELECT a, count(*) AS c FROM r GROUP BY a) x JOIN (SELECT b, count(*) AS c FROM r GROUP BY b) y ON a = b), k AS (SELECT n, agreements, agreements / n::DOUBLE AS po, ab / (n::DOUBLE * n) AS pe FROM t, m) SELECT n::BIGINT AS n, agreements, (n - agreements)::BIGINT AS conflicts, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa, CASE WHEN (po - pe) / (1 - pe) >= 0.61 THEN 'substantial' WHEN (po - pe) / (1 - pe) >= 0.41 THEN 'moderate' ELSE 'weak' END AS reading FROM k",
    "agreement_matrix": "SELECT quality AS first, toxic AS second, count(*) AS n FROM labels GROUP BY quality, toxic",
    "corpus_stats_heatmap": "SELECT lang, source, count(*) AS total, count(*) FILTER (WHERE n_chars > 3000) AS fulltext, grouping(lang, source)::INT AS level FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())",
    "fulltext_coverage": "SELECT source, count(*) AS total, count(*) FILTER (WHERE n_chars > 3000) AS fulltext, count(*) FILTER (WHERE n_chars < 200) AS short, round(100.0::DOUBLE * count(*) FILTER (WHERE n_chars > 3000) / count(*), 1) AS fulltext_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE n_chars < 200) / count(*), 1) AS short_pct FROM documents GROUP BY source",
    "embedding_status": "SELECT lang, count(*) AS total, count(*) FILTER (WHERE e) AS embedded, round(100.0::DOUBLE * count(*) FILTER (WHERE e) / count(*), 1) AS embedded_pct FROM (SELECT lang, doc_id IN (SELECT vec_id FROM embeddings) AS e FROM documents) GROUP BY lang",
    "filter_options": "SELECT DISTINCT 'lang' AS field, lang AS value FROM documents WHERE trim(lang) <> '' UNION ALL SELECT DISTINCT 'source', source FROM documents WHERE trim(source) <> ''",
    "null_profile": f"WITH s AS ({_SCREEN_SQL}) SELECT 'decision' AS field, round(avg((decision IS NULL)::INT), 6) AS null_share FROM s UNION ALL SELECT 'lang', round(avg((lang IS NULL)::INT), 6) FROM s UNION ALL SELECT 'source', round(avg((source IS NULL)::INT), 6) FROM s",
    "evidence_summary": "SELECT count(*) AS n, min(2000 + doc_id % 24)::INT AS year_min, max(2000 + doc_id % 24)::INT AS year_max, round(avg(n_chars), 2) AS citations_avg, max(n_chars) AS citations_max, count(*) FILTER (WHERE length(text) > 0) AS with_text, count(*) FILTER (WHERE lang = 'en') AS english FROM documents",
    "evidence_top": "WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), r AS (SELECT row_number() OVER (ORDER BY quality DESC NULLS LAST, n_chars DESC NULLS LAST, doc_id)::INT AS place, doc_id, lang, n_chars, quality, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents LEFT JOIN q USING (doc_id) QUALIFY place <= 10) SELECT place, doc_id, lang, n_chars, quality, CASE WHEN length(t) > 300 THEN rtrim(t[1:300], ' ') || '…' ELSE t END AS excerpt FROM r",
    "keyword_classifier": "SELECT CASE WHEN contains(t, 'promo') THEN 'offer' WHEN contains(t, 'steel') THEN 'metal' WHEN contains(t, 'brass') THEN 'metal' WHEN contains(t, 'tin') THEN 'metal' WHEN contains(t, 'small') THEN 'size' WHEN contains(t, 'large') THEN 'size' END AS category, count(*) AS n FROM (SELECT lower(concat_ws(' ', p_type, p_name)) AS t FROM part) GROUP BY 1",
    "doc_tags": "SELECT " + ", ".join(f"count(*) FILTER (WHERE {_any(w)}) AS {t}" for t, w in T.TAGS.items()) + " FROM documents",
    "section_weight": f"WITH k AS (SELECT [{', '.join(repr(k) for k in T.WEIGHTS)}][(doc_id % {len(T.WEIGHTS)} + 1)::INT] AS kind, text FROM documents), w AS (SELECT {_weight_sql('kind', 'text')} AS weight FROM k) SELECT weight, count(*) AS n FROM w GROUP BY weight",
    "token_counts": f"SELECT doc_id, {_TOKENS.format('text')}::BIGINT AS n_tokens FROM documents",
    "title_norms": f"SELECT * FROM (SELECT doc_id, trim(regexp_replace(lower({_T1}), '[^a-z0-9]+', ' ', 'g')) AS title_norm FROM documents) WHERE length(title_norm) >= 20",
    "identifier_forms": "SELECT o_orderkey, '10.1/' || o_orderkey AS doi, 'ext:' || o_orderkey AS key, 'PMC' || lpad(o_orderkey::VARCHAR, 7, '0') AS pmcid, o_orderkey::VARCHAR AS openalex FROM orders",
    "inverted_index_text": "SELECT o_orderkey, 'p' || o_orderpriority || ' of p' || o_orderpriority || ' order' AS text FROM orders",
    "insert_new": f"SELECT min(doc_id) AS doc_id FROM documents d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.source = d.source AND split_part(e.text, chr(10), 1) = split_part(d.text, chr(10), 1)) GROUP BY source, {_T1}",
    "update_from": "SELECT seg AS c_mktsegment, count(*) AS n, count(bal) AS n_balance, round(sum(bal), 2) AS balance FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'MERGED' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal WHEN c_custkey % 2 = 0 THEN c_acctbal + 10 END AS bal FROM customer) GROUP BY seg",
    "hard_dedup": f"WITH c AS ({_CANON}), x AS (SELECT doc_id FROM c WHERE canonical_id < doc_id) SELECT 'backup_chunks' AS part, count(*) AS n FROM conversations WHERE conv_id IN (SELECT doc_id FROM x) UNION ALL SELECT 'backup_documents', count(*) FROM x UNION ALL SELECT 'backup_links', count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM x) UNION ALL SELECT 'chunks', count(*) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM x) UNION ALL SELECT 'documents', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM x) UNION ALL SELECT 'links', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM x)",
    "repointed_links": f"WITH c AS ({_CANON}), l AS (SELECT DISTINCT 'sc-' || quality AS scenario_id, canonical_id FROM labels JOIN c USING (doc_id)) SELECT scenario_id, count(*) AS n, sum(canonical_id)::BIGINT AS ids FROM l GROUP BY scenario_id",
    "capped_sources": "SELECT source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 20 GROUP BY source",
    "corpus_page": "SELECT doc_id, n_chars::DOUBLE AS score FROM documents ORDER BY (n_chars >= 5000) DESC, n_chars DESC, doc_id LIMIT 25 OFFSET 25",
    "enrichment_lookup": "WITH t AS (SELECT o_orderkey % 7 AS k, min(o_orderkey) AS cited FROM orders GROUP BY 1) SELECT c_custkey, coalesce(o_orderkey, cited) AS cited, o_orderstatus AS type FROM customer LEFT JOIN orders ON c_custkey % 2 = 0 AND o_orderkey = c_custkey LEFT JOIN t ON c_custkey % 9 = k",
    "backfill_fields": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'B' WHEN c_custkey % 5 = 0 THEN 'D' ELSE c_mktsegment END AS journal, CASE WHEN c_custkey % 3 = 0 THEN 'A' WHEN c_custkey % 2 = 0 THEN 'B' END AS country, count(*) AS n FROM customer GROUP BY 1, 2",
}
