"""Queries that keep a corpus and its models: lookups, signals, exports, inserts under conditions, chunk repair, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, places
from ..functions import text as T
from ..operators import dedup, epidemic, filters, graph, models, partitions, upkeep
from ..session import table, unused_path

#: Names of variables as they come from extraction, in two languages.
NAMES = ("Daily new cases", "Décès cumulés", "R0", "serial interval", "Temperature (mean)", "cas actifs", "at-risk population", "Immunity duration", "taux_d_attaque", "vaccination rate", "presymptomatic share", "case fatality")
LABELS = ("France, Europe", "atlantis", "Suisse Romande", "somewhere / Italy", "world", "Genève", "australia", " u.s. ", "north france", "Vaud;Jura")
PHRASES = ("early warning in Suisse romande", "trends of the world", "no place at all", "from Geneva to France", "Brésil et Japon", "USA vs UK", "eu-wide data", "Unknown")


def _pick(values: tuple[str, ...], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def variable_series(spark: SparkSession, sf: str) -> DataFrame:
    """What variables' names say about the epidemic model."""
    name = F.concat(_pick(NAMES, "c_custkey"), F.lit(" "), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", places.series_column(name).alias("series"), places.is_parameter(name).alias("is_parameter"))


def place_population(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", places.population(_pick(LABELS, "c_custkey")).alias("population"))


def place_in_text(spark: SparkSession, sf: str) -> DataFrame:
    found = places.population_in(F.concat(_pick(PHRASES, "c_custkey"), F.lit(" - "), F.col("c_name")))
    return table(spark, sf, "customer").select("c_custkey", found["population"].alias("population"), found["label"].alias("label"))


def provenance_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids as texts, some of them no numbers, twice or unknown."""
    key = F.col("c_custkey")
    ids = F.array((key + 1).cast("string"), F.lit("x"), key.cast("string"), F.concat(F.lit(" "), key.cast("string")), F.lit(None).cast("string"), F.lit("-5"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(T.valid_ids(ids, F.array(key, key + 1, key + 2)), ",").alias("ids"))


def fractions(spark: SparkSession, sf: str) -> DataFrame:
    """Discounts written in per cent by some."""
    li = table(spark, sf, "lineitem").select("l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount") * 100 + 2).otherwise(F.col("l_discount")).alias("d"))
    return li.groupBy("l_linenumber").agg(F.round(F.avg(T.as_fraction(F.col("d"))), 6).alias("share"))


def _pico(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with an extracted record each: whole ones, ones without a key, broken ones and none."""
    key = F.col("c_custkey")
    whole = F.struct(F.col("c_mktsegment").alias("P"), F.lit("i").alias("I"), F.lit("c").alias("C"), F.lit("o").alias("O"), F.lit("cohort").alias("study_design"), (key % 100 / 100).alias("pico_confidence"))
    less = F.struct(F.lit("p").alias("P"), F.lit("i").alias("I"))
    payload = F.when(key % 4 == 0, F.to_json(whole)).when(key % 4 == 1, F.to_json(less)).when(key % 4 == 2, "{broken")
    return table(spark, sf, "customer").select(key.alias("doc_id"), F.col("c_name").alias("title"), (2000 + key % 20).cast("int").alias("year"), F.lit(None).cast("string").alias("journal"), payload.alias("pico_json"))


def pico_valid(spark: SparkSession, sf: str) -> DataFrame:
    return _pico(spark, sf).select("doc_id", T.pico(F.col("pico_json")).isNotNull().alias("valid"))


def pico_export(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.pico_export(_pico(spark, sf))


#: The library's rules, with some that the words of the test tables meet.
SIGNAL_RULES = T.SIGNALS | {"demand": [*T.SIGNALS["demand"], "thon", "erin"], "horizon": [*T.SIGNALS["horizon"], "wh*"], "border": [*T.SIGNALS["border"], "of the", "que*"]}


def evidence_signals(spark: SparkSession, sf: str) -> DataFrame:
    """By kind, documents that hold a signal, and how strong documents are in all."""
    rows = T.with_signals(table(spark, sf, "documents").select("text"), "text", "s", SIGNAL_RULES)
    rows = rows.select(T.evidence_strength(F.col("s"), rules=SIGNAL_RULES).alias("strength"), *[(F.size(F.col("s")[k]) > 0).alias(k) for k in SIGNAL_RULES])
    return rows.groupBy("strength").agg(F.count("*").alias("n"), *[F.count_if(F.col(k)).alias(k) for k in SIGNAL_RULES])


def signal_words(spark: SparkSession, sf: str) -> DataFrame:
    """Which words were found, by kind: documents of each."""
    rows = T.with_signals(table(spark, sf, "documents").select("text"), "text", "s", SIGNAL_RULES)
    named = lambda k: F.transform(F.col("s")[k], lambda w: F.struct(F.lit(k).alias("kind"), w.alias("rule")))
    each = F.explode(F.flatten(F.array(*[named(k) for k in SIGNAL_RULES])))
    return rows.select(each.alias("x")).groupBy("x.kind", "x.rule").agg(F.count("*").alias("n"))


def search_vector_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as chunks: terms by weight, and places of all of them."""
    v = table(spark, sf, "part").select(F.explode(upkeep.search_vector(F.col("p_brand"), F.concat_ws(" ", "p_name", "p_brand", "p_type"))).alias("v"))
    return v.groupBy("v.term", "v.weight").agg(F.count("*").alias("n"), F.sum(F.size("v.positions")).alias("places")).select("term", "weight", "n", "places")


def search_vector_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as chunks under their source: documents and places of each stem; stop words have places but are no terms."""
    docs = table(spark, sf, "documents").filter("lang = 'en'")
    v = upkeep.with_search_vector(docs.select("source", "text"), "source", "text", "v").select(F.explode("v").alias("v"))
    return v.groupBy("v.term", "v.weight").agg(F.count("*").alias("n"), F.sum(F.size("v.positions")).alias("places")).select("term", "weight", "n", "places")


def embedding_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as they go to an embedder, with its limits on words and characters."""
    return table(spark, sf, "documents").select("doc_id", F.md5(upkeep.embedding_input(F.col("text"))).alias("digest"))


def embedding_update(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in embedder: the length of each text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = upkeep.embed(docs, lambda texts: [[float(len(t))] for t in texts], "doc_id", "text")
    return out.select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("v"))


def insert_unique_where(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as records under a conditional key: one order of a customer and status, where it is dear; cheap ones all go in."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    out = upkeep.insert_where(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["o_custkey", "o_orderstatus"], F.col("o_totalprice") > 100000, "o_orderkey")
    return out.select("o_orderkey")


def link_backfill(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("scenario"))
    links = docs.filter("doc_id % 5 = 0").select(F.col("scenario").alias("scenario_id"), F.col("doc_id").alias("document_id"))
    return upkeep.backfill_links(docs, links, "scenario").groupBy("scenario_id").agg(F.count("*").alias("n"), F.count("similarity_score").alias("scored"))


def orphan_check(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.orphans(table(spark, sf, "conversations"), table(spark, sf, "documents").filter("doc_id % 2 = 0"), "conv_id", "doc_id")


def new_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as documents, statuses as scenarios made at the mean order date."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("scenario_id"), F.unix_timestamp("o_orderdate").alias("created_at"))
    born = o.groupBy("scenario_id").agg(F.floor(F.avg("created_at")).alias("created_at"))
    return upkeep.flag_new(o, born).groupBy("scenario_id").agg(F.count_if("is_new").alias("n_new"), F.count("*").alias("n"))


def corpus_union(spark: SparkSession, sf: str) -> DataFrame:
    """Even documents are local, odd ones fresh; one source applied the query itself."""
    docs = table(spark, sf, "documents")
    out = upkeep.corpus_union(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), F.contains(F.lower("text"), F.lit("the")), F.col("lang") == "de")
    return out.agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def chunk_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as chunks: the first two of a conversation are its heads; documents without a conversation get one of their text."""
    t = table(spark, sf, "conversations")
    chunks = t.select(F.col("conv_id").alias("document_id"), F.when(F.col("turn") < 2, "title_abstract").otherwise("fulltext_section").alias("chunk_type"), F.when(F.col("role") == "assistant", F.lit(1)).alias("embedding"), F.col("turn").alias("chunk_id"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit("").alias("title"), F.col("text").alias("abstract"))
    return upkeep.repair_chunks(chunks, docs)[2]


def content_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """By an external id with or without its prefix, of documents that have one, else by their text."""
    ext = F.when(F.col("doc_id") % 3 == 0, F.concat(F.when(F.col("doc_id") % 2 == 0, "pmid:").otherwise(""), F.floor(F.col("doc_id") / 6).cast("string")))
    return upkeep.content_groups(table(spark, sf, "documents"), [T.content_key(ext), F.md5("text")])


def chunk_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.when(F.col("turn") > 0, F.col("role")).alias("chunk_type"), F.when(F.col("turn") % 2 == 0, F.lit(1)).alias("embedding"))
    return upkeep.chunk_types(rows)


def field_distributions(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.distributions(table(spark, sf, "documents"), ["lang", "source"])


def active_jobs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), F.unix_timestamp("o_orderdate").alias("started"))
    now = F.unix_timestamp(F.lit("1996-01-01 00:00:00").cast("timestamp"))
    return o.groupBy("status").agg(F.count_if(upkeep.job_active(F.col("status"), F.col("started"), now, 86400 * 365)).alias("active"), F.count("*").alias("n"))


def pooled_studies(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_discount", F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).alias("w"), "l_linenumber")
    out = upkeep.pooled_provenance(li, "l_discount", "w", "l_linenumber", ["l_suppkey"])
    return out.select("l_suppkey", "n_studies", *[F.round(c, 6).alias(c) for c in ("value", "ci_low", "ci_high")], F.array_join("provenance", ",").alias("provenance"))


def hull_corners(spark: SparkSession, sf: str) -> DataFrame:
    """The corners of the hull of each nation's customers in the plane of key and balance."""
    c = table(spark, sf, "customer").select("c_nationkey", F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    return graph.convex_hull(c, "c_nationkey").select("c_nationkey", "x", "y")


def day_offsets(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    out = dates.day_offsets(o, "day", ["o_orderstatus"])
    return out.select("o_orderkey", "offset", dates.horizon(F.col("offset").cast("int")).alias("horizon"))


def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    out = models.class_shares(table(spark, sf, "lineitem"), "l_returnflag")
    return out.select("class", "n", F.round("share", 6).alias("share"), "rare")


def holdout_stratified(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth of each class is held out, to the row."""
    train, test = models.holdout(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), None, "o_orderkey", 0.2, "o_orderstatus")
    rows = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return rows.groupBy("o_orderstatus", "part").agg(F.count("*").alias("n"))


def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("s"))
    return models.classification_metrics(li, "y", "s", 25.0).select(F.round("average_precision", 6).alias("average_precision"), F.round("roc_auc", 6).alias("roc_auc"))


def survey_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in free text as a band."""
    o = table(spark, sf, "orders").select("o_orderkey", T.number_band(F.concat(F.lit("from "), (F.col("o_orderkey") % 50).cast("string"), F.lit(" to "), (F.col("o_orderkey") % 90 / 4).cast("string"), F.lit(" %"))).alias("b"))
    return o.select("o_orderkey", "b.low", "b.high")


def finite_numbers(spark: SparkSession, sf: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("1.5", "NaN", "abc", "", "1e3", "Infinity"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", T.finite(text).alias("v"))


def exact_passes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as records: by identifier, then by title."""
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(key.alias("id"), F.when(key % 4 == 0, F.concat(F.lit("10.2/"), (key % 40).cast("string"))).alias("doi"), F.when(key % 4 == 1, (key % 60).cast("string")).alias("pmid"), F.concat(F.lit("long title number "), (key % 30).cast("string")).alias("title"))
    return dedup.exact_groups(rows).groupBy("pass").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def replaced_chunks(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), "turn", F.when(F.col("turn") > 0, "fulltext_section").otherwise("title_abstract").alias("chunk_type"))
    fresh = t.filter("document_id % 3 = 0 and turn = 1").withColumn("turn", F.lit(100).cast("long"))
    return filters.replace_partition(t, fresh).groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum("turn").alias("turns"))


def replaced_in_place(spark: SparkSession, sf: str) -> DataFrame:
    """The same repair on a stored table, of which only the touched partitions are rewritten."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), "turn", F.when(F.col("turn") > 0, "fulltext_section").otherwise("title_abstract").alias("chunk_type"))
    path = unused_path(spark, "chunks")
    partitions.write(t, path, "document_id", 32)
    partitions.replace_chunks(t.filter("document_id % 3 = 0 and turn = 1").withColumn("turn", F.lit(100).cast("long")), path, 32)
    return partitions.read(t, path).groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum("turn").alias("turns"))


def live_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each customer by balance, missing ones as zero."""
    from pyspark.sql import Window as W

    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("score"))
    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.coalesce("score", F.lit(0)).desc(), "c_custkey"))
    return c.select("c_custkey", place.alias("place"))


def seir_calibrate(spark: SparkSession, sf: str) -> DataFrame:
    """A season for each region with an R0 of its own, scaled down, sampled weekly and calibrated side by side."""
    sets = table(spark, sf, "region").select("r_regionkey", (1.5 + 0.4 * F.col("r_regionkey")).alias("r0"), F.lit(7.0).alias("infectious_period_days"), F.lit(4.0).alias("incubation_period_days"))
    seen = epidemic.simulate_all(sets, 90, ["r_regionkey"]).filter("day % 7 = 0").select("r_regionkey", "day", (0.3 * F.col("incidence")).alias("value"))
    return epidemic.calibrate_all(seen, {"infectious_period_days": 7.0, "incubation_period_days": 4.0}, "r_regionkey").select("r_regionkey", F.round("r0", 3).alias("r0"))


def seir_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of one season that begin some days in, by region; shift and scale are found again."""
    params = {"r0": 2.0, "infectious_period_days": 6.0, "incubation_period_days": 3.0}
    whole = epidemic.simulate(spark, params, 160).select("day", "incidence")
    seen = whole.crossJoin(F.broadcast(table(spark, sf, "region").select("r_regionkey")))  # five regions
    seen = seen.filter(F.col("day").between(20 + 6 * F.col("r_regionkey"), 120)).select("r_regionkey", "day", (0.25 * F.col("incidence")).alias("value"))
    out = epidemic.shifts_all(seen, params, "r_regionkey", 60.0)
    return out.select("r_regionkey", F.round("shift", 2).alias("shift"), F.round("scale", 3).alias("scale"))


def importances_by_variable(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the variables in a price model."""
    li = table(spark, sf, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_discount", "l_returnflag", "l_extendedprice")
    got = models.train(li, "l_extendedprice", ["l_quantity", "l_discount", "l_returnflag"], family="random_forest", key="id", numTrees=5)
    return spark.createDataFrame(sorted(got["importances_by_variable"].items()), "variable string, importance double")


QUERIES = {f.__name__: f for f in (
    variable_series, place_population, place_in_text, provenance_ids, fractions, pico_valid, pico_export, evidence_signals, signal_words, search_vector_terms,
    search_vector_stems, embedding_inputs, embedding_update, insert_unique_where, link_backfill, orphan_check, new_flags, corpus_union, chunk_repair, content_duplicates,
    chunk_type_counts, field_distributions, active_jobs, pooled_studies, hull_corners, day_offsets, class_balance, holdout_stratified,
    average_precision, survey_bands, finite_numbers, exact_passes, replaced_chunks, replaced_in_place, live_order, seir_calibrate, seir_shift, importances_by_variable,
)}


def _choice(values: tuple[str, ...], key: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


def _plain(text: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({text})), '[^a-z0-9]+', ' ', 'g'))"


def _held(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_SERIES = " ".join(f"WHEN {_held('t', words)} THEN '{name}'" for name, words in places.SERIES_WORDS.items())
_PARAMETER = " OR ".join(f"contains(' ' || t || ' ', ' {w} ')" for w in places.PARAMETER_WORDS) + " OR " + _held("t", places.PARAMETER_PARTS)
_POPULATION = ", ".join("({}, '{}', {}::DOUBLE)".format(i, k.replace("'", "''"), v) for i, (k, v) in enumerate(places.POPULATION.items()))


def _rule(rule: str) -> str:
    """Whether the words w of a text meet a rule anywhere that no negator stands shortly before."""
    parts = [f"coalesce(starts_with(w[i + {j}], '{p[:-1]}'), FALSE)" if p.endswith("*") else f"coalesce(w[i + {j}] = '{p}', FALSE)" for j, p in enumerate(rule.split())]
    negators = ", ".join(f"'{n}'" for n in T.NEGATORS)
    return f"len(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(parts)} AND len(list_filter(w[greatest(1, i - 3):i - 1], lambda n: n IN ({negators}))) = 0)) > 0"


_SIGNAL_WORDS = r"WITH t AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents)"
_KINDS = {k: "(" + " OR ".join(map(_rule, rules)) + ")" for k, rules in SIGNAL_RULES.items()}
_STRENGTH = " + ".join(f"{k}::INT" for k in SIGNAL_RULES)

#: At most 7500 words and 20,000 characters of a text on one line; null for blank texts.
_INPUT = r"""
WITH l AS (SELECT doc_id, trim(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS t FROM documents), w AS (SELECT *, string_split_regex(t, ' +') AS w FROM l),
i AS (SELECT doc_id, CASE WHEN t <> '' THEN rtrim(left(CASE WHEN len(w) > 7500 THEN array_to_string(w[1:7500], ' ') ELSE t END, 20000)) END AS t FROM w)
"""

SQL = {
    "variable_series": f"WITH n AS (SELECT c_custkey, {_plain(_choice(NAMES, 'c_custkey') + chr(32) + '||' + chr(39) + ' ' + chr(39) + '||c_mktsegment')} AS t FROM customer) SELECT c_custkey, CASE {_SERIES} END AS series, ({_PARAMETER}) AS is_parameter FROM n",
    "place_population": f"WITH p(i, k, v) AS (VALUES {_POPULATION}), l AS (SELECT c_custkey, lower(trim({_choice(LABELS, 'c_custkey')})) AS w FROM customer), s AS (SELECT c_custkey, unnest(list_prepend(w, list_transform(string_split(regexp_replace(w, '[/;|]', ',', 'g'), ','), lambda x: trim(x)))) AS part, generate_subscripts(list_prepend(w, string_split(regexp_replace(w, '[/;|]', ',', 'g'), ',')), 1) AS n FROM l), f AS (SELECT c_custkey, arg_min(v, n) AS population FROM s JOIN p ON part = k GROUP BY c_custkey) SELECT c_custkey, population FROM customer LEFT JOIN f USING (c_custkey)",
    "place_in_text": f"WITH p(i, k, v) AS (VALUES {_POPULATION}), t AS (SELECT c_custkey, ' ' || {_plain(_choice(PHRASES, 'c_custkey') + chr(32) + '|| chr(32) || c_name')} || ' ' AS t FROM customer), f AS (SELECT c_custkey, arg_min(v, v * 1000 + i) AS v, arg_min(k, v * 1000 + i) AS k FROM t JOIN p ON contains(t, ' ' || {_plain('k')} || ' ') GROUP BY c_custkey) SELECT c_custkey, v AS population, k AS label FROM customer LEFT JOIN f USING (c_custkey)",
    "provenance_ids": "SELECT c_custkey, (c_custkey + 1) || ',' || c_custkey AS ids FROM customer",
    "fractions": "SELECT l_linenumber, round(avg(CASE WHEN l_linenumber % 2 = 0 THEN l_discount + 0.02 ELSE l_discount END), 6) AS share FROM lineitem GROUP BY l_linenumber",
    "pico_valid": "SELECT c_custkey AS doc_id, c_custkey % 4 = 0 AS valid FROM customer",
    "pico_export": "SELECT c_custkey AS doc_id, c_name AS title, (2000 + c_custkey % 20)::INT AS year, NULL::VARCHAR AS journal, 'cohort' AS study_design, (c_custkey % 100)::INT AS confidence_pct, c_mktsegment AS P, 'i' AS I, 'c' AS C, 'o' AS O, '' AS pico_notes FROM customer WHERE c_custkey % 4 = 0",
    "signal_words": _SIGNAL_WORDS + " " + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{r}' AS rule, count(*) AS n FROM t WHERE {_rule(r)} HAVING count(*) > 0" for k, rules in SIGNAL_RULES.items() for r in rules),
    "evidence_signals": _SIGNAL_WORDS + ", s AS (SELECT " + ", ".join(f"coalesce({h}, FALSE) AS {k}" for k, h in _KINDS.items()) + f" FROM t) SELECT CASE WHEN {_STRENGTH} >= 3 THEN 'strong' WHEN {_STRENGTH} >= 1 THEN 'moderate' ELSE 'weak' END AS strength, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {k}) AS {k}" for k in T.SIGNALS) + " FROM s GROUP BY 1",
    "search_vector_terms": "WITH w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_brand), '[\\p{L}\\p{N}]+')) AS term, 'A' AS weight FROM part UNION ALL SELECT p_partkey, unnest(regexp_extract_all(lower(concat_ws(' ', p_name, p_brand, p_type)), '[\\p{L}\\p{N}]+')), 'B' FROM part), t AS (SELECT p_partkey, term, min(weight) AS weight, count(*) AS c FROM w GROUP BY 1, 2) SELECT term, weight, count(*) AS n, sum(c)::BIGINT AS places FROM t GROUP BY 1, 2",
    "embedding_inputs": _INPUT + "SELECT doc_id, md5(t) AS digest FROM i",
    "embedding_update": _INPUT + "SELECT doc_id, length(t)::DOUBLE AS v FROM i",
    "insert_unique_where": "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 1 AND o_totalprice > 100000) f WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_orderkey % 2 = 0 AND e.o_totalprice > 100000 AND e.o_custkey = f.o_custkey AND e.o_orderstatus = f.o_orderstatus) UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1 AND o_totalprice <= 100000",
    "link_backfill": "SELECT lang AS scenario_id, count(*) AS n, 0::BIGINT AS scored FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND trim(lang) <> '' GROUP BY lang",
    "orphan_check": "SELECT count(*) AS n, count(*) FILTER (WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)) AS n_orphans FROM conversations",
    "new_flags": "WITH o AS (SELECT o_orderstatus AS scenario_id, floor(epoch(o_orderdate)) AS t FROM orders), b AS (SELECT scenario_id, floor(avg(t)) AS b FROM o GROUP BY 1) SELECT scenario_id, count(*) FILTER (WHERE t >= b) AS n_new, count(*) AS n FROM o JOIN b USING (scenario_id) GROUP BY scenario_id",
    "corpus_union": "SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE contains(lower(text), 'the') AND (doc_id % 2 = 0 OR length(text) >= 30) OR doc_id % 2 = 1 AND length(text) >= 30 AND lang = 'de'",
    "chunk_repair": "SELECT (SELECT count(*) FROM conversations) AS n_before, (SELECT count(*) FROM conversations WHERE turn >= 2) + (SELECT count(DISTINCT conv_id) FROM conversations WHERE turn < 2) AS n_kept, count(*) FILTER (WHERE trim(text) <> '') AS n_recovered, count(*) FILTER (WHERE coalesce(trim(text), '') = '') AS n_empty FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)",
    "content_duplicates": "WITH k AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ext:' || (doc_id // 6) ELSE md5(text) END AS k FROM documents), m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS canonical_id FROM k WHERE k IS NOT NULL) SELECT * FROM m WHERE canonical_id < doc_id",
    "chunk_type_counts": "SELECT CASE WHEN turn > 0 THEN role ELSE 'none' END AS chunk_type, count(*) AS n, count(*) FILTER (WHERE turn % 2 = 0) AS n_embedded FROM conversations GROUP BY 1",
    "field_distributions": "SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents WHERE trim(lang) <> '' GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE trim(source) <> '' GROUP BY source",
    "active_jobs": "SELECT CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS status, count(*) FILTER (WHERE o_orderstatus = 'O' AND epoch(TIMESTAMP '1996-01-01') - epoch(o_orderdate) <= 31536000) AS active, count(*) AS n FROM orders GROUP BY 1",
    "pooled_studies": "WITH s AS (SELECT l_suppkey, l_discount AS v, CASE WHEN l_linenumber > 2 AND l_quantity > 0 THEN l_quantity ELSE 1.0 END AS w, l_linenumber AS a FROM lineitem), m AS (SELECT l_suppkey, count(*) AS n, sum(w * v) / sum(w) AS mean, sqrt(greatest(0, sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2)) AS sd, string_agg(DISTINCT a::VARCHAR, ',' ORDER BY a::VARCHAR) AS p FROM s GROUP BY l_suppkey) SELECT l_suppkey, n AS n_studies, round(mean, 6) AS value, round(mean - 1.96 * sd, 6) AS ci_low, round(mean + 1.96 * sd, 6) AS ci_high, p AS provenance FROM m",
    "hull_corners": """
WITH p AS (SELECT DISTINCT c_nationkey AS g, c_custkey::DOUBLE AS x, c_acctbal::DOUBLE AS y FROM customer WHERE c_custkey IS NOT NULL AND c_acctbal IS NOT NULL),
t AS (
  SELECT a.g, a.x, a.y, b.x AS bx, b.y AS by_, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn,
    (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) AS along, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS far
  FROM p a JOIN p b ON a.g = b.g AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON a.g = c.g),
e AS (SELECT g, x, y FROM t GROUP BY g, x, y, bx, by_ HAVING bool_and(turn > 0 OR turn = 0 AND along BETWEEN 0 AND far))
SELECT DISTINCT g AS c_nationkey, x, y FROM e
UNION ALL SELECT g, min(x), min(y) FROM p GROUP BY g HAVING count(*) = 1""",
    "day_offsets": "WITH d AS (SELECT o_orderkey, o_orderdate::DATE - min(o_orderdate::DATE) OVER (PARTITION BY o_orderstatus) AS d FROM orders) SELECT o_orderkey, d::DOUBLE AS \"offset\", greatest(1, least(d, 3650))::INT AS horizon FROM d",
    "class_balance": "WITH c AS (SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1) SELECT class, n, round(n / sum(n) OVER (), 6) AS share, n / sum(n) OVER () < 0.1 AS rare FROM c",
    "holdout_stratified": "WITH r AS (SELECT o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 = 0 AS t FROM orders) SELECT o_orderstatus, CASE WHEN t THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM r GROUP BY 1, 2",
    "average_precision": "WITH r AS (SELECT (l_returnflag = 'R')::INT AS y, l_quantity AS s FROM lineitem), g AS (SELECT s, count(*) AS n, sum(y) AS p FROM r GROUP BY s), c AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s) - n AS below, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM g) SELECT round((sum(p * cp::DOUBLE / cn) / max(tp))::DOUBLE, 6) AS average_precision, round(((sum(p * (below + (n + 1) / 2.0)) - max(tp) * (max(tp) + 1) / 2.0) / (max(tp)::DOUBLE * (max(tn) - max(tp))))::DOUBLE, 6) AS roc_auc FROM c",
    "survey_bands": "SELECT o_orderkey, least(o_orderkey % 50, (o_orderkey % 90) / 4.0)::DOUBLE AS low, greatest(o_orderkey % 50, (o_orderkey % 90) / 4.0)::DOUBLE AS high FROM orders",
    "finite_numbers": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1.5 WHEN 4 THEN 1000.0 END::DOUBLE AS v FROM orders",
    "exact_passes": "WITH d AS (SELECT c_custkey, c_custkey % 40 AS k, count(*) OVER (PARTITION BY c_custkey % 40) AS n FROM customer WHERE c_custkey % 4 = 0), p AS (SELECT c_custkey, count(*) OVER (PARTITION BY c_custkey % 60) AS n FROM customer WHERE c_custkey % 4 = 1), u AS (SELECT c_custkey FROM d WHERE n > 1 UNION ALL SELECT c_custkey FROM p WHERE n > 1), t AS (SELECT c_custkey, count(*) OVER (PARTITION BY c_custkey % 30) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM u)) SELECT 'doi' AS pass, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM d WHERE n > 1 HAVING count(*) > 0 UNION ALL SELECT 'pmid', count(*), sum(c_custkey)::BIGINT FROM p WHERE n > 1 HAVING count(*) > 0 UNION ALL SELECT 'title', count(*), sum(c_custkey)::BIGINT FROM t WHERE n > 1 HAVING count(*) > 0",
    "replaced_chunks": "WITH k AS (SELECT CASE WHEN turn > 0 THEN 'fulltext_section' ELSE 'title_abstract' END AS chunk_type, turn FROM conversations c WHERE turn = 0 OR NOT (conv_id % 3 = 0 AND EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = 1)) UNION ALL SELECT 'fulltext_section', 100 FROM conversations WHERE conv_id % 3 = 0 AND turn = 1) SELECT chunk_type, count(*) AS n, sum(turn)::BIGINT AS turns FROM k GROUP BY 1",
    "live_order": "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 4 <> 0 THEN coalesce(c_acctbal, 0) ELSE 0 END DESC, c_custkey)::INT AS place FROM customer",
    "seir_calibrate": "SELECT r_regionkey, round((1.5 + 0.4 * r_regionkey)::DOUBLE, 3) AS r0 FROM region",
    "seir_shift": "SELECT r_regionkey, round((20 + 6 * r_regionkey)::DOUBLE, 2) AS shift, 0.25::DOUBLE AS scale FROM region",
}
SQL["replaced_in_place"] = SQL["replaced_chunks"]
for _slow in ("signal_words", "evidence_signals"):  # a copy of the text for each of its words: too slow on long texts; tests hold the rules to cases
    del SQL[_slow]
