"""Queries that parse landed payloads: literature services and measurement feeds.

The driver's tables hold no payloads, so each query writes its table's rows in a service's
format first, several records to a payload and some of them unusable, and reads them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, timeseries
from ..session import table
from ..sources import literature, signals

def _key() -> Column:
    return F.col("c_custkey").cast("string")


def _title() -> Column:
    return F.concat(F.lit("Study  of "), F.col("c_name"))


def _doi() -> Column:
    return F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("10.7/"), _key()))


def _year() -> Column:
    return (2000 + F.col("c_custkey") % 25).cast("int")


def _id() -> Column:
    return F.when(F.col("c_custkey") % 11 != 0, _key())


def _json(spark: SparkSession, sf: str, record: Column, wrap: Callable[[Column], Column]) -> DataFrame:
    """Customers as records of a service, about twenty to a payload."""
    rows = table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 20)).agg(F.collect_list(record).alias("items"))
    return rows.select(F.to_json(wrap(F.col("items"))).alias("payload"))


def _named(name: str) -> Callable[[Column], Column]:
    return lambda items: F.struct(items.alias(name))


def parse_semantic_scholar(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(_id().alias("paperId"), _title().alias("title"), F.col("c_mktsegment").alias("abstract"), _year().alias("year"), F.struct(_doi().alias("DOI")).alias("externalIds"), F.concat(F.lit("u/"), _key()).alias("url"))
    return literature.semantic_scholar(_json(spark, sf, item, _named("data")))


def parse_doaj(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array(F.struct(F.lit("issn").alias("type"), F.lit("1234").alias("id")), F.struct(F.lit("doi").alias("type"), _doi().alias("id")))
    book = F.struct(_title().alias("title"), F.col("c_mktsegment").alias("abstract"), _year().cast("string").alias("year"), ids.alias("identifier"), F.array(F.struct(F.concat(F.lit("u/"), _key()).alias("url"))).alias("link"))
    return literature.doaj(_json(spark, sf, F.struct(_id().alias("id"), book.alias("bibjson")), _named("results")))


def parse_clinical_trials(spark: SparkSession, sf: str) -> DataFrame:
    section = F.struct(
        F.struct(_id().alias("nctId"), _title().alias("briefTitle")).alias("identificationModule"), F.struct(F.col("c_mktsegment").alias("briefSummary")).alias("descriptionModule"),
        F.struct(F.struct(F.concat(_year().cast("string"), F.lit("-05-01")).alias("date")).alias("startDateStruct")).alias("statusModule"),
    )
    return literature.clinical_trials(_json(spark, sf, F.struct(section.alias("protocolSection")), _named("studies")))


def parse_core(spark: SparkSession, sf: str) -> DataFrame:
    """Some entries are no objects."""
    item = F.struct(_id().cast("long").alias("id"), _title().alias("title"), F.col("c_mktsegment").alias("abstract"), _year().alias("yearPublished"), _doi().alias("doi"), F.concat(F.lit("u/"), _key()).alias("downloadUrl"))
    rows = table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 20)).agg(F.array_join(F.collect_list(F.to_json(item)), ",").alias("items"))
    return literature.core(rows.select(F.concat(F.lit('{"results":["note",7,'), "items", F.lit("]}")).alias("payload")))


def parse_preprints(spark: SparkSession, sf: str) -> DataFrame:
    """Preprints with a DOI in which a third of the terms occur."""
    item = F.struct(_doi().alias("doi"), _title().alias("title"), F.col("c_mktsegment").alias("abstract"), F.concat(_year().cast("string"), F.lit("-03-02")).alias("date"))
    return literature.biorxiv(_json(spark, sf, item, _named("collection")), ["building", "machinery", "of"], "medrxiv")


def parse_europe_pmc(spark: SparkSession, sf: str) -> DataFrame:
    pmc = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("PMC"), _key()))
    item = F.struct(_id().alias("pmid"), pmc.alias("pmcid"), _doi().alias("doi"), _title().alias("title"), F.concat(F.lit("<h4>Aim</h4>"), F.col("c_mktsegment")).alias("abstractText"), _year().cast("string").alias("pubYear"))
    return literature.europe_pmc(_json(spark, sf, item, lambda items: F.struct(F.struct(items.alias("result")).alias("resultList"))))


def parse_openalex(spark: SparkSession, sf: str) -> DataFrame:
    """Abstracts come as an inverted index: segment at 1 and 3, the rest around it."""
    index = F.map_from_arrays(F.array(F.lit("a"), F.concat(F.lit("x"), F.col("c_mktsegment")), F.lit("is")), F.array(F.array(F.lit(0)), F.array(F.lit(1), F.lit(3)), F.array(F.lit(2))))
    item = F.struct(F.concat(F.lit("https://openalex.org/W"), _id()).alias("id"), _doi().alias("doi"), _title().alias("title"), _year().alias("publication_year"), index.alias("abstract_inverted_index"))
    return literature.openalex(_json(spark, sf, item, _named("results")))


def parse_crossref(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(_doi().alias("DOI"), F.array(_title()).alias("title"), F.concat(F.lit("<p>"), F.col("c_mktsegment"), F.lit(" <b>data</b></p>")).alias("abstract"), F.struct(F.array(F.array(_year(), F.lit(4))).alias("date-parts")).alias("created"))
    return literature.crossref(_json(spark, sf, item, lambda items: F.struct(F.struct(items.alias("items")).alias("message"))))


def parse_openaire(spark: SparkSession, sf: str) -> DataFrame:
    """Wrapped texts, DOIs of some."""
    t = lambda c: F.struct(c.alias("$"))
    result = F.struct(F.array(t(_title()), t(F.lit("other"))).alias("title"), t(F.col("c_mktsegment")).alias("description"), t(F.concat(_year().cast("string"), F.lit("-06-01"))).alias("dateofacceptance"), F.when(_doi().isNotNull(), F.array(F.struct(F.lit("doi").alias("@classid"), _doi().alias("$")))).alias("pid"))
    item = F.struct(F.struct(t(_id()).alias("dri:objIdentifier")).alias("header"), F.struct(F.struct(result.alias("oaf:result")).alias("oaf:entity")).alias("metadata"))
    return literature.openaire(_json(spark, sf, item, lambda items: F.struct(F.struct(F.struct(items.alias("result")).alias("results")).alias("response"))))


def parse_openaire_graph(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(_id().alias("id"), _title().alias("mainTitle"), F.array(F.struct(F.col("c_mktsegment").alias("value"))).alias("descriptions"), F.concat(_year().cast("string"), F.lit("-07-09")).alias("publicationDate"), F.array(F.struct(F.lit("pmid").alias("scheme"), F.lit("9").alias("value")), F.struct(F.lit("doi").alias("scheme"), _doi().alias("value"))).alias("pids"))
    return literature.openaire_graph(_json(spark, sf, item, _named("results")))


def _xml(spark: SparkSession, sf: str, entry: Column, begin: str, end: str) -> DataFrame:
    rows = table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 20)).agg(F.concat_ws("", F.collect_list(entry)).alias("items"))
    return rows.select(F.concat(F.lit(begin), "items", F.lit(end)).alias("payload"))


def parse_arxiv(spark: SparkSession, sf: str) -> DataFrame:
    def part(tag: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>")), F.lit(""))

    entry = F.concat(F.lit("<entry>"), part("id", F.concat(F.lit("http://arxiv.org/abs/"), _id())), part("title", _title()), part("summary", F.col("c_mktsegment")), part("published", F.concat(_year().cast("string"), F.lit("-01-15T00:00:00Z"))), part("arxiv:doi", _doi()), F.lit("</entry>"))
    return literature.arxiv(_xml(spark, sf, entry, '<feed xmlns:arxiv="urn:x">', "</feed>"))


def parse_pubmed(spark: SparkSession, sf: str) -> DataFrame:
    """Titles with inline markup, abstracts in two labelled parts."""
    entry = F.concat(
        F.lit("<PubmedArticle><MedlineCitation>"), F.coalesce(F.concat(F.lit('<PMID Version="1">'), _id(), F.lit("</PMID>")), F.lit("")), F.lit("<Article><Journal><JournalIssue><PubDate><Year>"), _year().cast("string"),
        F.lit("</Year></PubDate></JournalIssue></Journal><ArticleTitle>Study <i>of</i> "), F.col("c_name"), F.lit('</ArticleTitle><Abstract><AbstractText Label="AIM">'), F.col("c_mktsegment"),
        F.lit('</AbstractText><AbstractText Label="END">done</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>'),
    )
    return literature.pubmed(_xml(spark, sf, entry, "<PubmedArticleSet>", "</PubmedArticleSet>"))


def full_text_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The first of two candidates with enough running text: a marked-up one with a table in it, and the plain text."""
    docs = table(spark, sf, "documents")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    marked = F.concat(F.lit("<article><body><p>"), escaped, F.lit("</p><table-wrap><p>cells</p></table-wrap></body></article>"))
    rows = docs.select("doc_id", literature.body_text(marked).alias("pmc"), F.col("text").alias("plain"))
    return literature.full_text(rows, "doc_id", ["pmc", "plain"], 500).select("doc_id", "source", F.length("text").alias("n_chars"))


def _hours(spark: SparkSession, sf: str) -> DataFrame:
    """Events as hourly readings of some days."""
    e = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd'T'HH:00").alias("time")).agg(F.round(F.avg("value") / 7, 7).alias("v"), F.round(F.max("value") / 7, 7).alias("w"))
    return e.orderBy("time").groupBy(F.substring("time", 1, 10).alias("day")).agg(F.array_sort(F.collect_list(F.struct("time", "v", "w"))).alias("h"))


def feed_weather(spark: SparkSession, sf: str) -> DataFrame:
    """A payload for each day, the wind array absent."""
    h = _hours(spark, sf)
    daily = F.struct(F.array("day").alias("time"), F.array(F.array_max("h.v")).alias("temperature_2m_max"), F.array(F.array_min("h.v")).alias("temperature_2m_min"))
    hourly = F.struct(F.col("h.time").alias("time"), F.col("h.w").alias("relative_humidity_2m"))
    out = signals.fetch_series("open-meteo-weather", h.select(F.to_json(F.struct(daily.alias("daily"), hourly.alias("hourly"))).alias("payload")))
    return out.select("date", "temp_mean", "temp_max", "temp_min", "wind_speed_max", "relative_humidity_mean")


def feed_air_quality(spark: SparkSession, sf: str) -> DataFrame:
    hourly = F.struct(F.col("h.time").alias("time"), F.col("h.v").alias("pm10"), F.col("h.w").alias("nitrogen_dioxide"))
    return signals.air_quality(_hours(spark, sf).select(F.to_json(F.struct(hourly.alias("hourly"))).alias("payload")))


def feed_generic(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV as texts: a column of words goes, rows without a number go."""
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").cast("string").alias("Key No"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Datum"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("string")).otherwise("n/a").alias("Total Price"), F.col("o_orderpriority").alias("word"))
    out = signals.generic(rows.drop("Key No"))
    return out.groupBy("date").agg(F.count("*").alias("n"), F.round(F.sum("total_price"), 2).alias("total"))


def feed_national(spark: SparkSession, sf: str) -> DataFrame:
    """Days that repeat are folded: populations are summed, other columns averaged; one region of two, in any case."""
    o = table(spark, sf, "orders")
    rows = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderstatus") == "O", "GE").otherwise("VD").alias("geoRegion"), F.round("o_totalprice", 0).cast("string").alias("value"), (F.col("o_orderkey") % 100).cast("string").alias("pop"))
    return signals.national(rows, {"GEOREGION": "ge"})


def feed_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    week = F.concat(F.year("o_orderdate").cast("string"), F.lit("-W"), F.lpad((F.col("o_orderkey") % 52 + 1).cast("string"), 2, "0"))
    rows = o.select(week.alias("week"), F.col("o_orderstatus").alias("region"), F.round(F.col("o_totalprice") / 700, 7).cast("string").alias("inzidenz"))
    out = signals.sentinel(rows, {"Region": "f"})
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "ili_incidence")


def latest_incidence(spark: SparkSession, sf: str) -> DataFrame:
    """The latest week's rate by status; some weeks only have a count."""
    o = table(spark, sf, "orders").groupBy("o_orderstatus", (F.year("o_orderdate") * 100 + F.weekofyear("o_orderdate")).alias("week")).agg(F.count("*").cast("double").alias("inc"))
    item = F.struct("week", F.when(F.col("inc") % 2 == 0, F.col("inc") / 10).alias("inc100"), "inc")
    payload = o.filter("o_orderstatus = 'F'").agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("payload"))
    return signals.latest_incidence(payload).select(F.round("value", 3).alias("value"))


def catalog_resource(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as catalogue entries with two resources, the second of them a CSV of some."""
    s, key = table(spark, sf, "supplier"), F.col("s_suppkey").cast("string")
    kinds = F.array(
        F.struct(F.lit("PDF").alias("format"), F.lit("p").alias("download_url"), F.lit("p").alias("url")),
        F.struct(F.when(F.col("s_suppkey") % 3 == 0, "JSON").otherwise("CSV").alias("format"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("d/"), key)).alias("download_url"), F.concat(F.lit("u/"), key).alias("url")),
    )
    return signals.csv_resource(s.select("s_suppkey", F.to_json(F.struct(F.struct(kinds.alias("resources")).alias("result"))).alias("payload")))


def latest_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Each kind of event's latest payload that parses; those of even ids are cut short."""
    e = table(spark, sf, "events")
    payload = F.to_json(F.struct(F.col("event_id").alias("level"), F.col("user_id").alias("area")))
    rows = e.select(F.col("event_type").alias("feed"), F.col("event_id").alias("taken_at"), F.when(F.col("event_id") % 2 == 0, F.substring(payload, 1, 5)).otherwise(payload).alias("payload"))
    return signals.snapshots(rows, {"level": "long", "area": "long"})


def fold_frequency_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Days of orders within an inclusive window, repeated days folded: flows are summed, prices averaged."""
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit(1.0).alias("flow"), F.sqrt("o_totalprice").alias("price"))
    return timeseries.fold_duplicate_days(filters.between_dates(o, "date", "1995-01-01", "1996-06-30"), ["flow", "price"], digits=2)


def raw_equality(spark: SparkSession, sf: str) -> DataFrame:
    rows = filters.equal_ignoring_case(table(spark, sf, "customer"), {" C_MKTSEGMENT": "building ", "absent": "x"})
    return rows.groupBy("c_nationkey").agg(F.count("*").alias("n"))


def long_texts(spark: SparkSession, sf: str) -> DataFrame:
    return filters.long_enough(table(spark, sf, "documents"), 100, "text", "lang").groupBy("lang").agg(F.count("*").alias("n"))


def region_places(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates of named regions, in any case; the default city's for unknown ones."""
    names = ["Geneva", "lausanne", "ZURICH", "nowhere", "Bern", "basel"]
    found = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (i, signals.place(n)[0])])
    return table(spark, sf, "nation").select("n_nationkey", F.element_at(found, (F.col("n_nationkey") % len(names)).cast("int")).alias("lat"))


def cleaned_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names cut to a width, addresses of some customers, and marked words."""
    c = table(spark, sf, "customer")
    mail = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" User"), _key(), F.lit("@Mail.Example.org "))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("user@"), _key())).otherwise("a@b@c.d")
    return c.select("c_custkey", T.display_name(F.col("c_name"), 12).alias("name"), T.clean_email(mail).alias("email"), T.highlight(F.concat(F.lit("xx "), F.col("c_mktsegment"), F.lit(" yy")), ["building", "machinery"], 80).alias("marked"))


QUERIES = {f.__name__: f for f in (
    parse_semantic_scholar, parse_doaj, parse_clinical_trials, parse_core, parse_preprints, parse_europe_pmc, parse_openalex, parse_crossref, parse_openaire,
    parse_openaire_graph, parse_arxiv, parse_pubmed, full_text_cascade, feed_weather, feed_air_quality, feed_generic, feed_national, feed_sentinel,
    latest_incidence, catalog_resource, latest_snapshots, fold_frequency_mixed, raw_equality, long_texts, region_places, cleaned_names,
)}

_D = "CASE WHEN c_custkey % 3 <> 0 THEN '10.7/' || c_custkey END"
_Y = "(2000 + c_custkey % 25)::INT"


def _documents(id_: str, url: str, kind: str = "article", doi: str = _D, abstract: str = "c_mktsegment", where: str = "c_custkey % 11 <> 0") -> str:
    return f"SELECT {id_} AS external_id, {doi} AS doi, 'Study of ' || c_name AS title, {abstract} AS abstract, {_Y} AS year, {url} AS url, '{kind}' AS source_type FROM customer WHERE {where}"


_HOURS = "WITH h AS (SELECT strftime(ts, '%Y-%m-%d') AS date, round(avg(value) / 7, 7) AS v, round(max(value) / 7, 7) AS w FROM events GROUP BY strftime(ts, '%Y-%m-%d'), hour(ts))"

def _mean(value: str, digits: int) -> str:
    """A mean rounded half away from zero, by whole numbers."""
    total = f"sum(round({value} * 10000000)::HUGEINT)"
    return f"sign({total}) * ((abs({total}) * {2 * 10**digits} + count({value})::HUGEINT * 10000000) // (count({value})::HUGEINT * 20000000))::DOUBLE / {10**digits}"


SQL = {
    "parse_semantic_scholar": _documents("'s2:' || c_custkey", "'u/' || c_custkey"),
    "parse_doaj": _documents("'doaj:' || c_custkey", "'u/' || c_custkey"),
    "parse_clinical_trials": _documents("'nct:' || c_custkey", "'https://clinicaltrials.gov/study/' || c_custkey", "clinical_trial", "NULL::VARCHAR"),
    "parse_core": _documents("'core:' || c_custkey", "'u/' || c_custkey"),
    "parse_preprints": _documents("'medrxiv:10.7/' || c_custkey", "'https://doi.org/10.7/' || c_custkey", "preprint", where="c_custkey % 3 <> 0 AND lower(c_mktsegment) IN ('building', 'machinery')"),
    "parse_europe_pmc": _documents("CASE WHEN c_custkey % 2 = 0 THEN 'PMC' || c_custkey WHEN c_custkey % 11 <> 0 THEN c_custkey::VARCHAR ELSE '10.7/' || c_custkey END", "NULL::VARCHAR", abstract="'Aim ' || c_mktsegment", where="c_custkey % 2 = 0 OR c_custkey % 11 <> 0 OR c_custkey % 3 <> 0"),
    "parse_openalex": _documents("'W' || c_custkey", f"coalesce({_D}, 'https://openalex.org/W' || c_custkey)", abstract="'a x' || c_mktsegment || ' is x' || c_mktsegment"),
    "parse_crossref": _documents("'10.7/' || c_custkey", "'https://doi.org/10.7/' || c_custkey", abstract="c_mktsegment || ' data'", where="c_custkey % 3 <> 0"),
    "parse_openaire": _documents(f"coalesce('doi:' || {_D}, 'openaire:' || c_custkey)", "NULL::VARCHAR", where="c_custkey % 3 <> 0 OR c_custkey % 11 <> 0"),
    "parse_openaire_graph": _documents("'openaire:' || c_custkey", "NULL::VARCHAR"),
    "parse_arxiv": _documents("'arxiv:' || c_custkey", "'http://arxiv.org/abs/' || c_custkey", "preprint"),
    "parse_pubmed": _documents("c_custkey::VARCHAR", "'https://pubmed.ncbi.nlm.nih.gov/' || c_custkey || '/'", doi="NULL::VARCHAR", abstract="c_mktsegment || ' done'"),
    "full_text_cascade": "WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS m FROM documents) SELECT doc_id, CASE WHEN length(m) > 500 THEN 'pmc' ELSE 'plain' END AS source, CASE WHEN length(m) > 500 THEN length(m) ELSE length(text) END::INT AS n_chars FROM t WHERE length(m) > 500 OR length(text) > 500",
    "feed_weather": _HOURS + " SELECT date, NULL::DOUBLE AS temp_mean, max(v) AS temp_max, min(v) AS temp_min, NULL::DOUBLE AS wind_speed_max, " + _mean("w", 1) + " AS relative_humidity_mean FROM h GROUP BY date",
    "feed_air_quality": _HOURS + " SELECT date, NULL::DOUBLE AS pm2_5, " + _mean("v", 2) + " AS pm10, " + _mean("w", 2) + " AS no2, NULL::DOUBLE AS o3 FROM h GROUP BY date",
    "feed_generic": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1",
    "feed_national": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, " + _mean("round(o_totalprice, 0)", 4) + " AS value, sum(o_orderkey % 100)::DOUBLE AS pop FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
    "feed_sentinel": "WITH m AS (SELECT (date_trunc('week', make_date(year(o_orderdate), 1, 4)) + to_days(((o_orderkey % 52) * 7)::INT))::DATE AS d, round(o_totalprice / 700, 7) AS v FROM orders WHERE o_orderstatus = 'F') SELECT strftime(d, '%Y-%m-%d') AS date, " + _mean("v", 4) + " AS ili_incidence FROM m GROUP BY 1",
    "latest_incidence": "WITH w AS (SELECT year(o_orderdate) * 100 + weekofyear(o_orderdate) AS week, count(*)::DOUBLE AS inc FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT round(arg_max(CASE WHEN inc % 2 = 0 THEN inc / 10 ELSE inc END, week), 3) AS value FROM w",
    "catalog_resource": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'd/' || s_suppkey ELSE 'u/' || s_suppkey END AS url FROM supplier",
    "latest_snapshots": "SELECT event_type AS feed, max(event_id) AS taken_at, max(event_id) AS level, arg_max(user_id, event_id) AS area FROM events WHERE event_id % 2 = 1 GROUP BY event_type",
    "fold_frequency_mixed": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, round(count(*)::DOUBLE, 2) AS flow, round(avg(sqrt(o_totalprice)), 2) AS price FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1996-06-30' GROUP BY 1",
    "raw_equality": "SELECT c_nationkey, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building' GROUP BY c_nationkey",
    "long_texts": "SELECT lang, count(*) AS n FROM documents WHERE length(coalesce(text, '') || coalesce(lang, '')) >= 100 GROUP BY lang",
    "region_places": "SELECT n_nationkey, [46.2044, 46.5197, 47.3769, 46.2044, 46.948, 47.5596][n_nationkey % 6 + 1]::DOUBLE AS lat FROM nation",
    "cleaned_names": "SELECT c_custkey, CASE WHEN length(c_name) > 12 THEN left(c_name, 12) || '…' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'user' || c_custkey || '@mail.example.org' END AS email, 'xx ' || CASE WHEN lower(c_mktsegment) IN ('building', 'machinery') THEN '<b>' || c_mktsegment || '</b>' ELSE c_mktsegment END || ' yy' AS marked FROM customer",
}
