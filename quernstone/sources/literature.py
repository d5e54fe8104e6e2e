"""Payloads of literature services as tidy documents.

Each function takes rows with a payload column and gives (external_id, doi, title,
abstract, year, url, source_type); malformed payloads give nothing.  Payloads are landed
as files or rows first; nothing here goes to the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("external_id", "doi", "title", "abstract", "year", "url", "source_type")


def squeeze(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def strip_markup(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "<[^>]*>", " "))


def year_of(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, 4).try_cast("int")


def _items(df: DataFrame, payload: str, schema: str, path: str) -> DataFrame:
    """One row (i) for each item of an array in a JSON payload."""
    rows = df.select(F.from_json(F.col(payload), schema).alias("p")).select(F.explode(F.col(f"p.{path}")).alias("i"))
    return rows.filter("i is not null")


def _tidy(df: DataFrame, kind: str = "article", **columns: Column) -> DataFrame:
    given = {"doi": F.lit(None).cast("string"), "abstract": F.lit(None).cast("string"), "url": F.lit(None).cast("string"), "source_type": F.lit(kind)} | columns
    out = df.select(*[given[c].alias(c) for c in COLUMNS])
    return out.filter(F.col("external_id").isNotNull() & F.col("title").isNotNull()).withColumn("year", F.col("year").cast("int"))


def semantic_scholar(df: DataFrame, payload: str = "payload") -> DataFrame:
    i = _items(df, payload, "data array<struct<paperId:string,title:string,abstract:string,year:int,externalIds:struct<DOI:string>,url:string>>", "data")
    return _tidy(i, external_id=F.concat(F.lit("s2:"), F.nullif(F.col("i.paperId"), F.lit(""))), doi=F.col("i.externalIds.DOI"), title=squeeze(F.col("i.title")), abstract=F.col("i.abstract"), year=F.col("i.year"), url=F.col("i.url"))


def doaj(df: DataFrame, payload: str = "payload") -> DataFrame:
    i = _items(df, payload, "results array<struct<id:string,bibjson:struct<title:string,abstract:string,year:string,identifier:array<struct<type:string,id:string>>,link:array<struct<url:string>>>>>", "results")
    doi = F.get(F.filter("i.bibjson.identifier", lambda x: x["type"] == "doi"), F.lit(0))["id"]
    return _tidy(i, external_id=F.concat(F.lit("doaj:"), F.col("i.id")), doi=doi, title=squeeze(F.col("i.bibjson.title")), abstract=F.col("i.bibjson.abstract"), year=year_of(F.col("i.bibjson.year")), url=F.get("i.bibjson.link", F.lit(0))["url"])


def clinical_trials(df: DataFrame, payload: str = "payload") -> DataFrame:
    i = _items(df, payload, "studies array<struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string>,descriptionModule:struct<briefSummary:string>,statusModule:struct<startDateStruct:struct<date:string>>>>>", "studies")
    s = "i.protocolSection"
    nct = F.col(f"{s}.identificationModule.nctId")
    return _tidy(
        i, "clinical_trial", external_id=F.concat(F.lit("nct:"), nct), title=squeeze(F.col(f"{s}.identificationModule.briefTitle")),
        abstract=F.col(f"{s}.descriptionModule.briefSummary"), year=year_of(F.col(f"{s}.statusModule.startDateStruct.date")), url=F.concat(F.lit("https://clinicaltrials.gov/study/"), nct),
    )


def core(df: DataFrame, payload: str = "payload") -> DataFrame:
    i = _items(df, payload, "results array<string>", "results")  # entries can be of any kind
    i = i.select(F.from_json("i", "id string, title string, abstract string, yearPublished int, doi string, downloadUrl string").alias("i"))
    return _tidy(i, external_id=F.concat(F.lit("core:"), F.col("i.id")), doi=F.col("i.doi"), title=squeeze(F.col("i.title")), abstract=F.col("i.abstract"), year=F.col("i.yearPublished"), url=F.col("i.downloadUrl"))


def biorxiv(df: DataFrame, terms: list[str], server: str = "biorxiv", payload: str = "payload") -> DataFrame:
    """Preprints with a DOI of which a third of the terms (of four letters or more) occur in title and abstract."""
    i = _items(df, payload, "collection array<struct<doi:string,title:string,abstract:string,date:string>>", "collection").filter("i.doi is not null")
    terms = [t.lower() for t in terms if len(t) >= 4]
    if terms:
        text = F.lower(F.concat_ws(" ", "i.title", "i.abstract"))
        hits = sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))
        i = i.filter(hits * 3 >= len(terms))
    return _tidy(i, "preprint", external_id=F.concat(F.lit(f"{server}:"), F.col("i.doi")), doi=F.col("i.doi"), title=squeeze(F.col("i.title")), abstract=F.col("i.abstract"), year=year_of(F.col("i.date")), url=F.concat(F.lit("https://doi.org/"), F.col("i.doi")))


def europe_pmc(df: DataFrame, payload: str = "payload") -> DataFrame:
    i = _items(df, payload, "resultList struct<result:array<struct<pmid:string,pmcid:string,doi:string,title:string,abstractText:string,pubYear:string>>>", "resultList.result")
    abstract = F.when(F.col("i.abstractText").startswith("<"), strip_markup(F.col("i.abstractText"))).otherwise(F.col("i.abstractText"))
    return _tidy(i, external_id=F.coalesce("i.pmcid", "i.pmid", "i.doi"), doi=F.col("i.doi"), title=squeeze(F.col("i.title")), abstract=abstract, year=year_of(F.col("i.pubYear")))


def openalex(df: DataFrame, payload: str = "payload") -> DataFrame:
    from ..functions.text import inverted_index_text

    i = _items(df, payload, "results array<struct<id:string,doi:string,title:string,publication_year:int,abstract_inverted_index:map<string,array<bigint>>>>", "results")
    id_ = F.element_at(F.split("i.id", "/"), -1)
    index = F.col("i.abstract_inverted_index")
    return _tidy(i, external_id=id_, doi=F.col("i.doi"), title=squeeze(F.col("i.title")), abstract=F.when(index.isNotNull(), inverted_index_text(index)), year=F.col("i.publication_year"), url=F.coalesce(F.col("i.doi"), F.concat(F.lit("https://openalex.org/"), id_)))


def crossref(df: DataFrame, payload: str = "payload") -> DataFrame:
    i = _items(df, payload, "message struct<items:array<struct<DOI:string,title:array<string>,abstract:string,created:struct<`date-parts`:array<array<int>>>>>>", "message.items")
    year = F.get(F.get(F.col("i.created.date-parts"), F.lit(0)), F.lit(0))
    return _tidy(i, external_id=F.col("i.DOI"), doi=F.col("i.DOI"), title=squeeze(F.get("i.title", F.lit(0))), abstract=strip_markup(F.col("i.abstract")), year=year, url=F.concat(F.lit("https://doi.org/"), F.col("i.DOI")))


def _loose(value: Column) -> Column:
    """Text of a JSON value that is a scalar, an object with "$" or "value", or a list of those (the first counts)."""
    first = F.coalesce(F.get_json_object(value, "$[0]"), value)
    return F.coalesce(F.get_json_object(first, "$['$']"), F.get_json_object(first, "$.value"), F.when(~first.rlike(r"^\s*[\[{]"), first))


def openaire(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The older API: texts are wrapped, and any field can be one value or a list."""
    found = F.get_json_object(F.col(payload), "$.response.results.result")
    i = df.select(F.explode(F.from_json(F.when(found.startswith("["), found).otherwise(F.concat(F.lit("["), found, F.lit("]"))), "array<string>")).alias("i"))
    meta = F.get_json_object("i", "$.metadata['oaf:entity']['oaf:result']")
    at = lambda name: F.get_json_object(meta, f"$.{name}")
    pid = at("pid")
    pids = F.from_json(F.when(pid.startswith("["), pid).otherwise(F.concat(F.lit("["), pid, F.lit("]"))), "array<map<string,string>>")
    doi = F.get(F.filter(pids, lambda x: x["@classid"] == "doi"), F.lit(0))["$"]
    id_ = _loose(F.get_json_object("i", "$.header['dri:objIdentifier']"))
    key = F.when(doi.isNotNull(), F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit("openaire:"), id_))
    return _tidy(i, external_id=key, doi=doi, title=squeeze(_loose(at("title"))), abstract=squeeze(_loose(at("description"))), year=year_of(_loose(at("dateofacceptance"))))


def openaire_graph(df: DataFrame, payload: str = "payload") -> DataFrame:
    i = _items(df, payload, "results array<struct<id:string,mainTitle:string,descriptions:array<string>,publicationDate:string,pids:array<struct<scheme:string,value:string>>>>", "results")
    doi = F.get(F.filter("i.pids", lambda x: x["scheme"] == "doi"), F.lit(0))["value"]
    return _tidy(i, external_id=F.concat(F.lit("openaire:"), F.col("i.id")), doi=doi, title=squeeze(F.col("i.mainTitle")), abstract=_loose(F.get("i.descriptions", F.lit(0))), year=year_of(F.col("i.publicationDate")))


def arxiv(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Atom feeds; a payload that isn't XML gives nothing."""
    schema = "entry array<struct<id:string,title:string,summary:string,published:string,`arxiv:doi`:string>>"
    i = df.select(F.explode(F.from_xml(F.col(payload), schema, {"mode": "PERMISSIVE"})["entry"]).alias("i"))
    id_ = F.nullif(F.regexp_extract("i.id", r"/abs/(.+)$", 1), F.lit(""))
    return _tidy(i, "preprint", external_id=F.concat(F.lit("arxiv:"), id_), doi=F.col("i.arxiv:doi"), title=squeeze(F.col("i.title")), abstract=squeeze(F.col("i.summary")), year=year_of(F.col("i.published")), url=F.col("i.id"))


def pubmed(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Article sets; inline markup in titles and abstracts is dropped before parsing, so that their whole text counts."""
    bare = F.regexp_replace(F.col(payload), r"</?(?:i|b|u|sup|sub|em|strong|italic|bold)\b[^>]*>", "")
    text = "struct<_VALUE:string,_Label:string>"
    schema = f"PubmedArticle array<struct<MedlineCitation:struct<PMID:struct<_VALUE:string,_Version:string>,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<{text}>>,Journal:struct<JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,ArticleDate:struct<Year:string>>>,PubmedData:struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>>>"
    i = df.select(F.explode(F.from_xml(bare, schema, {"mode": "PERMISSIVE"})["PubmedArticle"]).alias("i"))
    a = "i.MedlineCitation.Article"
    pmid = F.trim(F.col("i.MedlineCitation.PMID._VALUE"))
    parts = F.filter(F.transform(f"{a}.Abstract.AbstractText", lambda x: F.trim(x["_VALUE"])), lambda x: x != "")
    year = F.coalesce(year_of(F.col(f"{a}.Journal.JournalIssue.PubDate.Year")), F.nullif(F.regexp_extract(f"{a}.Journal.JournalIssue.PubDate.MedlineDate", r"(\d{4})", 1), F.lit("")).try_cast("int"), year_of(F.col(f"{a}.ArticleDate.Year")))
    doi = F.get(F.filter("i.PubmedData.ArticleIdList.ArticleId", lambda x: x["_IdType"] == "doi"), F.lit(0))["_VALUE"]
    return _tidy(i, external_id=F.nullif(pmid, F.lit("")), doi=doi, title=squeeze(F.col(f"{a}.ArticleTitle")), abstract=F.nullif(F.array_join(parts, " "), F.lit("")), year=year, url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")))


#: Parts of an article's XML that are no running text.
NOT_BODY = ("ref-list", "table-wrap", "fig", "disp-formula", "inline-formula", "xref", "supplementary-material", "back", "front")


#: XML's own entities; the ampersand comes last.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def body_text(xml: Column, skip: tuple[str, ...] = NOT_BODY) -> Column:
    """Running text of an article's XML, in one line; elements to skip go with all that is in them (of nested ones of a kind, up to the first end)."""
    bare = F.regexp_replace(xml, r"(?is)<(" + "|".join(skip) + r")\b[^>]*(?:/>|>.*?</\1\s*>)", " ")
    plain = F.regexp_replace(bare, "<[^>]*>", " ")
    for name, character in ENTITIES.items():
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(character))
    return F.nullif(squeeze(plain), F.lit(""))


def full_text(candidates: DataFrame, key: str, sources: list[str], least: int = 500) -> DataFrame:
    """The first source's text, in order of priority, that is long enough."""
    text = F.coalesce(*[F.when(F.length(s) > least, F.struct(F.lit(s).alias("source"), F.col(s).alias("text"))) for s in sources])
    return candidates.select(key, text.alias("t")).select(key, "t.source", "t.text").filter("text is not null")


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Documents of all sources, one for each DOI (or external id), with the sources it was also found in."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in frames.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("key", F.coalesce(F.lower("doi"), F.concat_ws(":", "source", "external_id")))
    return rows.groupBy("key").agg(F.min_by(F.struct(*COLUMNS, "source"), F.struct("source", "external_id")).alias("d"), F.array_sort(F.collect_set("source")).alias("also_in_sources")).select("d.*", "also_in_sources")
