"""Payload readers against records made here, and what unusable payloads give."""

import json
import random
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from quernstone.sources import files, literature, signals

RECORDS = [
    {"id": f"k{n}", "doi": f"10.55/{n}" if n % 2 else None, "title": f"Glaciers & rivers, part {n}", "abstract": None if n == 4 else f"snow {n}", "year": 1990 + n}
    for n in range(1, 7)
]


def read(spark, parser, *payloads, **more):
    df = spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p),) for p in payloads], "payload string")
    return {r["external_id"]: r for r in parser(df, **more).collect()}


def check(found, prefix, has_doi=True):
    assert set(found) == {prefix + r["id"] for r in RECORDS}
    for r in RECORDS:
        row = found[prefix + r["id"]]
        assert (row["title"], row["abstract"], row["year"]) == (r["title"], r["abstract"], r["year"])
        assert row["doi"] == (r["doi"] if has_doi else None)


@pytest.mark.parametrize("junk", ["", "[]", "[1, 2]", '{"unrelated": {"deep": [null]}}', '{"data": 5, "results": "x", "message": []}', "<a><b>"])
def test_unusable_payloads_give_nothing(spark, junk):
    df = spark.createDataFrame([(junk,), (None,)], "payload string")
    readers = [literature.semantic_scholar, literature.doaj, literature.clinical_trials, literature.core, literature.europe_pmc, literature.openalex, literature.crossref, literature.openaire, literature.openaire_graph]
    assert [r.__name__ for r in readers if r(df).count()] == []
    assert literature.biorxiv(df, ["snow"]).count() == literature.pubmed(df).count() == literature.arxiv(df).count() == 0


def test_json_services(spark):
    scholar = [{"paperId": r["id"], "title": f"  {r['title']}\n", "abstract": r["abstract"], "year": r["year"], "externalIds": {"DOI": r["doi"], "MAG": "1"}} for r in RECORDS]
    check(read(spark, literature.semantic_scholar, {"total": 9, "data": scholar[:4]}, {"data": [*scholar[4:], {"title": "no id"}, {"paperId": ""}, None]}), "s2:")
    journals = [{"id": r["id"], "bibjson": {"title": r["title"], "abstract": r["abstract"], "year": str(r["year"]), "identifier": [{"id": "0028-0836", "type": "eissn"}, *([{"type": "doi", "id": r["doi"]}] if r["doi"] else [])]}} for r in RECORDS]
    check(read(spark, literature.doaj, {"results": journals + [{"id": "zz", "bibjson": {}}]}), "doaj:")
    trials = [{"protocolSection": {"identificationModule": {"nctId": r["id"], "briefTitle": r["title"]}, "descriptionModule": {"briefSummary": r["abstract"]}, "statusModule": {"startDateStruct": {"date": f"{r['year']}-11"}}}} for r in RECORDS]
    found = read(spark, literature.clinical_trials, {"studies": [*trials, {"protocolSection": None}, {}]})
    check(found, "nct:", has_doi=False)
    assert {r["source_type"] for r in found.values()} == {"clinical_trial"} and found["nct:k2"]["url"].endswith("/k2")
    outputs = [{"id": r["id"], "title": r["title"], "abstract": r["abstract"], "yearPublished": r["year"], "doi": r["doi"]} for r in RECORDS]
    check(read(spark, literature.core, {"results": [3.5, None, *outputs, ["list"], {"id": 8}]}), "core:")


def test_nested_services(spark):
    def wrapped(text):
        return [{"@lang": "en", "$": text}] if random.Random(text).random() < 0.5 else {"$": text}

    old = [{"header": {"dri:objIdentifier": {"$": r["id"]}}, "metadata": {"oaf:entity": {"oaf:result": {"title": wrapped(r["title"]), "description": r["abstract"] and wrapped(r["abstract"]), "dateofacceptance": {"$": f"{r['year']}-02-03"}, "pid": {"@classid": "handle", "$": "h"}}}}} for r in RECORDS]
    check(read(spark, literature.openaire, *({"response": {"results": {"result": x}}} for x in (old[:5], old[5]))), "openaire:", has_doi=False)
    new = [{"id": r["id"], "mainTitle": r["title"], "descriptions": [r["abstract"]] if r["year"] % 2 else [{"value": r["abstract"]}] if r["abstract"] else None, "publicationDate": f"{r['year']}-12-31", "pids": [{"scheme": "doi", "value": r["doi"]}] if r["doi"] else []} for r in RECORDS]
    check(read(spark, literature.openaire_graph, {"results": new}), "openaire:")
    works = [{"DOI": f"10.55/{r['id']}", "title": [r["title"], "second"], "abstract": r["abstract"] and f"<jats:p>{r['abstract']}</jats:p>", "created": {"date-parts": [[r["year"], 7, 9]]}} for r in RECORDS]
    found = read(spark, literature.crossref, {"message": {"items": [*works, {"title": ["without"]}]}})
    assert {k: (v["title"], v["abstract"], v["year"]) for k, v in found.items()} == {f"10.55/{r['id']}": (r["title"], r["abstract"], r["year"]) for r in RECORDS}
    index = {"the": [0, 3], "ice": [1], "melts": [2], "river": [4]}
    found = read(spark, literature.openalex, {"results": [{"id": "https://openalex.org/W31", "title": "t", "abstract_inverted_index": index}, {"id": "https://openalex.org/W32", "title": "t"}]})
    assert {k: v["abstract"] for k, v in found.items()} == {"W31": "the ice melts the river", "W32": None}


def test_preprints_need_a_third_of_the_terms(spark):
    papers = [{"doi": f"10.1/{n}", "title": " ".join(words), "abstract": "", "date": "2011-01-01"} for n, words in enumerate((["lakes"], ["lakes", "snow"], ["Lakes", "Snow", "ice-cap"], ["sea"]))]
    terms = ["lakes", "snowfall", "moraine", "ice-cap", "sediment", "and"]  # five of them have four letters
    assert set(read(spark, literature.biorxiv, {"collection": papers}, terms=terms, server="s")) == {"s:10.1/2"}
    assert len(read(spark, literature.biorxiv, {"collection": papers}, terms=["of"])) == 4


def test_xml_services(spark):
    entries = "".join(f"<entry><id>http://arxiv.org/abs/{r['id']}</id><title>{escape(r['title'])}</title>{'<summary> ' + r['abstract'] + ' </summary>' if r['abstract'] else ''}<published>{r['year']}-08-08T10:00:00Z</published></entry>" for r in RECORDS)
    check(read(spark, literature.arxiv, f'<feed xmlns="http://www.w3.org/2005/Atom"><title>q</title>{entries}<entry><id>http://other/1</id><title>x</title></entry></feed>'), "arxiv:", has_doi=False)
    article = "<PubmedArticle><MedlineCitation><PMID>{id}</PMID><Article><Journal><JournalIssue><PubDate>{date}</PubDate></JournalIssue></Journal><ArticleTitle>On <sup>18</sup>O in <i>ice</i></ArticleTitle></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='pii'>p</ArticleId><ArticleId IdType='doi'>10.9/{id}</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"
    text = "<PubmedArticleSet>" + article.format(id=41, date="<MedlineDate>Winter 1987-88</MedlineDate>") + article.format(id=42, date="<Year>1999</Year>") + "</PubmedArticleSet>"
    found = read(spark, literature.pubmed, text)
    assert {k: (v["title"], v["year"], v["doi"], v["abstract"]) for k, v in found.items()} == {"41": ("On 18O in ice", 1987, "10.9/41", None), "42": ("On 18O in ice", 1999, "10.9/42", None)}


def test_full_texts(spark):
    xml = "<article><front>meta</front><body><p>Long <b>enough</b></p><fig id='f'><p>caption</p></fig><p>text.</p></body><ref-list><ref>r</ref></ref-list></article>"
    assert spark.range(1).select(literature.body_text(F.lit(xml))).first()[0] == "Long enough text."
    rows = spark.createDataFrame([(1, "a" * 9, "b" * 20), (2, None, "b" * 8), (3, "a" * 30, None)], "id long, first string, second string")
    assert sorted(tuple(r)[:2] for r in literature.full_text(rows, "id", ["first", "second"], 10).collect()) == [(1, "second"), (3, "first")]


def test_one_row_for_each_document_of_all_sources(spark):
    frame = lambda rows: spark.createDataFrame([(i, d, t, None, 1999, None, "article") for i, d, t in rows], "external_id string, doi string, title string, abstract string, year int, url string, source_type string")
    found = literature.union_sources({"north": frame([("1", "10.4/Q", "n"), ("2", None, "m")]), "south": frame([("7", "10.4/q", "s"), ("2", None, "m")])}).collect()
    assert sorted((r["external_id"], r["source"], r["also_in_sources"]) for r in found) == [("1", "north", ["north", "south"]), ("2", "north", ["north"]), ("2", "south", ["south"])]


def test_feeds(spark):
    payload = {"daily": {"time": ["2019-07-0%d" % d for d in (1, 2, 3)], "precipitation_sum": [0.0, None, 7.5]}, "hourly": {"time": ["2019-07-03T%02d:00" % h for h in range(4)] + ["2019-07-09T00:00"], "relative_humidity_2m": [50, 51, None, 53, 1]}}
    df = spark.createDataFrame([(json.dumps(payload),)], "payload string")
    got = {r["date"]: (r["precip_sum"], r["relative_humidity_mean"], r["temp_max"]) for r in signals.fetch_series("open-meteo-weather", df, start="2019-07-02").collect()}
    assert got == {"2019-07-02": (None, None, None), "2019-07-03": (7.5, 51.3, None)}
    with pytest.raises(KeyError):
        signals.fetch_series("unheard-of", df)
    assert {c["id"] for c in signals.list_connectors()} == set(signals.CONNECTORS)
    samples = [("North", "d1", "rsv", "3e2"), ("North", "d1", "SARS-CoV-2", "5"), ("North", "d1", "RSV", "250"), ("South", "d1", "RSV", "1"), ("North", "d2", "IBV", "inf"), ("North", "d3", "other", "4")]
    df = spark.createDataFrame([(*s, n) for n, s in enumerate(samples)], "wwtp string, sample_date string, Target string, Load string, seq int")
    got = {r["date"]: (r["rsv_load"], r["sars_cov2_load"]) for r in signals.wastewater(df, "North", ["rsv", "sars-cov-2"]).collect()}
    assert got == {"d1": (250.0, 5.0)}
    table = spark.createDataFrame([("1", "2020-W01", "x", " 4.5 "), ("2", "2020-W02", "y", "-"), ("3", "2020-W02", "y", "6")], "Nr string, Woche string, Kind string, `Rate Per Week` string")
    assert sorted(map(tuple, signals.generic(table.drop("Nr")).collect())) == [("2020-W01", 4.5), ("2020-W02", 6.0)]
    assert {(str(r[0]), r[1]) for r in signals.sentinel(table.select("Woche", "Kind", "Rate Per Week"), {"KIND": "Y"}).collect()} == {("2020-01-06", 6.0)}
    assert signals.sentinel(table.select("Woche", "Kind")).count() == 0
    catalogue = [{"result": {"resources": [{"format": "csv"}, {"format": "CSV", "url": "u1"}, {"format": "CSV", "download_url": "u2"}]}}, {"result": {"resources": []}}, {}]
    df = spark.createDataFrame([(n, json.dumps(c)) for n, c in enumerate(catalogue)], "n int, payload string")
    assert {r["n"]: r["url"] for r in signals.csv_resource(df).collect()} == {0: "u1", 1: None, 2: None}


def test_latest_rates(spark):
    latest = lambda value: signals.latest_incidence(spark.createDataFrame([(json.dumps(value),)], "payload string")).first()[0]
    weeks = [{"week": 201150 + n, "inc100": None if n == 2 else 3.5 * n, "inc": 900 + n} for n in (1, 2, 0)]
    assert (latest(weeks), latest({"data": weeks[::2]}), latest([]), latest("text")) == (902.0, 3.5, None, None)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("v", ["p", "q"], {"z": 1})], "name string, levels array<string>, extra map<string,int>")
    files.export_model(df, df.select("name"), df, str(tmp_path / "book"))
    back = files.read_csv(spark, str(tmp_path / "book" / "variables")).first()
    assert (back["levels"], back["extra"]) == ('["p","q"]', '{"z":1}')
    files.write_report(df, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["levels"] == ["p", "q"]
    assert [r["payload"].strip() for r in files.landed(spark, str(tmp_path / "report" / "*.json")).collect()] == ['{"name":"v","levels":["p","q"],"extra":{"z":1}}']
