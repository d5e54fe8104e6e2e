from pyspark.sql import functions as F

from quernstone.functions import dates, text as T
from quernstone.functions.vectors import cosine


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_identifiers(spark):
    L = F.lit
    assert one(spark, T.normalize_doi(L(" HTTPS://dx.doi.org/10.1/X/ ")), T.normalize_doi(L(" ")), T.content_key(L("pmid:5")), T.content_key(L("5"))) == ("10.1/x", None, "ext:5", "ext:5")
    assert one(spark, T.clean_pmcid(L("see PMC1234567.")), T.clean_pmcid(L("x12")), T.clean_id(L("https://openalex.org/W12"))) == ("PMC1234567", None, "12")


def test_titles(spark):
    L = F.lit
    got = one(spark, T.normalize_title(L("Épidémie: de  grippe!")), T.normalize_title(L("Court")), T.title_norm(L("A–B: c")), T.title_norm(L(None).cast("string")), T.levenshtein_ratio(L("abcd"), L("abce")), T.levenshtein_ratio(L("ab"), L("abcd")))
    assert got == ("epidemie de grippe", None, "a b c", "", 0.75, 0.0)


def test_weights_and_tags(spark):
    got = one(spark, T.chunk_weight(F.lit("title"), F.lit("Outbreak in 2020: a systematic review")), T.chunk_weight(F.lit("other"), F.lit("x")), T.section_type(F.lit(" Methods")), T.section_type(F.lit(None).cast("string")), T.document_tags(F.lit("Hospital AI"))["has_hospital"])
    assert got == (1.56, 1.0, "abstract_methods", "abstract_section", True)


def test_weeks(spark):
    L = F.lit
    got = one(spark, *[dates.isoweek_to_date(L(x)).cast("string") for x in ("2023-W05", "2023W05", "202305", "2023-05", "2024-02-27", "2023-99", "2023-53", "nope", "")])
    assert got == ("2023-01-30",) * 4 + ("2024-02-27",) + (None,) * 4
    assert [dates.frequency(x) for x in (1 / 24, 1.0, 7.0, 30.4, 91.0, 365.0)] == [("H", 24), ("D", 7), ("W", 52), ("M", 12), ("Q", 4), ("Y", 0)]


def test_arrays(spark):
    row = spark.sql("select map('b', array(1L), 'a', array(0L, 2L)) m, array(1.0D, 0.0D) x, array(3.0D, 4.0D) y, array(0.0D, 0.0D) z, '5-10 per 100' r")
    got = row.select(T.inverted_index_text(F.col("m")), F.round(cosine(F.col("x"), F.col("y")), 6), cosine(F.col("x"), F.col("z")), T.finite(F.lit("NaN")), T.number_band(F.col("r"))).first()
    assert tuple(got)[:4] == ("a b a", 0.6, None, None) and tuple(got[4]) == (5.0, 100.0)
