import time

from pyspark.sql import functions as F

from quernstone.functions import stem
from quernstone.operators import text_index, upkeep

#: Words and stems of the sample that is published with the rules.
PUBLISHED = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir
conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag
knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt
knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()


def test_published_sample():
    assert [(w, stem.stem(w)) for w in PUBLISHED[::2]] == list(zip(PUBLISHED[::2], PUBLISHED[1::2]))


def test_single_rules():
    want = {
        "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "luxuriated": "luxuri", "hopping": "hop", "hoping": "hope",
        "agreed": "agre", "feed": "feed", "cry": "cri", "by": "by", "say": "say", "generously": "generous", "generate": "generat", "communism": "communism", "skies": "sky",
        "proceeds": "proceed", "relational": "relat", "analogical": "analog", "hopefulness": "hope", "adjustable": "adjust", "adoption": "adopt", "controlling": "control",
        "rolls": "roll", "youthful": "youth", "dog's": "dog", "vaccination": "vaccin", "vaccines": "vaccin", "hospitalizations": "hospit", "epidemiological": "epidemiolog", "a": "a",
    }
    assert {w: stem.stem(w) for w in want} == want


def test_weighted_vector_of_stems(spark):
    df = spark.createDataFrame([("Methods", "The vaccines were given; vaccination of the methodical"), (None, None)], "l string, c string")
    got = [r[2] for r in upkeep.with_search_vector(df, "l", "c").collect()]
    assert [(t["term"], t["weight"], t["positions"]) for t in got[0]] == [("given", "B", [5]), ("method", "A", [1, 9]), ("vaccin", "B", [3, 6])] and got[1] == []
    plain = df.select(upkeep.search_vector(F.col("l"), F.col("c"))).first()[0]
    assert ("the", "B", [2, 8]) in [(t["term"], t["weight"], t["positions"]) for t in plain]


def test_index_of_stems(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Vaccines for children"), (2, "vaccination of adults"), (3, "the weather")], "doc_id long, text string")
    index = text_index.build(docs, str(tmp_path / "i"), buckets=2, analyse=stem.english)
    assert {r["doc_id"] for r in index.top(spark, "the vaccinated", 5).collect()} == {1, 2}
    assert index.top(spark, "the", 5).count() == 0


def test_a_text_of_many_terms_is_walked_once(spark):
    """A look at all words for each term would take some 400 million steps here, and minutes."""
    n = 20000
    df = spark.createDataFrame([("w7", " ".join(f"w{i}" for i in range(n)) + " w7")], "l string, c string")
    began = time.time()
    got = {t["term"]: t for t in upkeep.with_search_vector(df, "l", "c").first()[2]}
    assert time.time() - began < 60 and len(got) == n
    assert got["w7"]["weight"] == "A" and got["w7"]["positions"] == [1, 9, n + 2] and got["w19999"]["positions"] == [n + 1]
