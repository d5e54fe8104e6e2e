"""The boolean language: what random trees print, parse and match, and the forms for each service."""

import random

import pytest
from pyspark.sql import functions as F

from quernstone.plans import boolean as B

WORDS = ["snow", "ice", "river bank", "lake", "moraine"]


def tree(rng, depth=3):
    kind = rng.choice(["term", "term", "and", "or", "not"]) if depth else "term"
    if kind == "term":
        return ("term", rng.choice(WORDS))
    if kind == "not":
        return ("not", tree(rng, depth - 1))
    return (kind, [tree(rng, depth - 1) for _ in range(rng.randrange(2, 4))])


def write(t):
    if t[0] == "term":
        return f'"{t[1]}"' if " " in t[1] else t[1]
    if t[0] == "not":
        return f"NOT ({write(t[1])})"
    return "(" + f" {t[0].upper()} ".join(write(x) for x in t[1]) + ")"


def holds(t, text):
    if t[0] == "term":
        return t[1] in text
    if t[0] == "not":
        return not holds(t[1], text)
    return (all if t[0] == "and" else any)(holds(x, text) for x in t[1])


def test_queries_match_as_their_trees_say(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.sample(WORDS, rng.randrange(len(WORDS) + 1))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t.upper() if i % 2 else t) for i, t in enumerate(texts)], "doc_id long, text string")
    trees = [tree(rng) for _ in range(25)]
    hits = docs.select("doc_id", *[B.predicate(B.parse(write(t)), F.col("text")).alias(f"q{n}") for n, t in enumerate(trees)]).collect()
    for r in hits:
        for n, t in enumerate(trees):
            assert r[f"q{n}"] == holds(t, texts[r["doc_id"]]), (write(t), texts[r["doc_id"]])


@pytest.mark.parametrize("short, long", [
    ("snow ice", "snow AND ice"), ("snow OR ice lake", "snow OR (ice AND lake)"), ("snow NOT ice OR lake", "(snow AND (NOT ice)) OR lake"),
    ("(snow", "snow"), ("snow)) ice", "snow AND ice"), ("OR snow AND", "snow"), ('snow[ti] "river  bank"[Title/Abstract]', 'snow AND "river bank"'),
])
def test_short_forms(short, long):
    assert B.parse(short) == B.parse(long)


def test_nothing_to_search():
    assert [B.parse(q) for q in (None, "   ", "( )", "NOT", "[mesh]", '""')] == [None] * 6


def test_signs_of_the_language():
    marked = ["snow AND ice", '"river bank"', "(lake)", "ice NOT snow", "snow[ti]"]
    plain = ["snow and ice", "how rivers or lakes freeze", "Not for me", "", None]
    assert [B.looks_boolean(q) for q in marked + plain] == [True] * 5 + [False] * 5


def test_forms_for_services():
    q = 'lake AND ("river bank" OR ice OR snow)'
    t = B.parse(q)
    assert B.to_arxiv(t) == '(all:"lake" AND (all:"river bank" OR all:"ice" OR all:"snow"))'
    assert B.to_s2(t) == '(lake ("river bank" | ice | snow))'
    assert B.parse(B.portable(t)) == t
    assert B.to_arxiv(B.parse("lake NOT ice")) is B.to_s2(B.parse("lake NOT ice")) is None
    assert B.route("lake NOT ice", "s2") == "lake ice" == B.route("lake ice", "openalex") and B.route(q, "core") == B.portable(t)
    assert B.route("(" + " OR ".join(f"word{n}" for n in range(400)) + ")", "arxiv").startswith("word0 word1 ")


def test_facets_are_cleaned():
    given = [{"text": "Lake  ice "}, {"text": "ice OR snow", "kind": "auto", "op": "and"}, {"text": None}, 7, {"kind": "boolean", "text": "snow", "op": "nand"}, {"kind": 3, "text": "z"}]
    assert [(f["kind"], f["text"], f["op"]) for f in B.sub_queries(given)] == [("natural", "Lake  ice", None), ("boolean", "ice OR snow", "and"), ("boolean", "snow", None), ("natural", "z", None)]
    assert B.sub_queries("snow") == []
    assert B.strategy_key("\tIce \n AGE") == B.strategy_key("ice age") == "ice age"


def test_facets_fold_from_the_left(spark):
    rng = random.Random(4)
    held = {i: {w for w in "pqrs" if rng.random() < 0.5} for i in range(40)}
    docs = spark.createDataFrame([(i, " ".join(f"{w}{w}" for w in sorted(ws))) for i, ws in held.items()], "doc_id long, text string")
    for _ in range(12):
        facets = [{"kind": "boolean", "text": w * 2, "op": rng.choice(["and", "or", None])} for w in rng.choices("pqrs", k=3)]
        combinator = rng.choice(["union", "intersection"])
        want = None
        for f in facets:
            part = {i for i, ws in held.items() if f["text"][0] in ws}
            both = (f["op"] or ("and" if combinator == "intersection" else "or")) == "and"
            want = part if want is None else want & part if both else want | part
        assert {r[0] for r in B.facet_ids(docs, facets, combinator).collect()} == want
    counts = {r["facet"]: r["n"] for r in B.facet_counts(docs, ["pp", "qq"], "text").collect()}
    p, q = ({i for i, ws in held.items() if w in ws} for w in "pq")
    assert counts == {"facet_1": len(p), "facet_2": len(q), "union": len(p | q), "intersection": len(p & q)}


def test_a_failing_translation_leaves_the_text(spark):
    docs = spark.createDataFrame([(1, "snow lake"), (2, "ice")], "doc_id long, text string")

    def fails(_):
        raise OSError

    natural = [{"kind": "natural", "text": "ice"}]
    assert [r[0] for r in B.facet_ids(docs, natural, translate=fails).collect()] == [2] == [r[0] + 1 for r in B.facet_ids(docs, natural, translate=lambda _: "lake AND snow").collect()]


def test_chunks_count_for_their_document(spark):
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(("snow", None, "lake"))], "doc_id long, title string")
    chunks = spark.createDataFrame([(0, "ice"), (0, "moraine"), (1, "Snow_5%"), (2, "snow")], "doc_id long, content string")
    found = lambda q: {r[0] for r in B.search_with_chunks(docs, chunks, q, "title").collect()}
    assert found("snow NOT ice") == {1, 2} and found("snow AND moraine") == {0} and found("_5%") == {1} and found("_6") == set() == found(" ")
