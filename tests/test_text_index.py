import math
import random
import re
from collections import Counter

import pytest

from quernstone.operators import text_index


def brute(docs, query, k):
    """Scores by the formula; texts of one key are one document."""
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).extend(re.findall(r"[^\W_]+", (t or "").lower()))
    mean = sum(map(len, texts.values())) / max(1, len(texts))
    counts = {i: Counter(w) for i, w in texts.items()}
    out = Counter()
    for term in sorted(set(re.findall(r"[^\W_]+", query.lower()))):
        have = [i for i in texts if counts[i][term]]
        idf = math.log(1 + (len(texts) - len(have) + 0.5) / (len(have) + 0.5))
        for i in have:
            tf = counts[i][term]
            out[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(texts[i]) / mean))
    return sorted(((round(-s, 9), i) for i, s in out.items()))[:k]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    names = ["alpha", "beta", "gamma", "delta", "été", "x1", "rare"]
    some = [(i, " ".join(rng.choices(names, [90, 30, 20, 10, 5, 3, 1], k=rng.randrange(1, 200)))) for i in range(400)]
    return [*some, (400, None), (401, ""), (402, " -- "), (7, "Rare RARE extra text of a key that repeats"), *[(500 + i, "alpha beta") for i in range(60)]]


def test_as_the_formula_says(spark, tmp_path, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = text_index.build(df, str(tmp_path / "i"), buckets=8, block=16)
    for query, k in (("rare", 5), ("alpha Beta", 30), ("Été rare alpha alpha", 10), ("delta", 1000)):
        got = [(round(-r["score"], 9), r["doc_id"]) for r in index.top(spark, query, k).collect()]
        assert got == brute(docs, query, k)
    for nothing in ("absent", "", "--"):
        assert index.top(spark, nothing, 5).count() == 0


def test_only_the_terms_folders_and_promising_blocks_are_read(spark, tmp_path, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = text_index.build(df, str(tmp_path / "i"), buckets=8, block=16)
    rows = index.postings(spark, ["rare", "alpha"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan
    assert {r["term"] for r in rows.select("term").distinct().collect()} == {"rare", "alpha"}
    idf = index.terms(spark, ["rare"])
    most = index.promises(spark, idf)
    kth = index.top(spark, "rare", 5).collect()[-1]["score"]
    assert most.filter(most.most >= kth).count() < most.count()


def test_empty_table(spark, tmp_path):
    index = text_index.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "i"), buckets=2)
    assert index.top(spark, "word", 3).count() == 0


def test_terms_are_counted_where_their_text_is(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, "a"), (1, "b c"), (3, None)], "key long, text string")
    out = text_index._counts(texts, text_index.words)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(map(tuple, out.collect())) == [(1, "a", 2), (1, "b", 2), (1, "c", 1), (2, "a", 1)]
