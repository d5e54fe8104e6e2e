import json

from pyspark.sql import functions as F

from quernstone.operators import corpus


def test_top_articles(spark):
    whole = json.dumps({"population": "adults", "intervention": "i", "outcome": "o", "key_finding": "k", "more": 1})
    rows = [(1, 0.5, "a  b\n c", whole), (2, 0.9, None, "{broken"), (3, 0.5, "x" * 400, None), (4, None, "last", None)]
    df = spark.createDataFrame(rows, "id long, score double, abstract string, pico string")
    got = corpus.top_articles(df, [F.col("score").desc_nulls_last(), F.col("id")], 3, ["id"], "abstract", "pico").orderBy("place").collect()
    assert [(r["place"], r["id"], r["excerpt"]) for r in got] == [(1, 2, ""), (2, 1, "a b c"), (3, 3, "x" * 300 + "…")]
    assert got[1]["pico_summary"]["population"] == "adults" and got[0]["pico_summary"] in (None, (None,) * 4) and got[2]["pico_summary"] is None
    assert corpus.top_articles(df.limit(0), [F.col("id")], 3, ["id"], "abstract").count() == 0
