from quernstone.functions import text as T


def test_whole_words_phrases_and_negation(spark):
    rows = ["She recalls the borderline", "Calls and ADMISSIONS surge", "no new outbreak, an outbreak-free year without any staff", "a short-term forecast; not a long term one", "", None,
            "not one two three outbreak", "staff"]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    got = [{k: v for k, v in r["signals"].asDict().items() if v} for r in T.with_signals(df).collect()]
    assert got == [{"border": ["border*"]}, {"demand": ["admission*", "calls", "surge"]}, {"crisis": ["outbreak*"]}, {"horizon": ["forecast*", "short term"]}, {}, {}, {"crisis": ["outbreak*"]}, {"resource": ["staff"]}]
    own = T.with_signals(df, rules={"x": ["the border*"]}, negators=()).collect()
    assert [r["signals"]["x"] for r in own][0] == ["the border*"]
