from quernstone.plans import retrieval


def test_all_lexical_hits_reach_the_cosine(spark, tmp_path):
    """Beyond 10,000 better lexical scores, the row of the best cosine is still found."""
    n, size = 10_050, len(retrieval.QUERY)
    far = [-float(x) for x in retrieval.QUERY]
    docs = [(i, "the of und the of und") for i in range(n)] + [(n, "the"), (n + 1, "xyz")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    near = spark.createDataFrame([(n, 1), (n + 1, 1)], "vec_id long, label int").selectExpr("*", f"array({','.join(f'cast({float(x)!r} as float)' for x in retrieval.QUERY)}) as embedding")
    rest = spark.range(n).selectExpr("id as vec_id", "0 as label", f"array({','.join(f'cast({x!r} as float)' for x in far)}) as embedding")
    near.unionByName(rest).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = retrieval.hybrid_rank(spark, str(tmp_path)).collect()
    assert size == 64 and len(got) == 10 and got[0]["doc_id"] == n and n + 1 not in {r["doc_id"] for r in got}
