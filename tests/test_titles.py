from quernstone.plans import registry


def test_accented_titles_are_grouped(spark, tmp_path):
    titles = ["Étude de la santé publique", "Etude de la sante publique", "ÉTUDE de la santé, publique!", "Größe der Wirkung im Vergleich", "Größe der Wirkung im Vergleich", "Una visión más amplia", "plain ascii title here", "Plain ASCII title: here", "kurz"]
    spark.createDataFrame([(i, t + "\ntext") for i, t in enumerate(titles)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["dedup_title_hash"](spark, str(tmp_path)).collect()
    assert sorted((r["canonical_id"], r["n"]) for r in got) == [(0, 3), (3, 2), (6, 2)]
