import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import chunks, corpus, dedup, epidemic, filters, graph, models, search, timeseries


def test_filters(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, source string")
    links = spark.createDataFrame([("s", 1), ("s", 3), ("t", 2)], "scenario_id string, document_id long")
    ids = lambda f: sorted(r[0] for r in filters.where(docs, f, links).collect())
    assert ids({"scenario_type": "s"}) == [1, 3] and ids({"source": "a", "lang": ""}) == [1, 2] and ids(None) == [1, 2, 3]
    named = docs.withColumn("project_context", F.lit("new"))
    assert filters.where(named, {"project_context": "old"}, contexts={"old": "new"}).count() == 3


def test_writes(spark):
    have = spark.createDataFrame([("1", "x")], "external_id string, source string")
    new = spark.createDataFrame([("1", "x"), ("2", "x"), ("2", "x")], "external_id string, source string")
    assert filters.insert_new(have, new, ["external_id", "source"]).collect() == [("2", "x")]
    links = spark.createDataFrame([("s", 1), ("s", 2), ("t", 2)], "scenario_id string, document_id long")
    moved = spark.createDataFrame([(2, 1)], "old_id long, keep_id long")
    assert sorted(map(tuple, filters.repoint(links, moved).collect())) == [("s", 1), ("t", 1)]


def test_dedup_passes_use_up_ids(spark):
    rows = [(1, "10.1/A", "7", "A long title here"), (2, "doi.org/x", "7", "Other"), (3, "https://doi.org/10.1/a", None, "A long title here!"), (4, None, None, "a LONG title, here"), (5, None, None, "A long title here")]
    df = spark.createDataFrame(rows, "id long, doi string, pmid string, title string")
    assert sorted((r["id"], r["pass"]) for r in dedup.exact_groups(df).collect()) == [(1, "doi"), (3, "doi"), (4, "title"), (5, "title")]


def test_fuzzy_groups_are_greedy(spark):
    t = "The quick brown fox jumps over the lazy dog again"
    df = spark.createDataFrame([(1, t), (2, t[:-1] + "m"), (3, t.replace("quick", "quack")), (4, "The other thing entirely, of some length")], "id long, title string")
    assert sorted(map(tuple, dedup.fuzzy_groups(df).collect())) == [(1, 1), (2, 1), (3, 1)]


def test_survivors_and_purge(spark):
    df = spark.createDataFrame([(1, "g", 5.0, None, 1), (2, "g", 9.0, "", 7), (3, "g", 1.0, "x", 3)], "id long, grp string, score double, name string, cites int")
    row = dedup.survivors(df, "grp", "score", "id", ["name"], ["cites"]).first()
    assert (row["id"], row["name"], row["cites"]) == (2, "x", 7)
    docs = spark.createDataFrame([(1, False, None), (2, None, 3), (3, True, 1)], "id long, is_duplicate boolean, canonical_id long")
    parts = spark.createDataFrame([(1,), (3,)], "document_id long")
    got = dedup.purge(docs, parts, parts)
    assert {k: v.count() for k, v in got.items()} == {"documents": 2, "backup_documents": 1, "chunks": 1, "backup_chunks": 1, "links": 1, "backup_links": 1}
    assert sorted(map(tuple, got["documents"].select("id", "canonical_id").collect())) == [(1, None), (2, None)]


def test_legacy_chunks(spark):
    long = "a fragment of more than twenty characters"
    rows = [(1, "title_abstract", f"T\n\n{long} and more"), (1, None, long), (1, "old", "short"), (1, "old", long.upper()), (1, "fulltext_section", long)]
    got = dedup.legacy_chunks(spark.createDataFrame(rows, "document_id long, chunk_type string, content string"))
    assert sorted(r["status"] for r in got.collect()) == ["junk", "redundant", "unique"]


def test_chunks(spark):
    df = spark.createDataFrame([(1, " T ", "whole", [("METHODS", " m "), (None, "xy"), ("Results", " ")]), (2, "T", "abs", None), (3, None, None, None)], "id long, title string, abstract string, sections array<struct<label:string,text:string>>")
    got = [(r["id"], r["chunk_type"], r["content"], r["char_start"], r["char_end"]) for r in chunks.structured(df).orderBy("id", "chunk_index").collect()]
    assert got == [(1, "title", "T", 0, 1), (1, "abstract_methods", "m", 0, 1), (1, "abstract_section", "xy", 2, 4), (2, "title", "T", 0, 1), (2, "abstract_full", "abs", 0, 3)]
    text = "\n\n".join(f"{c * 400}." for c in "abcdefghijkl")
    out = spark.createDataFrame([(text,), (None,), ("x" * 7000,)], "t string").select(chunks.paragraphs(F.col("t"))).collect()
    assert all(100 < len(c) <= 3000 for r in out for c in r[0]) and out[1][0] == [] and "".join(out[2][0]) == "x" * 7000


def test_kappa(spark):
    rows = [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15 + [("pending", "y")] * 9
    row = corpus.cohen_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert (row["n"], row["agreements"], row["conflicts"], round(row["po"], 6), round(row["pe"], 6), round(row["kappa"], 6)) == (50, 35, 15, 0.7, 0.5, 0.4)


def test_weekly(spark):
    df = spark.createDataFrame([("2025-01-01", 2.0, 1.0, 10.0), ("2025-01-02", 4.0, 2.0, None), ("2025-01-20", 6.0, 3.0, 30.0)], "date string, temp_mean double, precip_sum double, rsv_load double")
    got = timeseries.weekly(df, "date", {c: timeseries.how_for(c) for c in df.columns[1:]}).orderBy("week").collect()
    assert [(str(r[0]), *r[1:]) for r in got] == [("2025-01-05", 3.0, 3.0, 10.0), ("2025-01-12", None, 0.0, None), ("2025-01-19", None, 0.0, None), ("2025-01-26", 6.0, 3.0, 30.0)]


def test_assemble(spark):
    w = spark.createDataFrame([("2025-01-01", 1.0), ("2025-01-02", 3.0), ("2025-01-08", 5.0), ("2025-01-09", 7.0)], "date string, temp_mean double")
    e = spark.createDataFrame([("2025-01-01", 100.0), ("2025-01-08", 200.0)], "date string, rsv_load double")
    maps = [{"template_column": "t", "connector_id": "w", "connector_variable": "temp_mean"}, {"template_column": "r", "connector_id": "e", "connector_variable": "rsv_load"}]
    df, filled = timeseries.assemble({"w": w, "e": e}, maps, "W", "week")
    assert set(filled) == {"t", "r"} and [(r["t"], r["r"]) for r in df.orderBy("week").collect()] == [(2.0, 100.0), (6.0, 200.0)]
    assert timeseries.assemble({"w": w}, [{"template_column": "t", "connector_id": "w", "connector_variable": "no"}]) == (None, [])


def test_retrieval(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "included", False), (2, [0.9, 0.1], None, None), (3, [1.0, 0.0], "excluded", False), (4, [1.0, 0.1], None, True), (5, [0.0, 1.0], None, False)], "doc_id long, embedding array<double>, decision string, is_duplicate boolean")
    assert [r["doc_id"] for r in search.screened(df, [0.5, 0.5], 5, 0.75).collect()] == [2]
    assert [r["doc_id"] for r in search.screened(df, [0.9, 0.1], 5, 0.18, included_first=True).collect()] == [1, 2]
    nodes = df.select(F.col("doc_id").alias("vec_id"), "embedding")
    edges = graph.similarity_edges(nodes, 0.9)
    assert {r["vec_id"]: r["community"] for r in graph.communities(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    with pytest.raises(ValueError):
        graph.similarity_edges(nodes, most_nodes=2)


def test_epidemic(spark):
    import numpy as np

    p = {"r0": np.array([2.0]), "infectious_period_days": np.array([5.0]), "incubation_period_days": np.array([3.0]), "initial_infected": np.array([1.0]), "population": np.array([1e6])}
    s = epidemic.trajectories(p, 600)
    z = 0.8
    for _ in range(200):
        z = 1 - np.exp(-2.0 * z)
    got = epidemic.summary(s, p)
    assert got["model"] == "SEIR" and abs(float(got["attack_rate"][0]) - z) < 0.02
    total = sum(s[k] for k in ("susceptible", "exposed", "prevalence", "recovered", "deaths", "vaccinated", "quarantined"))
    assert np.allclose(total, 1e6)
    assert epidemic.model_name(epidemic.rates({"cfr": 0.1, "vaccination_rate": 0.01, "quarantine_rate": 0.1, "immunity_duration_days": 90.0, "incubation_period_days": 3.0})) == "SVEIQRDS"
    seen = [(d, 0.3 * float(v)) for d, v in enumerate(epidemic.trajectories({"r0": np.array([2.7])}, 60)["incidence"][:, 0]) if d % 7 == 0]
    assert abs(epidemic.calibrate_r0(seen, {})["r0"] - 2.7) < 0.15
    band = epidemic.ensemble(spark, {"r0": epidemic.Dist(2.0, 1.5, 2.5)}, 30, 40).filter("series = 'incidence'").collect()
    assert len(band) == 31 and all(r["lower"] <= r["median"] <= r["upper"] for r in band)


def test_models(spark):
    rng = random.Random(1)
    rows = [(i, *(x := [rng.gauss(0, 1) for _ in range(3)]), 3 * x[0] - 2 * x[1] + 0.5 * x[2] + rng.gauss(0, 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x1 double, x2 double, `X 3` double, target double")
    got = models.train(df, "Target", ["x1", "x2", "x_3", "absent"], key="id")
    assert got["metrics"]["r2"] > 0.95 and got["warnings"] == [] and got["method"] == "linear"
    leak = df.withColumn("copy", F.col("target") * 2)
    assert models.train(leak, "target", ["x1", "copy"], key="id")["warnings"] == ["leak: copy"]
    board = models.compare(df, "target", ["x1", "x2"], ["linear", "svm"], metric="rmse", key="id").collect()
    assert {r["family"]: r["method"] for r in board} == {"linear": "linear", "svm": "kernel_ridge"}
    with pytest.raises(ValueError):
        models.train(df.limit(5), "target", ["x1"], key="id")
    with pytest.raises(ValueError):
        models.train(df, "nothing", ["x1"], key="id")
    kind = df.withColumn("out", F.when(F.col("x1") + F.col("x2") > 0, "oui").otherwise("non"))
    got = models.train(kind, "out", ["x1", "x2"], "classification", "logistic", key="id", positive="oui")
    assert got["metrics"]["roc_auc"] > 0.95
    effects = models.explain(got["model"], kind.limit(5), ["x1", "x2"], "classification", "id")
    assert effects.count() == 10


def test_levels_and_forecast(spark):
    scored = spark.createDataFrame([(0.7,), (0.8,)], "score double")
    assert models.monitor(scored, None).first()["level"] == "red"
    assert models.monitor(scored.filter("false"), None).first()["level"] == "unavailable"
    assert models.monitor(scored, None, bands=(0.76, 0.9)).first()["level"] == "green"
    days = spark.range(60).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"), (F.col("id") * 2.0).alias("v"))
    out = models.seasonal_forecast(days, "d", "v", 7).orderBy("step").collect()
    assert len(out) == 12 and abs(out[0]["forecast"] - 120) < 2 and models.seasonal_forecast(days.limit(10), "d", "v", 7).count() == 0


def test_rolling_windows_with_gaps(spark):
    """Stretches give what one window over the whole series would; days without rows are gaps."""
    from quernstone.operators import timeseries

    days = [d for d in range(0, 400) if d % 7 not in (2, 3) and not 100 < d < 130]
    rows = [(k, f"2024-01-01 + {d}", d, None if d % 11 == 0 else float(d % 13)) for k in ("a", "b") for d in days]
    df = spark.createDataFrame(rows, "k string, label string, d int, x double").selectExpr("k", "d", "x", "date_add(date'2024-01-01', d) as day")
    for stretch in (None, 7, 50):
        out = timeseries.rolling(df, "day", {"x": "sum"}, 7, ["k"], stretch=stretch)
        got = {(r["k"], r["d"]): r["x_sum_7"] for r in timeseries.rolling(out, "day", {"x_sum_7": "count"}, 7, ["k"]).collect()}
        value = {d: None if d % 11 == 0 else float(d % 13) for d in days}
        for d in days:
            have = [value[e] for e in range(d - 6, d + 1) if value.get(e) is not None]
            assert got["a", d] == got["b", d] == (sum(have) if have else None)
    few = timeseries.rolling(df, "day", {"x": "mean"}, 3, ["k"], least=3).filter("x_mean_3 is not null")
    assert 0 < few.count() < df.count() and "_part" not in few.columns
