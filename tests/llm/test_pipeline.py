import hashlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from quernstone.llm import kneserney, queries


def test_stages_take_effect(spark, folder, tmp_path):
    """Each stage against its own input, by plain Python."""
    from test_lines import brute as kept_lines
    from test_simhash import brute as fingerprint

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, None
    for n, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(n)))
        out = spark.read.parquet(str(tmp_path / str(n)))
        had, has = ([r.asDict() for r in d.collect()] for d in (docs, out))
        if n < len(P.STAGES) - 1:
            assert out.columns == columns
        if name == "toxicity":
            bad = {r["doc_id"] for r in kneserney.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("predicted = 1").collect()}
            assert bad and {r["doc_id"] for r in has} == {r["doc_id"] for r in had} - bad
        elif name == "line dedup":
            want = kept_lines([(r["doc_id"], r["text"]) for r in had])
            assert {r["doc_id"]: r["text"] for r in has} == {r["doc_id"]: x for r, x in zip(had, want)} and all(r["n_chars"] == len(r["text"]) for r in has)
        elif name == "SimHash near-dedup":
            prints = sorted((r["doc_id"], fingerprint(r["text"], 5)) for r in had)
            stay = {i for i, f in prints}
            for i, f in prints:
                for j, g in prints:
                    if j < i and (f ^ g).bit_count() <= 3:
                        stay.discard(i)
            assert {r["doc_id"] for r in has} == stay and len(has) < len(had)
        elif name == "mixing":
            times = Counter(r["doc_id"] for r in has)
            assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in had}
        else:
            library = Tokenizer.from_file(queries.tokenizer_path())
            text = {r["doc_id"]: r["text"] for r in had}
            for r in has:
                ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
                assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
                assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
        docs = out
    before = sorted(map(str, docs.collect()))
    assert sorted(map(str, P.run(spark, folder).collect())) == before


def test_odd_rows_pass_each_stage(spark, folder):
    """Nulls, empty texts, repeated rows and columns with the names that stages use; empty tables."""
    texts = ["some words of a text " * 9, None, "", " \n\t", "one\ntwo", "some words of a text " * 9]
    extra = ["_of", "_times", "_turn", "_kept", "score", "predicted", "features", "n_lines", "n_removed", "size", "taken", "id", "late", "fp", "component_id"]
    rows = [(i if i != 4 else None, t, None if i == 2 else "en", None if i % 3 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts * 2)]
    rows = [(*r, *[7] * len(extra)) for r in [*rows, rows[0], rows[0]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in extra))
    for name, stage in P.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, folder)
            if name != "BPE":
                assert out.columns == docs.columns
                assert all(r["score"] == r["_times"] == r["n_lines"] == 7 for r in out.collect())
            else:
                assert out.count() == given.count()
    kept = {r["doc_id"] for r in P.drop_toxic(spark, docs, folder).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}
    assert sorted(str(r["doc_id"]) for r in P.mix_sources(spark, docs.filter("text is not null"), folder).collect())
