import math
import random
import zlib

import numpy as np
import pytest

from quernstone.llm import kneserney, queries


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    plain = ["".join(rng.choice("aeiourstln") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    bad = ["idiotic", "zzcum", "vileness"]
    docs, labels = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "er", "x"]))
        docs.append((i, " ".join(words), "en"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, _f string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    got = {r["doc_id"]: r for r in kneserney.score(docs, labels).collect()}
    assert len(got) == 1200 and all(0 <= r["score"] <= 1 and r["_f"] == "en" for r in got.values())
    hit = [got[i]["predicted"] == (i % 6 == 0) for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2 or i % 2]
    assert sum(hit) / len(hit) > 0.97


def test_held_out_labels_do_not_count(spark, tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(kneserney.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in kneserney.score(docs, x).collect()} for x in (labels, turned))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_odd_rows(spark, tables):
    _, labels = tables
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "12 34 !"), (3, "idiotics " * 5000), (3, "idiotics " * 5000)], "doc_id long, text string")
    docs = tables[0].select("doc_id", "text")
    got = [(r["doc_id"], r["score"]) for r in kneserney.score(docs.unionByName(odd), labels).filter("doc_id is null or doc_id in (1, 2, 3)").collect()]
    assert len(got) == 8 and all(0 <= s <= 1 for _, s in got)
    none = labels.limit(0)
    assert {(r["score"], r["predicted"]) for r in kneserney.score(odd, none).collect()} == {(0.0, 0)}
    assert kneserney.score(odd.limit(0), labels).count() == 0


def test_query(spark, folder):
    rows = queries.op1_toxicity(spark, folder).collect()
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert len(rows) == n and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def plain_models(labelled, corpus):
    """Difference of a word's log-likelihoods, by dictionaries of strings."""
    order, d = kneserney.ORDER, kneserney.DISCOUNT
    sign = lambda w: f"\x02{w}\x03"
    runs_of = lambda w, m: [sign(w)[e - m + 1 : e + 1] for e in range(max(1, m - 1), len(w) + 2)]
    all_words = {w for t in corpus for w in kneserney.words_of(t)}
    seen = {m: {r for w in all_words for r in runs_of(w, m)} for m in range(1, order + 1)}
    ahead = {r: 0 for m in range(1, order) for r in seen[m]}
    for m in range(2, order + 1):
        for r in seen[m]:
            ahead[r[1:]] += 1
    ahead = {r: max(1, n) for r, n in ahead.items()}
    follow = {}
    for m in range(1, order):
        for r in seen[m]:
            follow.setdefault(r[:-1], []).append(ahead[r])
    own = {}
    for text, toxic in labelled:
        for w in kneserney.words_of(text):
            for m in range(1, order + 1):
                for r in runs_of(w, m):
                    after = own.setdefault((toxic, r[:-1], m), {})
                    after[r[-1]] = after.get(r[-1], 0) + 1

    def shared(r):
        below = 1 / len(seen[1]) if len(r) == 1 else shared(r[1:])
        all_ = follow.get(r[:-1])
        return below if not all_ else (max(ahead.get(r, 0) - d, 0) + d * len(all_) * below) / sum(all_)

    def difference(word):
        out = 0.0
        for e in range(1, len(word) + 2):
            m = min(order, e + 1)
            r = sign(word)[e - m + 1 : e + 1]
            p = []
            for toxic in (1, 0):
                after, below = own.get((toxic, r[:-1], m), {}), shared(r[1:])
                total = sum(after.values())
                p.append((max(after.get(r[-1], 0) - d, 0) + d * len(after) * below) / total if total else below)
            out += math.log(p[0] / p[1])
        return out

    return difference


def test_models_against_plain_ones(spark):
    """Class counts of labelled texts, backoff from the words of all texts; scored words are known, new or of new letters."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    labelled = [(" ".join(word() for _ in range(12)), i % 2) for i in range(16)]
    corpus = [t for t, _ in labelled] + [" ".join(word() for _ in range(30)) for _ in range(40)] + [None, "", "12 !"]
    rows = spark.createDataFrame([(t, c) for t, c in labelled], "text string, toxic int")
    runs = kneserney.corpus_runs(spark.createDataFrame([(t,) for t in corpus], "text string"))
    arrow = kneserney.shared_counts(kneserney._class_counts(rows), runs).toArrow()
    table = {name: arrow.column(name).to_numpy() for name in arrow.column_names}
    table |= {name: table[name].view(np.uint64) for name in ("run", "context", "tail")}
    model, plain = kneserney.Model(table, runs.filter("m = 1").count()), plain_models(labelled, corpus)
    words = sorted({w for t, _ in labelled[:4] for w in t.split()}) + [word() for _ in range(100)] + ["zzz", "axzb", "q"]
    assert np.allclose(model.differences(words), [plain(w) for w in words], rtol=1e-4, atol=1e-4)


def test_backoff_grows_with_the_corpus(spark, tables):
    """Texts without labels add to the shared counts."""
    docs = tables[0].select("text")
    some, all_ = (kneserney.corpus_runs(d).count() for d in (docs.limit(100), docs.unionByName(spark.createDataFrame([("quite unlike words",)], "text string"))))
    assert some < all_
