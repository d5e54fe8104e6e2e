import random
import re
from itertools import permutations

import duckdb
import numpy as np

from quernstone.llm import audit, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    return [len(words), len(set(words)), len(text or ""), len(re.findall("[A-Z]", text or "")), len(re.findall(r"[#$%&*|]", text or ""))]


def texts():
    rng = random.Random(5)
    some = ["", "   ", "\n\ta\x0bb", "é" * 30, "ÀÉ A B  x", "x", "AB" * 40, "a|b", "word " * 60, "\x1c sep \x85 sep"]
    for _ in range(60):
        some.append(" ".join("".join(rng.choice("abcABé$世") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(120))))
    return some


def flat(many):
    raw = [t.encode() for t in many]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def test_scan_counts_as_plain_python(monkeypatch):
    many = texts()
    want = [counts(t) for t in many]
    for block in (1 << 20, 64, 7):  # at 7, most texts are long ones, scanned in pieces
        monkeypatch.setattr(audit, "BLOCK", block)
        assert audit.scan(*flat(many)).T.tolist() == want
    assert audit.scan(*flat([])).shape == (5, 0)


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(audit, "word_hashes", lambda flat, starts, ends: (ends - starts).astype(np.uint64) % 2)
    many = texts()
    for block in (1 << 20, 64):
        monkeypatch.setattr(audit, "BLOCK", block)
        assert audit.scan(*flat(many)).T.tolist() == [counts(t) for t in many]


def brute(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[n] == 1} for n in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, s in docs:
        w, d, n, caps, sym = counts(t)
        bad = {c for c, f in zip("ABCDE", (w < 50, 100 * d < 65 * w, 100 * caps > 5 * n, sym > 0, i is not None and first[t or ""] < i)) if f}
        rows.append((s or "", bad, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order):
                before = set(order[:step])
                gone = [r for r in left if c in r[0]]
                left = [r for r in left if c not in r[0]]
                redundant = sum(c in r[0] and bool(r[0] & before) for r in mine)
                out[part, "".join(order), step + 1] = [len(left), len(gone), redundant, sum(r[0] == {c} for r in mine), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    total = {}
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    return {k: [*v, total[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def test_all_orders_of_odd_rows(spark):
    """Nulls, empty and repeated texts, rows that share an id, ties, and columns with other meanings."""
    many = [*texts(), None, "", "word " * 60, "same text twice " * 20, "same text twice " * 20]
    docs = [(i, t, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(many)]
    docs += [(None, many[3], "s1"), (None, many[3], "s1"), (3, many[3], "s2"), (3, many[20], None), *docs[10:14]]
    labels = [(i, i % 2, i % 3 == 0 and 1 or None) for i in range(0, 70, 2)] + [(None, 1, 1), (4, 1, 0), (4, None, 1)]
    extra = ["id", "part", "failed", "digest", "n", "good", "toxic", "first"]
    df = spark.createDataFrame([(*r, *[9] * len(extra)) for r in docs], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in extra))
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in audit.audit(df, said).collect()}
    assert got == brute(docs, labels) and len(got) == 4 * 600
    assert audit.audit(df.limit(0), said).count() == 0
    assert audit.audit(df, said.limit(0)).agg({"good_lost": "max"}).first()[0] == 0
    marks = audit.with_copies(audit.marked(df)).filter(audit.failing(audit.F.col("failed"), "E"))
    assert {r["id"] for r in marks.collect()} >= {i for i, t in enumerate(many) if t == ""} - {0}


def test_query_as_its_sql(spark, folder):
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    got = queries.op13_filters(spark, folder)
    want = duck.execute(queries.SQL["op13_filters"])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())
