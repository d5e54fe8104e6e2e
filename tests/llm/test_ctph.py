import hashlib
import random

import numpy as np
import pytest

from quernstone.llm import ctph, queries
from quernstone.llm.tokens import _BYTE, _K, _MIX, mix


def plain(data):
    """The fingerprint from its definition, one byte at a time."""
    table, full = [int(x) for x in _BYTE], 1 << 64
    poly = lambda b: sum(table[x] * pow(_K, i, full) for i, x in enumerate(b)) % full
    rolls = [poly(data[max(0, i - ctph.WINDOW + 1) : i + 1]) >> 24 for i in range(len(data))]

    trigger = lambda bits: [i + 1 for i, r in enumerate(rolls) if r % (1 << bits) == (1 << bits) - 1]

    def signature(bits):
        ends, last = [], 0
        for e in sorted({*trigger(bits), len(data)} - {0}):
            while e - last > ctph.LONGEST << bits:
                last += ctph.LONGEST << bits
                ends.append(last)
            ends.append(last := e)
        chunks = [data[a:b] for a, b in zip([0, *ends], ends)]
        words = [int(mix(np.array([(poly(c) + len(c) * int(_MIX)) % full], np.uint64))[0]) >> 52 for c in chunks]
        return "".join(ctph.LETTERS[w >> 6] + ctph.LETTERS[w & 63] for w in words)

    bits = ctph.BITS
    while ctph.CHUNKS << bits < len(data) or len(trigger(bits)) >= 2 * ctph.CHUNKS:
        bits += 1
    return f"{1 << bits}:{signature(bits)}:{signature(bits + 1)}"


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_fingerprints_as_defined(monkeypatch):
    rng = random.Random(1)
    texts = [b"", b"a", b"abc", b"a" * 500, "é世界".encode() * 40, bytes(rng.randrange(256) for _ in range(900)), *(words(rng, n).encode() for n in (3, 20, 60, 200, 900)), b"ab" * 700 + b"tail"]
    for block in (1 << 20, 50, 7):
        monkeypatch.setattr(ctph, "BLOCK", block)
        assert [ctph.fingerprint(t) for t in texts] == [plain(t) for t in texts]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randrange(70)) for _ in range(2))
        assert ctph.distance(a, b) == table(a, b)


def test_likeness():
    rng = random.Random(3)
    for n in (30, 300, 3000):
        text, other = words(rng, n), words(rng, n)
        a, b = (ctph.fingerprint(t.encode()) for t in (text, other))
        edited = ctph.fingerprint(ctph.edited(text, other).encode())
        assert 0.5 < ctph.likeness(a, edited) == ctph.likeness(edited, a) < 0.95 and ctph.likeness(a, b) < 0.3
        one = ctph.fingerprint(text.replace(" ", "  ", 1).encode())
        assert ctph.likeness(a, one) > 0.85
        assert ctph.likeness(a, ctph.fingerprint((text * 9).encode())) < 0.5
    assert ctph.likeness("1::", "1::") == 1.0 and ctph.likeness("1::", ctph.fingerprint(b"abc")) == 0.0
    doubled = ctph.fingerprint((text + other[: len(other) // 3]).encode())
    assert ctph.likeness(ctph.fingerprint(text.encode()), doubled) > 0.6


def brute(docs, share=4):
    """Rows (id, text) in their order."""
    out = []
    for n, (i, t) in enumerate(docs):
        following = docs[(n + 1) % len(docs)][1] or ""
        new = ctph.edited(t or "", following, share)
        prints = [ctph.fingerprint(x.encode()) for x in (t or "", new, following)]
        out.append((i, len(t or ""), hashlib.sha256(new.encode()).hexdigest(), *prints[:2], ctph.likeness(*prints[:2]), ctph.likeness(prints[0], prints[2])))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("parts", [None, 1, 3, 40])
def test_ranges_of_ids(spark, parts):
    rng = random.Random(4)
    some = ["", None, "é" * 99, "x" * 5000, "line\nline\n" * 30, "abc", *(words(rng, rng.randrange(60)) for _ in range(90))]
    docs = [(i * 7 - 100, some[i % len(some)]) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(ctph.with_next(df, parts=parts)) == sorted(brute(docs), key=str)


def test_odd_rows(spark):
    """Rows that share an id or have none, equal rows, one row, no rows, clashing columns, bytes that are no UTF-8."""
    docs = [(5, "one two three four"), (5, "one two three four"), (5, "another text of the id"), (7, "seven seven"), (None, "no id here"), (None, None), (None, "no id here")]
    extra = ["id", "part", "guest", "bare", "tie", "to", "whole", "n_chars"]
    df = spark.createDataFrame([(*r, *[1] * len(extra)) for r in docs], "doc_id long, text string, " + ", ".join(f"{c} int" for c in extra))
    for parts in (1, 2, 9):
        got = ctph.with_next(df, parts=parts).collect()
        assert sorted(map(str, ((r["id"], r["n_chars"]) for r in got))) == sorted(str((i, len(t or ""))) for i, t in docs)
        of = {}
        for r in got:
            of.setdefault((r["id"], r["n_chars"]), []).append(tuple(r))
        bare = [(i, t) for i, t in docs if i is None]
        firsts = {r[2] for r in of[7, 11]}
        assert firsts <= {hashlib.sha256(ctph.edited("seven seven", t or "").encode()).hexdigest() for _, t in bare} and len(firsts) == 1
    one = df.filter("doc_id = 7")
    assert rows(ctph.with_next(one)) == brute([(7, "seven seven")])
    assert ctph.with_next(df.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"ab\xff\xfecd\xe4" * 9)), (2, bytearray(b"plain"))], "doc_id long, text binary")
    assert {r["id"]: r["n_chars"] for r in ctph.with_next(bad).collect()} == {1: 63, 2: 5}


def test_query(spark, folder):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = queries.op11_ctph(spark, folder)
    assert got.columns[0] == "doc_id" and rows(got) == sorted(brute(docs), key=str)
    near = [(r["near_edited"], r["near_next"]) for r in got.collect() if r["n_chars"] >= 200]
    assert np.mean([a > 0.5 for a, _ in near]) > 0.97 and np.mean([b < 0.3 for _, b in near]) > 0.9
    df = spark.createDataFrame([("x " * 50, "x " * 50), (None, "")], "a string, b string")
    assert [r[0] for r in df.select(ctph.likeness_of(ctph.fingerprint_of("a"), ctph.fingerprint_of("b"))).collect()] == [1.0, 1.0]
