import hashlib
import random

import pytest

from quernstone.llm import queries, substrings, suffixes

WORDS = (substrings.drop_repeated_words, 13, bytes.split, b" ".join)
BYTES = (suffixes.drop_repeated_bytes, 50, lambda b: b, bytes)


def brute(rows, n, split, join):
    """(id, symbols, removed, spans, kept) of each row."""
    key = lambda w, j: tuple(w[j : j + n])
    parts = [(i, split((t or "").encode())) for i, t in rows]
    first = {}
    for i, w in parts:
        for j in range(len(w) - n + 1) if i is not None else ():
            first[key(w, j)] = min(first.get(key(w, j), i), i)
    for i, w in parts:
        gone = [False] * len(w)
        for j in range(len(w) - n + 1) if i is not None else ():
            if first[key(w, j)] < i:
                gone[j : j + n] = [True] * n
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        yield i, len(w), sum(gone), spans, join([x for x, g in zip(w, gone) if not g])


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    common = " ".join(f"w{rng.randrange(1000)}" for _ in range(40))
    texts = []
    for i in range(200):
        a, b = (" ".join(f"{c}{rng.randrange(n)}" for _ in range(rng.randrange(30))) for c, n in (("x", 3), ("y", 300)))
        texts.append(f"{a} {common} {b}" if i % 2 else f"{a} {b}")
    texts += [None, "", "   ", "é" * 200, "é" * 200, "aaaa " * 100, "aaaa " * 90, common, common]
    return [(rng.randrange(1000) if i % 7 else i, t) for i, t in enumerate(texts)] + [(None, common), (5, common), (5, common)]


@pytest.mark.parametrize("hot, part", [(1000, 1 << 22), (3, 150), (1, 70), (1000, 333)])
@pytest.mark.parametrize("case", [WORDS, BYTES], ids=["words", "bytes"])
def test_odd_rows(spark, odd, case, hot, part):
    run, n, split, join = case
    df = spark.createDataFrame([(*r, "x") for r in odd], "doc_id long, text string, block string").repartition(3)
    as_bytes = lambda k: k.encode() if isinstance(k, str) else bytes(k)
    got = [(r["id"], r[1], r["n_removed"], r["n_spans"], as_bytes(r["kept"])) for r in run(df, hot=hot, part=part).collect()]
    assert sorted(got, key=str) == sorted(brute(odd, n, split, join), key=str)
    assert run(df.limit(0)).count() == 0


@pytest.mark.parametrize("query, case", [(queries.op2_substring, WORDS), (queries.op4_suffix, BYTES)], ids=["op2", "op4"])
def test_queries(spark, folder, query, case):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {i: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in brute(rows, *case[1:])}
    for r in query(spark, folder).collect():
        n, gone, spans, digest = want.pop(r["doc_id"])
        assert (r[1], r["n_removed"], r["kept_sha256"]) == (n, gone, digest) and r.asDict().get("n_spans", spans) == spans
    assert not want


def test_loser_tree():
    import numpy as np

    rng = np.random.default_rng(1)
    for width in (5, 8, 20):
        runs, shares, keys = [], [], []
        for size in (0, 1, 7, 30, 2):
            k = rng.integers(0, 3, (size, width), dtype=np.uint8)
            order, sent = suffixes.front_coded(k)
            back, shared = suffixes.unfolded(sent["head"], sent["body"], width)
            assert (back == k[order]).all()
            runs.append(suffixes._words(back).tolist())
            shares.append(shared.tolist())
            keys.append(back)
        run, at, lcp = suffixes.LoserTree(runs, shares, width).merged()
        merged = [keys[r][a].tobytes() for r, a in zip(run, at)]
        assert merged == sorted(x.tobytes() for k in keys for x in k)
        for a, b, n in zip(merged, merged[1:], lcp[1:]):
            same = next((i for i in range(width) if a[i] != b[i]), width)
            assert same == min(n, width)


def test_suffix_tree():
    import numpy as np

    rng = np.random.default_rng(3)
    words = sorted("".join(rng.choice(list("ab"), 6)) for _ in range(60))
    same = lambda a, b: next((i for i in range(6) if a[i] != b[i]), 6)
    tree = substrings.SuffixTree(np.array([0, *map(same, words, words[1:])]))
    for length in range(1, 7):
        leaves, node = tree.repeats(length)
        found = {}
        for leaf, n in zip(leaves.tolist(), node.tolist()):
            found.setdefault(n, []).append(leaf)
        want = {}
        for i, w in enumerate(words):
            want.setdefault(w[:length], []).append(i)
        assert sorted(found.values()) == sorted(v for v in want.values() if len(v) > 1)


def test_long_text_in_parts(spark):
    """A text of several parts of the production size, with passages that another document has across a border."""
    from quernstone.llm.repeats import PART

    rng = random.Random(8)
    words = [f"{rng.randrange(1 << 30):x}" for _ in range(PART // 4)]
    long, size = " ".join(words), 0
    near = next(i for i, w in enumerate(words) if (size := size + len(w) + 1) > PART)
    first = " ".join(words[near - 400 : near + 400])
    df = spark.createDataFrame([(1, first), (2, long)], "doc_id long, text string")
    row = substrings.drop_repeated_words(df).filter("id = 2").first()
    assert (row["n_words"], row["n_removed"], row["n_spans"]) == (len(words), 800, 1) and row["kept"] == " ".join(words[: near - 400] + words[near + 400 :])
    row = suffixes.drop_repeated_bytes(df).filter("id = 2").first()
    assert row["n_removed"] - len(first) in (0, 1, 2) and row["n_spans"] == 1
