import random

import numpy as np
import xxhash

from quernstone.llm import components, queries, simhash


def brute(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check(rows, got, groups, radius=3):
    """rows: (id, fingerprint)."""
    g = groups(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                g.join(i, j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        least.setdefault(g.find(i), []).append(id_)
    want = sorted(((id_, fp, min((x for x in least[g.find(i)] if x is not None), default=None)) for i, (id_, fp) in enumerate(rows)), key=str)
    assert sorted(got, key=str) == want


def test_query(spark, folder, groups):
    rows = [(r["doc_id"], brute(r["text"])) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(rows, [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in queries.op8_simhash(spark, folder).collect()], groups)


def test_odd_rows(spark, groups):
    rng = random.Random(2)
    texts = [None, "", "  \n", "a", "a b", "A B", "a b c d", "ü ß c d e"] + [" ".join(rng.choice("abcdef") for _ in range(200)) for _ in range(5)]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(3, "a"), (3, "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = [(r[0], r[1] % (1 << 64), r[2]) for r in simhash.near_duplicates(df).collect()]
    check([(i, brute(t)) for i, t in rows], got, groups)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_in_large_shards(spark, groups):
    """Fingerprints that share most bits, with shards dealt out again from four members on."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = set()
    for _ in range(300):
        v = base
        for _ in range(rng.randrange(9)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    g = groups(signed)
    for v in signed:
        for w in signed:
            if v < w and ((v ^ w) % (1 << 64)).bit_count() <= 3:
                g.join(v, w)
    for shard in (4, 1024):
        links = simhash.near_links(df, 3, shard)
        found = {r["id"]: r["component"] for r in components.components(links).collect()}
        assert {v: found.get(v, v) for v in signed} == {v: g.find(v) for v in signed}


def test_components(spark, groups):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    g = groups({x for e in edges for x in e})
    for a, b in edges:
        g.join(a, b)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: g.find(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def test_near_copies_at_a_similarity(spark, groups):
    """Edited copies from well above 0.8 to well below, by brute-force Jaccard; a large group of copies of one text."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [None, "", "  ", "one two", "One TWO", "one two three"]
    for edits in [0, 1, 2, 3, 4, 6, 8, 12] * 10:
        base = [word() for _ in range(200)]
        copy = list(base)
        for at in rng.sample(range(200), edits):
            copy[at] = word()
        texts += [" ".join(base), " ".join(copy)]
    base = [word() for _ in range(200)]
    texts += [" ".join(word() if i == k else w for i, w in enumerate(base)) for k in range(200)]
    sets, prints = [shingles(t) for t in texts], [brute(t, 5) for t in texts]
    g, linked = groups(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            alike = not both or len(sets[i] & sets[j]) >= 0.8 * both
            if alike or (prints[i] ^ prints[j]).bit_count() <= 3:
                g.join(i, j)
            linked += alike and (prints[i] ^ prints[j]).bit_count() > 3
    assert linked > 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert got == {i: g.find(i) for i in range(len(texts))}
    old = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, words=5, radius=3).collect()}
    assert old != got
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_bands_of_many_texts(spark, groups, monkeypatch):
    """Chains of texts that share bands, where the first text of a band is like few of the others; few and many leaders, with and without a broadcast."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(3):
        stem = [word() for _ in range(150)]
        for _ in range(12):  # branches about 0.6 like each other, each with a chain of copies
            branch = list(stem)
            for at in rng.sample(range(150), 7):
                branch[at] = word()
            for _ in range(6):
                texts.append(" ".join(branch))
                for at in rng.sample(range(150), 3):
                    branch[at] = word()
    sets, prints = [shingles(t) for t in texts], [brute(t, 5) for t in texts]
    g = groups(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 3:
                g.join(i, j)
    want = {i: g.find(i) for i in range(len(texts))}
    assert 10 < len(set(want.values())) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for leaders in (1, simhash.LEADERS):
        monkeypatch.setattr(simhash, "BROADCAST", 0 if leaders == 1 else 100_000)
        assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df, leaders=leaders).collect()} == want


def test_parities_never_rule_out_a_similar_pair():
    """Sets differ in at least as many shingles as their parities in bits, whatever their sizes."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for kept in (0, n // 2, n * 9 // 10, n):
            b = np.unique(np.concatenate((a[:kept], rng.integers(0, 1 << 63, n // 8, dtype=np.uint64))))
            p, q = (np.array(simhash._parities(x), np.int64) for x in (a, b))
            bits = int(np.unpackbits((p ^ q).view(np.uint8)).sum())
            assert bits <= len(np.setxor1d(a, b)) and (n < 40 or kept == n or bits > 0)
