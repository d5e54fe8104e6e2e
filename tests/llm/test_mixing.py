import math
import re
from collections import defaultdict

import pytest

from quernstone.llm import mixing, queries


def brute_targets(sizes, most=3.0, cycle=(1, 2, 3)):
    """sizes by source in order; shares again and again until no target is above its limit."""
    weight = [cycle[i % len(cycle)] for i in range(len(sizes))]
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        w = sum(weight[i] for i in free)
        target = [most * s if i in capped else left * weight[i] / w for i, s in enumerate(sizes)]
        over = {i for i in free if target[i] > most * sizes[i] + 1e-9}
        if not over:
            return target
        capped |= over


def check(rows, got, tolerance):
    """rows: (id, text, source)."""
    by = defaultdict(int)
    for _, t, s in rows:
        by[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, brute_targets([by[s] for s in order])))
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == by[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= tolerance + 1e-3 * target[s], s
    want = sorted((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows if i is not None)
    assert sorted((r["doc_id"], r["size"], r["source"]) for r in got if r["doc_id"] is not None) == want and len(got) == len(rows)


def test_query(spark, folder):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    check(docs, got, 8)
    again = {r["doc_id"]: r["taken"] for r in queries.op9_mixing(spark, folder).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_limits_and_odd_rows(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(5, "a"), (400, "b"), (300, "b"), (3, "c"), (0, "d"), (50, None), (7, ""), (1, "z")])]
    rows += [(2, "x y", "b"), (2, "x y", "b"), (9, None, "b"), (9, None, "b"), (10, " \t\n", "d")]
    got = mixing.mix(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string")).collect()
    check(rows, got, 4)
    ids = mixing.mix(spark.createDataFrame([(None, "a b", "s"), (1, "c", "s")], "doc_id long, text string, source string")).collect()
    assert len(ids) == 2 and sum(r["taken"] for r in ids) == 3


def test_blocks_of_many_tokens(spark):
    rows = [(i, "w " * (1 + i % 40), "abc"[i % 3]) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=500).collect()
    check(rows, got, 60)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    none = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(none).collect()] == [(0.0, 0)] * 2


def test_tiny_sources_beside_a_huge_one(spark):
    """Sources smaller than a slot of all tokens, one of one word, and one whose last lap is a partial one."""
    rows = [(i, 1_250_000, "huge") for i in range(4000)] + [(10_000 + i, 100, "tiny") for i in range(10)] + [(20_000 + i, 25, "small") for i in range(100)]
    rows += [(30_000, 1, "word")] + [(40_000 + i, 7_001, "odd") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, words long, source string")
    got = mixing.mix(df, text="words", size=mixing.F.col("words")).collect()
    by, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(by[s] - t) <= 0.005 * t, (s, by[s], t)


def brute_parts(rows, target, slots, seed=42):
    """rows: (id, size, source, h) of documents with words -> ({id: taken}, [(at, nth, source)]) by dealing slot after slot, word after word."""
    order = sorted(target, key=lambda s: (s is None, s or ""))
    total = sum(target.values())
    tokens = max(1, -int(-total // max(slots, 64 * len(order))))
    high, at = {}, 0.0
    for s in order:
        at += target[s]
        high[s] = at / total
    rings = {s: [r[0] for r in sorted((r for r in rows if r[2] == s), key=lambda r: (r[4], r[3], r[0], r[1])) for _ in range(r[1])] for s in order}
    taken, dealt, n = defaultdict(int), [], -int(-total // tokens)
    turns = defaultdict(int)
    for i in range(n):
        x = i * 0.6180339887498949
        s = next((s for s in order if x - math.floor(x) < high[s]), None)
        if s is None:
            continue
        nth, turns[s] = turns[s], turns[s] + 1
        dealt.append(((i + 0.5) / n, nth, s))
        for w in range(nth * tokens, min((nth + 1) * tokens, 3 * len(rings[s]))):
            taken[rings[s][w % len(rings[s])]] += 1
    return taken, dealt


@pytest.mark.parametrize("slots", [200, 1000, 100_000])
def test_against_a_brute_schedule(spark, slots, monkeypatch):
    """Slots, blocks and takings are those of dealing one slot after the other; buckets of a few rows."""
    monkeypatch.setattr(mixing, "BUCKET", 50)
    rows = [(i, "w " * (1 + i * 7 % 40), "abbc"[i % 4]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, slots=slots).collect()
    h = {r["doc_id"]: r["h"] for r in df.select("doc_id", mixing.F.xxhash64(mixing.F.lit(42), "doc_id", "text").alias("h")).collect()}
    buckets = -(-len(rows) // 50)
    sized = [(i, 1 + i * 7 % 40, s, h[i], h[i] % buckets) for i, _, s in rows]
    target = {r["source"]: r["target"] for r in got}
    taken, dealt = brute_parts(sized, target, slots)
    assert {r["doc_id"]: r["taken"] for r in got} == {i: taken[i] for i, _, _ in rows}
    parts = mixing.stream(df, slots=slots).collect()
    assert {(round(r["at"], 9), r["nth"], r["source"]) for r in parts} <= {(round(a, 9), n, s) for a, n, s in dealt}
    by = defaultdict(int)
    for r in parts:
        assert 0 <= r["skip"] and 0 < r["part"] and r["skip"] + r["part"] <= 1 + r["doc_id"] * 7 % 40
        by[r["doc_id"]] += r["part"]
    assert by == {i: n for i, n in taken.items() if n}


def test_order_of_the_mix(spark):
    """At every tenth of the mix, each source is near its share of what has been dealt."""
    rows = [(i, "w " * 20, "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    parts = mixing.stream(df).collect()
    target = {r["source"]: r["target"] for r in mixing.mix(df).collect()}
    for tenth in range(1, 11):
        for s, t in target.items():
            sofar = sum(r["part"] for r in parts if r["source"] == s and r["at"] <= tenth / 10)
            assert abs(sofar - t * tenth / 10) <= 4
