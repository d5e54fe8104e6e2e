import hashlib
import random
from collections import Counter

from quernstone.llm import lines, queries

SPACE = " \t\n\v\f\r"


def close(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a == b or a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def brute(rows, least=12):
    """By row, the lines that stay (None for a null text); short lines are copies only of the same line."""
    places = [((i is None, i or 0, k), r, x.strip(SPACE)) for r, (i, t) in enumerate(rows) for k, x in enumerate((t or "").split("\n")) if x.strip(SPACE)]
    gone = {(r, p[2]) for p, r, x in places if any(q < p and (x == y or min(len(x), len(y)) >= least and close(x, y)) for q, _, y in places)}
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r, k) not in gone) for r, (_, t) in enumerate(rows)]


def test_odd_rows(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(8, 40))) for _ in range(25)]

    def edit(s):
        i = rng.randrange(len(s) + 1)
        return rng.choice([s[:i] + "x" + s[i:], s[:i] + s[i + 1 :], s[:i] + "b" + s[i + 1 :], s])

    rows = []
    for d in range(120):
        some = [" " * rng.randrange(2) + edit(edit(rng.choice(base))) for _ in range(rng.randrange(6))]
        rows.append((rng.choice([d, d, d, 7, None]), "\n".join(some)))
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "same line of text"), (1003, "same line of text")]
    df = spark.createDataFrame([(*r, "x", r[0]) for r in rows], "doc_id long, text string, of string, kept long").repartition(3)
    got = lines.drop_repeated_lines(df).collect()
    ids = Counter(i for i, _ in rows)
    want = {i: x for (i, _), x in zip(rows, brute(rows)) if ids[i] == 1}
    assert {r["doc_id"]: r["text"] for r in got if ids[r["doc_id"]] == 1} == want
    assert len(got) == len(rows) and all(r["of"] == "x" and r["kept"] == r["doc_id"] for r in got)
    assert [r["text"] for r in got if r["doc_id"] == 1003] == ["same line of text"] * 2
    assert lines.drop_repeated_lines(df.limit(0)).count() == 0


def test_one_line_many_times(spark):
    """A large group of equal lines, and one of lines that differ in one place."""
    rows = [(i, f"the very same line\nalmost the same line {chr(0x4E00 + i)} here\nown {i * i * 7919} {i}") for i in range(300)]
    got = {r["doc_id"]: r["n_removed"] for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 0 and all(got[i] >= 2 for i in range(1, 300))


def test_query(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {i: hashlib.sha256(x.encode()).hexdigest() for (i, _), x in zip(rows, brute(rows))}
    assert {r["doc_id"]: r["kept_sha256"] for r in queries.op5_lines(spark, folder).collect()} == want


def test_null_ids_and_clashing_names(spark):
    """Texts without an id are documents of their own, after all others; columns of the input stay."""
    shared = "a line that many of them have"
    rows = [(None, f"{shared}\nown line of number {i:09d} {'x' * i}", i, 7) for i in range(40)] + [(9, shared, 99, 7), (None, None, 98, 7), (None, "", 97, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_removed int").repartition(3)
    got = {r["n_lines"]: r for r in lines.drop_repeated_lines(df).collect()}
    assert got[99]["text"] == shared and got[98]["text"] is None and got[97]["text"] == ""
    assert [got[i]["n_removed_"] for i in range(40)] == [1] * 40 and all(r["n_removed"] == 7 for r in got.values())
    assert {r["id"] for r in lines.drop_repeated_lines(df.withColumnRenamed("n_lines", "id").withColumnRenamed("n_removed", "late")).collect()} == {*range(40), 97, 98, 99}


def test_list_is_joined_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i, f"line of some length with number {i % 7}\nanother line {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, lines.drop_repeated_lines(df).collect()))
    monkeypatch.setattr(lines, "BROADCAST", 0)
    assert sorted(map(tuple, lines.drop_repeated_lines(df).collect())) == want
