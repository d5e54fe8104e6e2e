"""Similar titles against all pairs and a plain greedy pass."""

import random

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import dedup, graph, models


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def greedy(rows, ratio=0.92):
    free, out = dict.fromkeys((i for i, _ in rows), True), {}
    for n, (i, a) in enumerate(rows):
        if not free[i]:
            continue
        members = [i]
        for j, b in rows[n + 1 :]:
            longer = max(len(a), len(b))
            if free[j] and a.split()[0] == b.split()[0] and abs(len(a) - len(b)) <= 0.15 * longer and distance(a, b) <= int((1 - ratio) * longer + 1e-9):
                members.append(j)
        if len(members) > 1:
            for j in members:
                free[j], out[j] = False, i
    return out


def test_fuzzy_groups_as_all_pairs(spark):
    rng = random.Random(5)
    words = "a study of long term care in the large rural region with many small hospitals aaaa aaab".split()
    titles = []
    for n in range(160):
        t = list(" ".join(["the" if n % 3 else "on", *(rng.choice(words) for _ in range(rng.randrange(2, 12)))]))
        titles.append("".join(t))
        for _ in range(rng.randrange(3)):  # chains of edits
            t[rng.randrange(4, len(t))] = rng.choice("abc ")
            titles.append("".join(t))
    titles += ["the aaaaaaaaaaaaaaaaaaaaaaaa", "the aaaaaaaaaaaaabaaaaaaaaaa", None, "short", titles[0], titles[5]]
    rng.shuffle(titles)
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    plain = {r["id"]: r["t"] for r in df.select("id", T.normalize_title(F.col("title")).alias("t")).collect() if r["t"]}
    assert {r["id"]: r["group_id"] for r in dedup.fuzzy_groups(df).collect()} == greedy(sorted(plain.items()))
    assert dedup.fuzzy_groups(df.limit(0)).count() == 0


def test_a_first_word_of_all_titles(spark):
    """Titles that only share their first word are no candidates of each other."""
    df = spark.range(4000).select("id", F.concat(F.lit("the "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40)).alias("t"))
    assert dedup.similar_titles(df).count() == 0


def test_a_long_path_is_one_community(spark):
    nodes = spark.range(60).select(F.col("id").alias("vec_id"))
    edges = spark.range(59).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["community"] for r in graph.communities(nodes, edges).collect()} == {0}


def test_hull(spark):
    rng = random.Random(7)
    points = [("g", rng.uniform(-1, 1) * 0.7, rng.uniform(-1, 1) * 0.7) for _ in range(300)] + [("g", x, y) for x in (-1.0, 1.0) for y in (-1.0, 1.0)] + [("g", 0.0, 1.0), ("h", 1.0, 2.0), ("h", 1.0, 2.0)]
    got = [(r["x"], r["y"]) for r in graph.convex_hull(spark.createDataFrame(points, "k string, x double, y double"), "k").filter("k = 'g'").orderBy("place").collect()]
    assert got == [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]


def test_metrics_over_many_scores(spark):
    rng = random.Random(2)
    rows = [(rng.random() < 0.3, rng.choice([rng.random(), 0.5])) for _ in range(3000)]
    df = spark.createDataFrame([(int(y), s + 0.2 * y) for y, s in rows], "y int, s double")
    data = [(r["y"], r["s"]) for r in df.collect()]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, done = 0.0, 0.0
    for t in sorted({s for _, s in data}, reverse=True):
        hit = sum(s >= t for s in pos)
        ap += (hit - done) / len(pos) * hit / (hit + sum(s >= t for s in neg)) if hit > done else 0.0
        done = hit
    row = models.classification_metrics(df, "y", "s").first()
    assert abs(row["roc_auc"] - auc) < 1e-9 and abs(row["average_precision"] - ap) < 1e-9


def test_importances_scorers_and_warnings(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1), rng.choice(["a", "b", None]), rng.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame([(i, x, k, z, 5 * x + (2 if k == "a" else 0)) for i, x, k, z in rows], "id long, x double, k string, z double, y double")
    got = models.train(df, "y", ["x", "k", "z"], key="id")
    by = got["importances_by_variable"]
    assert abs(sum(by.values()) - 1) < 1e-9 and by["x"] > by["k"] > by["z"] and got["importances"][0][0] == "x"
    assert models.scorer("average_precision", "classification") == ("average_precision", True) and models.scorer("average_precision", "classification", 3) == ("roc_auc", True)
    assert models.scorer(None, "regression") == ("rmse", False) and models.scorer("r2", "regression") == ("r2", True)
    assert models.positive_class(["décès", "survie"]) == "décès" and models.positive_class([0.0, 1.0]) == "1.0" and models.positive_class(["Mort", "oui"]) == "Mort"
    assert models.positive_class(["non", "oui"]) == "oui" and models.positive_class(["x", "Y"], "y") == "Y" and models.positive_class(["a", "b"]) == "b"
    assert models.unstable({"r2": 0.5, "r2_std": 0.2}, "r2") and models.unstable({"r2": 0.5, "r2_std": 0.1}, "r2") is None
    own = df.withColumn("c", (F.col("x") > 0).cast("int")).withColumn("twin", F.col("x") ** 3)
    assert models.guardrails(own, "c", ["x", "z"], "classification") == ["leak: x"]
    one = df.withColumn("c", F.when(F.col("id") == 1, "yes").otherwise("no"))
    board = {r["family"]: r["error"] for r in models.compare(one, "c", ["x"], ["logistic"], "classification", "roc_auc", key="id").collect()}
    assert "two rows" in board["logistic"]


def test_distances_stop_at_the_most_edits(spark):
    """Titles may be whole texts; of two such, only what so many edits can reach is compared.  Pieces are those of the plain cut."""
    rng = random.Random(11)
    t = "the " + " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000))
    u = t[:5000] + "xyz" + t[5004:] + "é"
    df = spark.createDataFrame([(1, t), (2, u), (3, "the " + t[::-1]), (4, "ab"), (5, "ééé à"), (6, "ééé à")], "id long, t string").coalesce(1)
    out = dedup.similar_titles(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ", most" in plan[plan.index("levenshtein") :].split("\n")[0] or "cast(FLOOR" in plan[plan.index("levenshtein") :].split("\n")[0]
    assert sorted((r["a"], r["b"]) for r in out.collect()) == [(1, 2), (5, 6)]


def test_stretches_of_a_word_meet_as_all_pairs(spark):
    """A word of many titles in few or many stretches, some of one length in parts: the same pairs."""
    rng = random.Random(9)
    titles = []
    for n in range(120):
        t = list("the " + "".join(rng.choice("abcd ") for _ in range(rng.choice([12, 30, 30, 30, 90]))) + "x")
        for _ in range(3):
            titles.append(" ".join("".join(t).split()))
            t[rng.randrange(4, len(t))] = rng.choice("abcd")
    titles = sorted(set(titles))
    want = {(a, b) for a, s in enumerate(titles) for b, t in enumerate(titles[:]) if a < b and distance(s, t) <= int(0.08 * max(len(s), len(t)) + 1e-9)}
    df = spark.createDataFrame(list(enumerate(titles)), "id long, t string")
    for stretch in (400, 5000, dedup.STRETCH):
        assert sorted((r["a"], r["b"]) for r in dedup.similar_titles(df, stretch=stretch).collect()) == sorted(want)
    assert len(want) > 50


def test_pieces_of_titles_are_not_shuffled(spark):
    """Titles go to disk a few times, not once for each of their pieces."""
    rng = random.Random(3)
    titles = ["the " + "".join(rng.choice("abcdefghijklmnop ") for _ in range(600)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, t string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert dedup.similar_titles(df).count() == 0
    assert written() - before < 2 * sum(map(len, titles))


def test_near_copies_are_compared_with_their_anchor(spark, monkeypatch):
    """A group of near copies costs a distance or few for each, not one for each two."""
    rng, asked, alike = random.Random(1), [], dedup._alike
    base = "the " + "".join(rng.choice("abcdefgh ") for _ in range(100)) + "x"
    titles = [base[: 4 + n] + "é" + base[5 + n :] for n in range(90)]

    def counted(pairs, ratio):
        asked.append(pairs.count())
        return alike(pairs, ratio)

    monkeypatch.setattr(dedup, "_alike", counted)
    got = dedup.fuzzy_groups(spark.createDataFrame(list(enumerate(titles)), "id long, title string")).collect()
    assert len(got) == 90 and {r["group_id"] for r in got} == {0}
    assert sum(asked) < 4 * 90
