"""Similarity graphs, communities and clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm
from ..session import saved

#: A knowledge graph is drawn of this many nodes at most; more are an error, not a sample.
NODES = 400


def similarity_edges(nodes: DataFrame, least: float = 0.35, key: str = "vec_id", vector: str = "embedding", most_nodes: int = NODES) -> DataFrame:
    """Edges (a < b, similarity) between the chosen nodes.

    The feature draws a picture of few nodes, so their number is checked and the pairs are
    compared in the JVM; near duplicates of whole tables are another operator's work.
    """
    if nodes.select(key).limit(most_nodes + 1).count() > most_nodes:
        raise ValueError(f"a similarity graph has at most {most_nodes} nodes")
    unit = nodes.select(F.col(key).alias("id"), F.transform(vector, lambda x: x / norm(F.col(vector))).alias("u"))
    a, b = unit.select(F.col("id").alias("a"), F.col("u").alias("ua")), unit.select(F.col("id").alias("b"), F.col("u").alias("ub"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", dot(F.col("ua"), F.col("ub")).alias("similarity"))
    return pairs.filter(F.col("similarity") >= least)


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "vec_id") -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias(key)).groupBy(key).agg(F.count("*").alias("degree"))
    return nodes.select(key).join(ends, key, "left").select(key, F.coalesce("degree", F.lit(0)).alias("degree"))


def communities(nodes: DataFrame, edges: DataFrame, key: str = "vec_id") -> DataFrame:
    """Connected groups (key, community), by the smallest key that a node reaches over any number of edges.

    Each round a node takes the smallest label of its neighbours, and then the label of
    that label, so a path of n nodes takes about log n rounds; it ends when no label moves.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = saved(nodes.select(F.col(key).alias("id"), F.col(key).alias("label")))
    while True:
        heard = both.join(label, both.b == label.id).groupBy("a").agg(F.min("label").alias("heard"))
        now = label.join(heard, label.id == heard.a, "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        up = now.select(F.col("id").alias("of"), F.col("label").alias("higher"))
        now = saved(now.join(up, now.label == up.of, "left").select("id", "was", F.least("label", F.coalesce("higher", "label")).alias("label")))
        label = now.select("id", "label")
        if not now.filter("was <> label").limit(1).count():
            return label.select(F.col("id").alias(key), F.col("label").alias("community"))


def convex_hull(points: DataFrame, group: str, x: str = "x", y: str = "y", parts: int = 64) -> DataFrame:
    """The corners (group, place, x, y) of each group's convex hull, counter-clockwise from the leftmost; inner and collinear points go.

    A group is dealt into parts whose hulls are taken first, so only corners of parts meet in one task.
    """

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        found = sorted(set(zip(part["x"].tolist(), part["y"].tolist())))
        if len(found) > 2:
            corners = []
            for order in (found, found[::-1]):
                chain: list[tuple[float, float]] = []
                for p in order:
                    while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                        chain.pop()
                    chain.append(p)
                corners += chain[:-1]
            found = corners
        return pd.DataFrame({group: part[group].iloc[0], "place": range(len(found)), "x": [p[0] for p in found], "y": [p[1] for p in found]})

    out = f"{group} {dict(points.dtypes)[group]}, place int, x double, y double"
    rows = points.select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    local = rows.withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.lit(parts))).groupBy(group, "_part").applyInPandas(walk, out)
    return local.groupBy(group).applyInPandas(walk, out)


def clusters(df: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", seed: int = 42, noise: float = 2.5) -> DataFrame:
    """Clusters of vectors with plane coordinates and a noise flag.

    PCA and KMeans stand in for UMAP and HDBSCAN, which are not available; ``method`` says so.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    plane = PCA(k=2, inputCol="features", outputCol="xy").fit(rows).transform(rows)
    model = KMeans(k=k, seed=seed).fit(plane)
    out = model.transform(plane)
    centers = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, center array<double>")
    gap = F.zip_with(vector_to_array("features"), "center", lambda x, y: x - y)
    out = out.join(F.broadcast(centers), "prediction").withColumn("gap", F.sqrt(dot(gap, gap)))  # k rows
    typical = out.groupBy("prediction").agg(F.avg("gap").alias("typical"))
    out = out.join(F.broadcast(typical), "prediction")  # k rows
    xy = vector_to_array("xy")
    return out.select(key, F.col("prediction").alias("cluster"), xy[0].alias("x"), xy[1].alias("y"), (F.col("gap") > noise * F.col("typical")).alias("noise"), F.lit("pca+kmeans").alias("method"))


def top_words(df: DataFrame, text: str, group: str, k: int = 8, least: int = 4) -> DataFrame:
    """The words that weigh most in each group: count times log(groups / groups that have the word)."""
    from pyspark.sql import Window as W

    words = df.select(group, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\p{L}+)"), F.lit(1))).alias("word")).filter(F.length("word") >= least)
    n = words.groupBy(group, "word").agg(F.count("*").alias("n"))
    spread = n.groupBy("word").agg(F.count("*").alias("groups"))
    total = df.select(group).distinct().agg(F.count("*").alias("total"))
    scored = n.join(spread, "word").crossJoin(F.broadcast(total)).withColumn("weight", F.col("n") * F.ln(1 + F.col("total") / F.col("groups")))  # one row
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.col("weight").desc(), "word"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(group, "rank", "word", "n", "weight")


def topics(df: DataFrame, text: str, k: int, words: int = 8, seed: int = 42, vocabulary: int = 5000) -> DataFrame:
    """Topics (topic, word, weight) by LDA over the most frequent words."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    rows = df.select(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\p{L}{4,})"), F.lit(1)).alias("words"))
    counter = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary).fit(rows)
    model = LDA(k=k, seed=seed, maxIter=10).fit(counter.transform(rows))
    vocab = counter.vocabulary
    out = [(t["topic"], vocab[i], float(w)) for t in model.describeTopics(words).collect() for i, w in zip(t["termIndices"], t["termWeights"])]  # k * words
    return df.sparkSession.createDataFrame(out, "topic int, word string, weight double")
