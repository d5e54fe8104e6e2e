import pytest
from pyspark.sql import functions as F

from quernstone.streaming import living_review, review_stream

SCHEMA = "external_id string, source string, scenario_id string, entered date"


class Landing:
    """A folder that gets a file of records at a time: (external_id, source, days before today)."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def add(self, *rows):
        df = self.spark.createDataFrame(list(rows), "external_id string, source string, days int")
        df.select("external_id", "source", F.lit("s").alias("scenario_id"), F.date_sub(F.current_date(), F.col("days")).alias("entered")).coalesce(1).write.mode("append").parquet(self.path)


@pytest.fixture
def landing(spark, tmp_path):
    return Landing(spark, str(tmp_path / "landing"))


def run(spark, landing, tmp_path, known=None, then=None):
    stream = living_review.read_stream(spark, landing.path, SCHEMA)
    q = review_stream.review(stream, str(tmp_path / "target"), str(tmp_path / "ck"), lookback_days=30, known=known, then=then)
    q.awaitTermination(300)
    if q.exception():
        raise RuntimeError(str(q.exception()))
    rows = review_stream.reviewed(str(tmp_path / "target"), spark.createDataFrame([], SCHEMA)).collect()
    return sorted(((r["external_id"], r["source"]) for r in rows), key=str), rows


def test_late_repeated_and_restarted(spark, landing, tmp_path):
    known = spark.createDataFrame([("0", "pubmed"), ("0", "pubmed")], "external_id string, source string")
    landing.add(("0", "pubmed", 1), ("1", "pubmed", 3), ("1", "pubmed", 2), ("2", "doaj", 0), ("9", "doaj", 400), (None, "doaj", 0))
    inputs = []

    def then(rows, epoch):
        inputs.append((epoch, rows.count()))

    have, rows = run(spark, landing, tmp_path, known, then)
    assert have == [("1", "pubmed"), ("2", "doaj")] and inputs[0][1] == 2
    assert {r["external_id"]: (r["entered"] - max(x["entered"] for x in rows)).days for r in rows} == {"1": -3, "2": 0}
    landing.add(("1", "pubmed", 0), ("1", "doaj", 0), ("3", "doaj", 29), ("2", "doaj", 5), ("0", "pubmed", 0), ("4", None, 1))
    have, _ = run(spark, landing, tmp_path, known, then)  # another query from the same checkpoint: late 3 comes in, repeated ones don't
    assert set(have) == {("1", "pubmed"), ("2", "doaj"), ("1", "doaj"), ("3", "doaj"), ("4", None)} and len(have) == 5


def test_a_batch_that_failed_runs_again_whole(spark, landing, tmp_path):
    def fails(rows, epoch):
        raise ValueError("after the rows were written")

    landing.add(("1", "a", 0), ("2", "a", 0))
    with pytest.raises(Exception, match="after the rows were written"):
        run(spark, landing, tmp_path, then=fails)
    landing.add(("2", "a", 0), ("3", "a", 0))
    assert run(spark, landing, tmp_path)[0] == [("1", "a"), ("2", "a"), ("3", "a")]


def test_no_batch_reads_the_target(spark, landing, tmp_path):
    """Folders of earlier epochs can even be gone."""
    import shutil

    landing.add(("1", "a", 0))
    run(spark, landing, tmp_path)
    shutil.rmtree(tmp_path / "target" / "epoch=0")
    landing.add(("1", "a", 0), ("2", "a", 0))
    assert run(spark, landing, tmp_path)[0] == [("2", "a")]


def test_python_gets_buckets_of_keys(spark, landing, tmp_path, monkeypatch):
    """Python was called for each key, known ones too."""
    monkeypatch.setattr(review_stream, "BUCKETS", 3)
    known = spark.range(1000).selectExpr("string(id % 500) AS external_id", "'a' AS source")
    landing.add(*[(str(i), "a", d) for i in range(490, 520) for d in (2, 5, 3)], ("x", None, 1), ("x", "", 1))
    q = review_stream.review(living_review.read_stream(spark, landing.path, SCHEMA), str(tmp_path / "target"), str(tmp_path / "ck"), known=known)
    q.awaitTermination(300)
    (state,) = q.lastProgress["stateOperators"]
    assert state["customMetrics"]["numMapStateVars"] > 0 and state["numRowsTotal"] == 522
    rows = review_stream.reviewed(str(tmp_path / "target"), spark.createDataFrame([], SCHEMA)).withColumn("days", F.date_diff(F.current_date(), "entered")).collect()
    want = [(str(i), "a", 5) for i in range(500, 520)] + [("x", "", 1), ("x", None, 1)]
    assert sorted(((r["external_id"], r["source"], r["days"]) for r in rows), key=str) == sorted(want, key=str)


def test_query_lands_in_three_batches_of_many_files(spark, monkeypatch):
    """A batch was one file, written by one task."""
    from pathlib import Path

    from quernstone.plans import registry

    checks, queries, review = Path(spark.conf.get("spark.checkpoint.dir")), [], review_stream.review

    def kept(*args, **options):
        queries.append(review(*args, **options))
        return queries[-1]

    monkeypatch.setattr(review_stream, "review", kept)
    before = set(checks.glob("landing-*"))
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        registry.QUERIES["living_review_stream"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    (new,) = set(checks.glob("landing-*")) - before
    assert len(list(new.glob("*.parquet"))) == 12 and [p["batchId"] for p in queries[0].recentProgress] == [0, 1, 2]
