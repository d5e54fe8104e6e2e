from pyspark.sql import functions as F

from quernstone.streaming import living_review as R


def test_increment_is_idempotent(spark, tmp_path):
    schema = "external_id string, source string, scenario_id string, entered date"
    row = lambda *v: spark.createDataFrame([v], "external_id string, source string, scenario_id string, entered string").select("external_id", "source", "scenario_id", F.to_date("entered").alias("entered"))
    now = spark.range(1).select(F.current_date().cast("string")).first()[0]
    target, landing = str(tmp_path / "target"), str(tmp_path / "landing")
    row("1", "pubmed", "s", now).write.parquet(target)
    row("1", "pubmed", "s", now).unionByName(row("2", "pubmed", "s", now)).unionByName(row("3", "pubmed", "s", "2000-01-01")).write.parquet(landing)
    for _ in range(2):
        q = R.ingest(R.read_stream(spark, landing, schema), target, str(tmp_path / f"ck{_}"))
        q.awaitTermination(120)
    assert sorted(r[0] for r in spark.read.parquet(target).select("external_id").collect()) == ["1", "2"]


def test_windows_on_a_stream(spark, tmp_path):
    spark.range(100).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int") * 5)).alias("ts"), F.lit("a").alias("k")).write.parquet(str(tmp_path / "e"))
    stream = R.read_stream(spark, str(tmp_path / "e"), "ts timestamp, k string")
    q = R.tumbling(stream, "ts", "1 hour", ["k"], [F.count("*").alias("n")], late="10 minutes").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sum(r["n"] for r in spark.sql("select n from hours").collect()) == 100


def test_report(spark):
    batch = spark.createDataFrame([("1", "s"), ("2", "s"), ("3", "t")], "external_id string, scenario_id string")
    assert sorted(map(tuple, R.report(batch, batch.filter("external_id = '2'")).collect())) == [("s", 2, 1, 1), ("t", 1, 0, 1)]
