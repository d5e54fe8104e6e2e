import json

from quernstone.sources import literature, paged


def test_pages_as_rows(spark):
    def fetch(key, cursor):
        """Three pages of one record each; "broken" fails on its second page, "forever" has no last page, "loop" repeats a cursor."""
        page = int(cursor or 0)
        if key == "broken" and page == 1:
            raise OSError("503")
        if key == "loop":
            return "{}", "7"
        payload = json.dumps({"data": [{"paperId": f"{key}-{page}", "title": f"title {page}", "year": 2020 + page}]})
        return payload, None if key != "forever" and page == 2 else str(page + 1)

    paged.register(spark, "service_a", fetch)
    df = spark.read.format("service_a").option("keys", "one\ntwo\nbroken\nforever\nloop\none").option("most", 4).option("wait", 0).load()
    assert df.rdd.getNumPartitions() == 5
    rows = df.collect()
    df = spark.createDataFrame(rows, paged.SCHEMA)
    pages = {k: sorted((r["page"], r["error"]) for r in rows if r["key"] == k) for k in ("one", "two", "broken", "forever", "loop")}
    assert pages["one"] == pages["two"] == [(0, None), (1, None), (2, None)]
    assert pages["broken"] == [(0, None), (1, "OSError: 503")]
    assert pages["forever"] == [(0, None), (1, None), (2, None), (3, None), (4, "more than 4 pages")]
    assert [p for p, e in pages["loop"]] == [0, 1, 2] and pages["loop"][-1][1] == "cursor 7 came twice"
    assert {(r["key"], r["page"]) for r in paged.failures(df).collect()} == {("broken", 1), ("forever", 4), ("loop", 2)}
    assert spark.read.format("service_a").load().count() == 0
    found = literature.semantic_scholar(df.filter("error is null and key in ('one', 'two')")).collect()
    assert {r["external_id"] for r in found} == {f"s2:{k}-{p}" for k in ("one", "two") for p in range(3)}


def test_only_failed_keys_are_fetched_again(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def counted(key, cursor):
        n = len(list(log.glob(f"{key}-*")))
        (log / f"{key}-{n}").touch()
        if key == "bad" and n < 1:
            raise ValueError("not yet")
        return "{}", None

    paged.register(spark, "service_b", counted)
    path = str(tmp_path / "landed")
    first = paged.landed(spark, "service_b", ["good", "bad"], path, tries=1, wait=0)
    assert {(r["key"], r["error"]) for r in first.collect()} == {("good", None), ("bad", "ValueError: not yet")}
    calls = len(list(log.iterdir()))
    second = paged.landed(spark, "service_b", ["good", "bad"], path, tries=1, wait=0)
    assert len(list(log.iterdir())) == calls + 1 and paged.failures(second).count() == 0 and second.count() == 2
    assert paged.landed(spark, "service_b", ["good", "bad"], path).count() == 2 and len(list(log.iterdir())) == calls + 1
