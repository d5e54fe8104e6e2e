from quernstone.llm import lines, queries


def test_short_lines_are_copies_of_the_same_line_only(spark):
    rows = [(1, "17\n18\n \nyes\n}"), (2, "17\nyet\n\n  yes \n}\n}"), (3, "a line of twelve\na line of twelv"), (4, "eleven char\neleven chars")]
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "17\n18\n \nyes\n}", 2: "yet\n", 3: "a line of twelve", 4: "eleven char\neleven chars"}


def test_both_names_give_the_same(spark, folder):
    assert sorted(map(tuple, queries.op5_lines_all(spark, folder).collect())) == sorted(map(tuple, queries.op5_lines(spark, folder).collect()))
