from pathlib import Path

from pyspark.sql import functions as F

from quernstone.operators import partitions


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def chunks(spark, rows):
    return spark.createDataFrame(rows, "document_id long, chunk_type string, content string")


def plain(df):
    return sorted(map(tuple, df.collect()))


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    rows = [(i, k, f"{k} {i}") for i in range(60) for k in ("title_abstract", "fulltext_section")]
    table, path = chunks(spark, rows), str(tmp_path / "t")
    partitions.write(table, path, "document_id", 16)
    before = files(path)
    fresh = chunks(spark, [(7, "fulltext_section", "new"), (7, "fulltext_section", "newer"), (100, "fulltext_section", "first")])
    touched = partitions.replace_chunks(fresh, path, 16)
    want = [r for r in rows if r[0] != 7 or r[1] != "fulltext_section"] + [(7, "fulltext_section", "new"), (7, "fulltext_section", "newer"), (100, "fulltext_section", "first")]
    assert plain(partitions.read(table, path)) == sorted(want)
    kept = {f for f in before if int(f.split("=")[1].split("/")[0]) not in touched}
    assert kept and kept < files(path) and not (before - kept) & files(path)
    partitions.replace_chunks(fresh, path, 16)  # run again
    assert plain(partitions.read(table, path)) == sorted(want) and kept < files(path)
    assert not list(tmp_path.glob("*staged*"))


def test_insert_update_and_emptied_partition(spark, tmp_path):
    table, path = chunks(spark, [(1, "a", "x"), (2, "a", "y")]), str(tmp_path / "t")
    partitions.write(table, path, "document_id", 64)
    partitions.insert(chunks(spark, [(2, "a", "again"), (3, "a", "z"), (3, "a", "z")]), path, 64, "document_id", ["document_id", "chunk_type"])
    assert plain(partitions.read(table, path)) == [(1, "a", "x"), (2, "a", "y"), (3, "a", "z")]
    source = spark.createDataFrame([(1, "w"), (9, "none")], "document_id long, content string")
    partitions.update(source, path, 64, "document_id", ["content"], table)
    assert plain(partitions.read(table, path)) == [(1, "a", "w"), (2, "a", "y"), (3, "a", "z")]
    gone = chunks(spark, [(2, "a", "")])
    partitions.repair(gone, path, "document_id", 64, lambda rows, new: rows.join(new.select("document_id"), "document_id", "left_anti"))
    assert plain(partitions.read(table, path)) == [(1, "a", "w"), (3, "a", "z")]
    assert partitions.repair(gone.limit(0), path, "document_id", 64, lambda rows, new: rows) == []
    assert plain(partitions.read(table, path).filter(F.col("document_id") == 3)) == [(3, "a", "z")]
