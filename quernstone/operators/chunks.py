"""Building chunks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def structured(df: DataFrame, id_: str = "id", title: str = "title", abstract: str = "abstract", sections: str | None = "sections") -> DataFrame:
    """Title chunk and labelled abstract sections (array<struct<label, text>>), or the whole abstract, with offsets and weights."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    parts = F.filter(F.transform(F.coalesce(F.col(sections), F.array().cast("array<struct<label:string,text:string>>")), lambda s: F.struct(s["label"].alias("label"), clean(s["text"]).alias("text"))), lambda s: s["text"] != "") if sections else F.array().cast("array<struct<label:string,text:string>>")
    chunk = lambda kind, label, content, start, level: F.struct(
        kind.alias("chunk_type"), label.alias("section_label"), content.alias("content"), start.cast("int").alias("char_start"),
        (start + F.length(content)).cast("int").alias("char_end"), level.alias("source_level"),
    )
    begins = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_s"), F.lit(1))), lambda i: F.aggregate(F.slice("_s", 1, i - 1), F.lit(0), lambda n, s: n + F.length(s["text"]) + 1))
    labelled = F.transform("_s", lambda s, i: chunk(T.section_type(s["label"]), F.coalesce(s["label"], T.section_type(s["label"])), s["text"], F.get(F.col("_b"), i), F.lit("abstract_section")))
    none = F.filter(labelled, lambda s: F.lit(False))
    whole = F.array(chunk(F.lit("abstract_full"), F.lit("abstract"), clean(F.col(abstract)), F.lit(0), F.lit("abstract_full")))
    head = F.array(chunk(F.lit("title"), F.lit("title"), clean(F.col(title)), F.lit(0), F.lit("document")))
    body = F.when(F.size("_s") > 0, labelled).when(clean(F.col(abstract)) != "", whole).otherwise(none)
    rows = df.withColumn("_s", parts).withColumn("_b", begins)
    rows = rows.select(F.col(id_), F.posexplode(F.concat(F.when(clean(F.col(title)) != "", head).otherwise(none), body)).alias("chunk_index", "c"), T.document_tags(F.concat_ws("\n", title, abstract)).alias("tags"))
    rows = rows.select(id_, "chunk_index", "c.*", "tags")
    return rows.withColumn("token_count", T.token_count(F.col("content"))).withColumn("chunk_weight", T.chunk_weight(F.col("chunk_type"), F.col("content")))


def title_abstract(title: Column, abstract: Column) -> Column:
    return F.concat_ws("\n\n", F.when(F.trim(title) != "", F.trim(title)), F.when(F.trim(abstract) != "", F.trim(abstract)))


def paragraphs(text: Column, size: int = 3000, overlap: int = 300, least: int = 100) -> Column:
    """Chunks of whole paragraphs up to ``size`` characters; a chunk starts with the last paragraphs of the one before, up to ``overlap``.

    Longer paragraphs are cut at the last sentence end that fits, or else at ``size``; chunks of ``least`` characters or fewer go.
    """
    gap = "\n\n"
    trimmed = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    fitting = rf"(?s)\S.{{0,{size - 1}}}(?:\z|(?<=[.!?])(?=\s))|\S.{{0,{size - 1}}}"
    cut = lambda p: F.transform(F.regexp_extract_all(p, F.lit(fitting), F.lit(0)), trimmed)
    pieces = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: cut(trimmed(p))))
    joined = lambda parts: F.array_join(parts, gap)
    fits = lambda parts: F.length(joined(parts)) <= size

    def repeated(held: Column, piece: Column) -> Column:
        """The longest end of a chunk that the next one repeats, then its first piece."""
        ends = F.transform(held, lambda _, i: F.slice(held, i + 1, F.size(held)))
        end = F.get(F.filter(ends, lambda e: F.length(F.array_join(e, "")) <= overlap), F.lit(0))
        both = F.concat(F.coalesce(end, F.array().cast("array<string>")), F.array(piece))
        return F.when(fits(both), both).otherwise(F.array(piece))

    def step(chunk: Column, piece: Column) -> Column:
        longer = F.concat(chunk["held"], F.array(piece))
        closed = F.struct(F.concat(chunk["done"], F.array(joined(chunk["held"]))).alias("done"), repeated(chunk["held"], piece).alias("held"))
        return F.when(fits(longer), F.struct(chunk["done"].alias("done"), longer.alias("held"))).otherwise(closed)

    none = F.array().cast("array<string>")
    chunked = F.aggregate(pieces, F.struct(none.alias("done"), none.alias("held")), step, lambda c: F.concat(c["done"], F.array(joined(c["held"]))))
    return F.filter(chunked, lambda c: F.length(c) > least)
