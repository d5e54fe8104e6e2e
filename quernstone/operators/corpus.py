"""Statistics of corpora, memberships and screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def membership_diff(a: DataFrame, b: DataFrame, group: str, item: str) -> DataFrame:
    """By group: items in a, in b, in both, lost, gained, and whether the group was emptied."""
    left, right = (d.select(group, item).distinct().withColumn(n, F.lit(True)) for d, n in ((a, "_a"), (b, "_b")))
    both = left.join(right, [group, item], "full_outer")
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    out = both.groupBy(group).agg(
        F.count_if(in_a).alias("n_a"), F.count_if(in_b).alias("n_b"), F.count_if(in_a & in_b).alias("n_both"),
        F.count_if(in_a & ~in_b).alias("n_lost"), F.count_if(~in_a & in_b).alias("n_gained"),
    )
    return out.withColumn("emptied", (F.col("n_a") > 0) & (F.col("n_b") == 0))


def prisma_funnel(df: DataFrame, score: Column, threshold: float, fulltext: Column, decision: Column, group: list[str] | None = None) -> DataFrame:
    """One pass over the review funnel; rescued: included below the threshold, vetoed: excluded above it."""
    above = F.coalesce(score >= threshold, F.lit(False))
    included, excluded = decision.eqNullSafe(F.lit("included")), decision.eqNullSafe(F.lit("excluded"))
    return df.groupBy(*(group or [])).agg(
        F.count("*").alias("identified"), F.count_if(above).alias("above_threshold"), F.count_if(~above).alias("below_threshold"),
        F.count_if(above & fulltext).alias("with_fulltext"), F.count_if(included).alias("included"), F.count_if(excluded).alias("excluded"),
        F.count_if(included & ~above).alias("rescued"), F.count_if(excluded & above).alias("vetoed"),
        F.count_if(included | above & ~excluded).alias("evidence"),
    )


def screening_progress(df: DataFrame, decision: Column, group: list[str] | None = None) -> DataFrame:
    done = decision.isin("included", "excluded", "maybe")
    out = df.groupBy(*(group or [])).agg(
        F.count("*").alias("total"), F.count_if(done).alias("screened"), *[F.count_if(decision == d).alias(d) for d in ("included", "excluded", "maybe")]
    )
    return out.withColumn("pct", F.round(100.0 * F.col("screened") / F.col("total"), 1))


def agreement_matrix(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.groupBy(F.col(first).alias("first"), F.col(second).alias("second")).agg(F.count("*").alias("n"))


def cohen_kappa(df: DataFrame, first: str, second: str, pending: str | None = "pending") -> DataFrame:
    """One row: n, agreements, conflicts, po, pe, kappa and its reading; pending pairs count only if ``pending`` is None."""
    rows = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    if pending is not None:
        rows = rows.filter((F.col(first).cast("string") != pending) & (F.col(second).cast("string") != pending))
    cells = agreement_matrix(rows, first, second)
    total = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("first") == F.col("second"), F.col("n"))), F.lit(0)).alias("agreements"))
    margins = cells.groupBy("first").agg(F.sum("n").alias("a")).join(cells.groupBy(F.col("second").alias("first")).agg(F.sum("n").alias("b")), "first")
    out = total.crossJoin(margins.agg(F.coalesce(F.sum(F.col("a").cast("double") * F.col("b")), F.lit(0.0)).alias("ab")))  # one row each
    out = out.withColumn("po", F.col("agreements") / F.col("n")).withColumn("pe", F.col("ab") / (F.col("n").cast("double") * F.col("n")))
    kappa = F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).when(F.col("n") > 0, 1.0)
    out = out.withColumn("kappa", kappa)
    reading = F.when(F.col("kappa") >= 0.61, "substantial").when(F.col("kappa") >= 0.41, "moderate").otherwise("weak")
    return out.select("n", "agreements", (F.col("n") - F.col("agreements")).alias("conflicts"), "po", "pe", "kappa", reading.alias("reading"))


def heatmap(df: DataFrame, a: str, b: str, fulltext: Column) -> DataFrame:
    """Totals and full texts by a and b, by each alone and over all, in one aggregation."""
    return df.groupingSets([[F.col(a), F.col(b)], [F.col(a)], [F.col(b)], []], F.col(a), F.col(b)).agg(
        F.count("*").alias("total"), F.count_if(fulltext).alias("fulltext"), F.grouping_id().cast("int").alias("level")
    )


def coverage(df: DataFrame, flags: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """Rows, and how many and what share of them each flag marks."""
    out = df.groupBy(*(group or [])).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    for n in flags:
        out = out.withColumn(f"{n}_pct", F.round(100.0 * F.col(n) / F.col("total"), 1))
    return out


def options(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values (field, value) of each column, blanks left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return df.select(pairs).select("x.*").filter(F.trim("value") != "").distinct()


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("null_share")) for c in columns])).alias("x")).select("x.*")


def evidence_summary(df: DataFrame, year: str, citations: str, flags: dict[str, Column]) -> DataFrame:
    return df.agg(
        F.count("*").alias("n"), F.min(year).alias("year_min"), F.max(year).alias("year_max"), F.round(F.avg(citations), 2).alias("citations_avg"),
        F.max(citations).alias("citations_max"), *[F.count_if(c).alias(n) for n, c in flags.items()],
    )


def top_articles(df: DataFrame, order: list[Column], k: int, columns: list[str], text: str, pico: str | None = None, excerpt: int = 300) -> DataFrame:
    """The first k articles of a brief with their place, an excerpt of the abstract (blanks squeezed, cut with …) and, of a PICO record, its four main fields.

    Give an order that ends with a unique column.  Broken records have null fields; a null abstract has an empty excerpt.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    short = F.when(F.length(plain) > excerpt, F.concat(F.rtrim(F.substring(plain, 1, excerpt)), F.lit("…"))).otherwise(plain)
    best = df.orderBy(*order).limit(k)
    place = F.row_number().over(W.orderBy(*order))  # k rows
    out = best.withColumns({"place": place, "excerpt": short})
    if pico is None:
        return out.select("place", *columns, "excerpt")
    record = F.from_json(F.col(pico), "population string, intervention string, outcome string, key_finding string")
    return out.select("place", *columns, "excerpt", record.alias("pico_summary"))
