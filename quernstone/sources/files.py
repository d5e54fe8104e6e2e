"""Files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the demonstration data set.
TRIAL = "date string, flu_a_load double, flu_b_load double, rsv_load double, sars_cov2_load double, season_sin double, season_cos double"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Columns as strings unless a schema is given; nothing is inferred by a second pass."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (payload, path)."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.input_file_name().alias("path"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested columns are written as JSON."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("struct", "array", "map")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).option("header", True).csv(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def export_model(variables: DataFrame, dataset: DataFrame, runs: DataFrame, path: str) -> None:
    """Three sheets as three CSV folders."""
    for name, df in (("variables", variables), ("dataset", dataset), ("model_runs", runs)):
        write_csv(df, f"{path}/{name}")
