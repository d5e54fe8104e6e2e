"""Data specifications: what a data set must hold, what changed between two of them, and invented rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGINS = ("user", "public", "seir")


def template(outcome: dict, variables: list[dict], task: str = "regression") -> list[dict]:
    """Columns of a data set, the outcome first; variables of high importance are required."""
    kind = {"regression": "double", "count": "long", "classification": "string"}.get(task, "double")
    first = {"name": outcome["machine_name"], "role": "outcome", "dtype": kind, "required": True, "origin": "user"}
    rest = [
        {"name": v["machine_name"], "role": "feature", "dtype": v.get("dtype", "double"), "required": v.get("importance") == "high", "origin": v.get("origin") if v.get("origin") in ORIGINS else "user"}
        for v in variables if v["machine_name"] != outcome["machine_name"]
    ]
    return [first, *rest]


def diff(before: list[dict], after: list[dict], key: str = "name") -> dict[str, list]:
    """Names added, removed and changed, with the fields that differ."""
    a, b = ({v[key]: v for v in vs} for vs in (before, after))
    changed = [{"name": n, "fields": sorted(f for f in {*a[n], *b[n]} if a[n].get(f) != b[n].get(f))} for n in a if n in b and a[n] != b[n]]
    return {"added": [n for n in b if n not in a], "removed": [n for n in a if n not in b], "changed": changed}


def synthetic(spark: SparkSession, spec: list[dict], rows: int, seed: int = 42) -> DataFrame:
    """Invented rows of a template: normal numbers, small counts, two classes; the outcome follows the numbers."""
    df = spark.range(rows).withColumnRenamed("id", "row_id")
    numbers = []
    for i, v in enumerate(v for v in spec if v["role"] == "feature"):
        if v["dtype"] == "string":
            value = F.when(F.rand(seed + i) < 0.5, "a").otherwise("b")
        elif v["dtype"] == "long":
            value = F.floor(-F.log(1 - F.rand(seed + i)) * 5).cast("long")
        else:
            value = F.randn(seed + i)
        df = df.withColumn(v["name"], value)
        if v["dtype"] != "string":
            numbers.append(v["name"])
    signal = sum((F.col(c) * (1.0 / (k + 1)) for k, c in enumerate(numbers)), F.lit(0.0)) + 0.3 * F.randn(seed + 1000)
    out = next(v for v in spec if v["role"] == "outcome")
    value = {"string": F.when(signal > 0, "yes").otherwise("no"), "long": F.greatest(F.lit(0), F.round(signal * 3 + 5)).cast("long")}.get(out["dtype"], signal)
    return df.withColumn(out["name"], value)


#: Parameters of an epidemic whose evidence can be pooled.
PARAMETERS = ("r0", "infectious_period_days", "incubation_period_days", "cfr", "immunity_duration_days", "vaccination_rate", "vaccine_efficacy", "quarantine_rate")


def epidemic_parameters(block: dict | None, pooled: dict[str, tuple[float, float, float, int]] | None = None) -> dict[str, dict]:
    """Usable values of a parameter block: finite, with intervals in order, fatality within 0 and 1; pooled ones of two studies or more win."""

    def number(x) -> float | None:
        try:
            v = float(x)
        except (TypeError, ValueError):
            return None
        return v if abs(v) < float("inf") else None

    out: dict[str, dict] = {}
    for name in PARAMETERS:
        given = (block or {}).get(name)
        given = given if isinstance(given, dict) else {"value": given}
        value, low, high = (number(given.get(k)) for k in ("value", "ci_low", "ci_high"))
        if pooled and name in pooled and pooled[name][3] >= 2:
            value, low, high = pooled[name][:3]
        if value is None:
            continue
        if low is None or high is None or not low <= value <= high:
            low = high = None
        if name == "cfr":
            value, low, high = (None if v is None else min(max(v, 0.0), 1.0) for v in (value, low, high))
        out[name] = {"value": value, "ci_low": low, "ci_high": high}
    return out
