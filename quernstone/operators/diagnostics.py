"""Diagnostics of regressions, from sums that Spark takes in one pass.

With k features, a pass gathers (k + 1)**2 sums; the small systems are solved on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _moments(df: DataFrame, columns: list[Column]) -> tuple[int, np.ndarray]:
    """Rows without nulls, and the matrix of mean products of (1, *columns)."""
    x = [F.lit(1.0), *[c.cast("double") for c in columns]]
    whole = df
    for c in columns:
        whole = whole.filter(c.isNotNull())
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = whole.agg(F.count("*"), *[F.avg(x[i] * x[j]) for i, j in pairs]).first()
    m = np.zeros((len(x), len(x)))
    for (i, j), v in zip(pairs, row[1:]):
        m[i, j] = m[j, i] = v if v is not None else 0.0
    return row[0], m


def vif(df: DataFrame, features: list[str], most: int = 10) -> list[tuple[str, float]]:
    """Variance inflation of each feature, largest first."""
    _, m = _moments(df, [F.col(f) for f in features])
    cov = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:])
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    inverse = np.linalg.pinv(cov / np.outer(sd, sd), hermitian=True)
    return sorted(zip(features, np.diag(inverse).tolist()), key=lambda x: (-x[1], x[0]))[:most]


def jarque_bera(df: DataFrame, residual: str) -> dict:
    """Statistic and p value of normality, by skewness and kurtosis; it stands for Shapiro-Wilk too."""
    row = df.agg(F.count(residual).alias("n"), F.skewness(residual).alias("s"), F.kurtosis(residual).alias("k")).first()
    if not row["n"] or row["s"] is None:
        return {"n": row["n"], "jb": None, "p": None, "method": "jarque_bera"}
    jb = row["n"] / 6 * (row["s"] ** 2 + row["k"] ** 2 / 4)
    return {"n": row["n"], "jb": jb, "p": math.exp(-jb / 2), "method": "jarque_bera"}


def white(df: DataFrame, residual: str, features: list[str]) -> dict:
    """Lagrange multiplier of White's test: n times R2 of squared residuals on features, squares and products."""
    x = [F.col(f) for f in features]
    terms = [*x, *[x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]]
    n, m = _moments(df, [*terms, F.col(residual) * F.col(residual)])
    cov = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:])
    a, b, total = cov[:-1, :-1], cov[:-1, -1], cov[-1, -1]
    r2 = float(b @ np.linalg.pinv(a, hermitian=True) @ b / total) if total > 0 else 0.0
    return {"n": n, "lm": n * min(max(r2, 0.0), 1.0), "df": int(np.linalg.matrix_rank(a))}
