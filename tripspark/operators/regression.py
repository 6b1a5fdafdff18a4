"""Least squares without fixed effects: robust errors, ridge with leave-one-out choice, rank correlation.

Spark sums cross products; only matrices of regressor size reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions import tails


def cross_products(df: DataFrame, cols: Sequence[str], weight: Column | None = None) -> tuple[np.ndarray, float, int]:
    """Matrix of Σ w c_i c_j, Σ w and the number of rows."""
    w = F.lit(1.0) if weight is None else weight
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(
        F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"), *[F.sum(w * F.col(cols[i]) * F.col(cols[j])).alias(f"s_{i}_{j}") for i, j in pairs]
    ).first()
    s = np.zeros((k, k))
    for i, j in pairs:
        s[i, j] = s[j, i] = row[f"s_{i}_{j}"] or 0.0
    return s, float(row["w"] or 0.0), row["n"]


def linear(terms: Sequence[str], coefs: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for t, c in zip(terms, coefs, strict=True):
        out = out + F.col(t) * F.lit(float(c))
    return out


def wls_hc1(df: DataFrame, y: str, xs: Sequence[str], w: str | None = None) -> DataFrame:
    """Weighted least squares with HC1 errors: one row per term, the constant included."""
    spark = df.sparkSession
    names = ["_const", *xs]
    weight = F.lit(1.0) if w is None else F.col(w).cast("double")
    data = df.dropna(subset=[y, *xs]).select(
        F.lit(1.0).alias("_const"), *[F.col(x).cast("double").alias(x) for x in xs], F.col(y).cast("double").alias("_y"), weight.alias("_w")
    )
    s, sw, n = cross_products(data, [*names, "_y"], F.col("_w"))
    k = len(names)
    schema = "term string, coef double, se double, p double, r2 double, n long"
    if n <= k:
        return spark.createDataFrame([], schema)
    inv = np.linalg.pinv(s[:k, :k], hermitian=True)
    b = inv @ s[:k, k]
    e = F.col("_y") - linear(names, b)
    meat, _, _ = cross_products(data, names, F.col("_w") * F.col("_w") * e * e)
    v = n / (n - k) * inv @ meat @ inv
    mean_y = s[0, k] / sw
    total = s[k, k] - sw * mean_y**2
    r2 = 1 - (s[k, k] - b @ s[:k, k]) / total if total > 0 else None
    rows = []
    for i, name in enumerate(names):
        se = float(np.sqrt(max(v[i, i], 0.0)))
        p = 2 * tails.normal_sf(abs(b[i] / se)) if se > 0 else None
        rows.append(("const" if name == "_const" else name, float(b[i]), se, p, None if r2 is None else float(r2), n))
    return spark.createDataFrame(rows, schema)


def average_rank(column: str, by: Sequence[str] = ()) -> Column:
    """Rank with ties averaged."""
    part = Window.partitionBy(*by)
    return F.rank().over(part.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, column)) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Rank correlation per group of a unit-level table."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_rx": average_rank(x, by), "_ry": average_rank(y, by)})
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("spearman_rho"), F.count(F.lit(1)).alias("n"))


@dataclass
class Ridge:
    """A fitted ridge model; ``predict`` is a Column."""

    xs: list[str]
    b: np.ndarray
    intercept: float
    alpha: float

    def predict(self) -> Column:
        return F.lit(self.intercept) + linear(self.xs, self.b)


ALPHAS = tuple(float(a) for a in np.logspace(-3, 3, 13))


def ridge_loo(df: DataFrame, y: str, xs: Sequence[str], alphas: Sequence[float] = ALPHAS) -> Ridge:
    """Ridge with the penalty of the smallest leave-one-out error.

    In the eigenbasis of the centred cross products, leverage and fit of every penalty are sums over
    the same rotated columns, so one more pass over the rows scores all penalties exactly.
    """
    names = ["_one", *xs, "_y"]
    data = df.select(F.lit(1.0).alias("_one"), *[F.col(x).cast("double").alias(x) for x in xs], F.col(y).cast("double").alias("_y"))
    s, n, _ = cross_products(data, names)
    mean = s[0, 1:] / n
    centred = s[1:, 1:] - n * np.outer(mean, mean)
    k = len(xs)
    lam, vec = np.linalg.eigh(centred[:k, :k])
    lam = np.maximum(lam, 0.0)
    proj = vec.T @ centred[:k, k]
    z = [f"_z{i}" for i in range(k)]
    rotated = data.select(
        (F.col("_y") - float(mean[k])).alias("_y"), *[(linear(list(xs), vec[:, i]) - float(mean[:k] @ vec[:, i])).alias(z[i]) for i in range(k)]
    )
    scores = []
    for a in alphas:
        fit = linear(z, proj / (lam + a))
        lever = F.lit(1.0 / n)
        for i in range(k):
            lever = lever + F.col(z[i]) * F.col(z[i]) * float(1.0 / (lam[i] + a))
        scores.append(F.avg(F.pow((F.col("_y") - fit) / (1.0 - lever), F.lit(2.0))))
    errors = [float(v) for v in rotated.agg(*[e.alias(f"a{i}") for i, e in enumerate(scores)]).first()]
    best = float(alphas[int(np.argmin(errors))])
    b = vec @ (proj / (lam + best))
    return Ridge(list(xs), b, float(mean[k] - mean[:k] @ b), best)
