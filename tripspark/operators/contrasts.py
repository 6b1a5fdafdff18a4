"""Difference-in-differences on balanced panels, one shuffle per estimate.

On a balanced panel every coefficient of "treated × function of time" equals the difference between
the mean contrast of treated units and that of control units, where a unit's contrast is a fixed
weighted sum of its own outcomes over time. The clustered variance is a sum of squared cluster
influences. So the data-sized work is one join with a small table of time weights and one groupBy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripspark.functions import tails
from tripspark.functions.exprs import ratio


def periods_of(panel: DataFrame, columns: Sequence[str]) -> list[tuple]:
    """The distinct periods with their attributes: one row per calendar period, so small by nature."""
    return [tuple(r) for r in panel.select(*columns).distinct().orderBy(columns[0]).collect()]


def weights_frame(spark: SparkSession, period: str, period_type: T.DataType, terms: dict[str, dict]) -> DataFrame:
    """Time weights (term, period, a) from {term: {period: weight}}; zero weights are left out."""
    rows = [(term, p, float(a)) for term, by in terms.items() for p, a in by.items() if a != 0.0]
    schema = T.StructType(
        [T.StructField("term", T.StringType()), T.StructField(period, period_type), T.StructField("a", T.DoubleType())]
    )
    return spark.createDataFrame(rows, schema)


def projection_weights(basis: np.ndarray, nuisance: np.ndarray | None = None) -> np.ndarray:
    """Weights over time that give the least-squares coefficients of ``basis`` next to ``nuisance`` and a constant."""
    n = basis.shape[0]
    base = np.ones((n, 1)) if nuisance is None else np.column_stack([np.ones(n), nuisance])
    rest = basis - base @ (np.linalg.pinv(base) @ basis)
    weights = np.linalg.pinv(rest)
    weights[np.abs(weights) < 1e-14] = 0.0
    return weights


def post_weights(periods: list[tuple], spec: str = "twfe") -> dict[str, dict]:
    """Weights of the policy effect for rows (period, post, k, woy): plain, seasonal or with a group trend."""
    post = np.array([r[1] for r in periods], dtype=float)[:, None]
    if spec == "twfe":
        w = projection_weights(post)[0]
    elif spec == "trend":
        k = np.array([r[2] for r in periods], dtype=float)[:, None] / 52.0
        w = projection_weights(np.hstack([post, k]))[0]
    elif spec == "seasonal":
        woy = np.array([r[3] for r in periods])
        w = projection_weights(post, (woy[:, None] == np.unique(woy)[None, :]).astype(float))[0]
    else:
        raise ValueError(f"unknown specification {spec!r}")
    return {"D": {r[0]: a for r, a in zip(periods, w, strict=True)}}


def event_weights(periods: list[tuple], ref: int = -1, centred: bool = False) -> dict[str, dict]:
    """Weights of the dynamic effects for rows (period, relative time).

    Relative to period ``ref``, or with ``centred`` to the mean of all periods before the policy.
    """
    pre = [p for p, k in periods if k < 0]
    base = {p: 1.0 / len(pre) for p in pre} if centred else {p: 1.0 for p, k in periods if k == ref}
    out: dict[str, dict] = {}
    for p, k in periods:
        if k == ref:
            continue
        w = {q: -a for q, a in base.items()}
        w[p] = w.get(p, 0.0) + 1.0
        out[str(k)] = w
    return out


def unit_contrasts(
    panel: DataFrame, unit: str, period: str, outcomes: Sequence[str], weights: DataFrame, keep: Sequence[str], n_periods: int
) -> DataFrame:
    """Weighted sums over time per unit: (unit, *keep, outcome, term, c), for units complete in the outcome."""
    keep = [k for k in keep if k != unit]
    values = F.inline(F.array(*[F.struct(F.lit(y).alias("outcome"), F.col(y).cast("double").alias("y")) for y in outcomes]))
    long = panel.select(unit, period, *keep, values).where(F.col("y").isNotNull())
    complete = long.groupBy(unit, "outcome").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n_periods).drop("_n")
    weighted = long.join(weights, period).groupBy(unit, *keep, "outcome", "term").agg(F.sum(F.col("a") * F.col("y")).alias("c"))
    return weighted.join(complete, [unit, "outcome"], "left_semi")


def influences(contrasts: DataFrame, by: Sequence[str], treat: str, cluster: str, weight: str | None = None) -> DataFrame:
    """Influence of each cluster on the difference in means: (*by, cluster, s), together with the coefficient."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = contrasts.select(*by, F.col(treat).alias("_t"), F.col(cluster).alias("cluster"), "c", w.alias("_w"))
    means = rows.groupBy(*by, "_t").agg(
        (F.sum(F.col("_w") * F.col("c")) / F.sum("_w")).alias("_m"), F.sum("_w").alias("_tot"), F.count(F.lit(1)).alias("_n")
    )
    sign = F.when(F.col("_t") == 1, 1.0).otherwise(-1.0)
    part = sign * F.col("_w") * (F.col("c") - F.col("_m")) / F.col("_tot")
    coef = means.groupBy(*by).agg(F.sum(sign * F.col("_m")).alias("coef"), F.sum("_n").alias("n_units"), F.count(F.lit(1)).alias("_g"))
    scores = rows.join(means, [*by, "_t"]).groupBy(*by, "cluster").agg(F.sum(part).alias("s"))
    # a coefficient needs both groups
    return scores.join(coef.where(F.col("_g") == 2).drop("_g"), list(by))


def clustered_adjustment(clusters: Column, n_obs: Column, k: int | Column, k_fe: Column) -> Column:
    """Small-sample factor G/(G-1) · (n-1)/(n-k-k_fe)."""
    k = F.lit(k) if isinstance(k, int) else k
    return ratio(clusters, clusters - 1) * (n_obs - 1) / F.greatest(n_obs - k - k_fe, F.lit(1))


def estimate(
    contrasts: DataFrame,
    by: Sequence[str],
    n_periods: int,
    k: int = 1,
    extra_levels: int = 0,
    treat: str = "treat",
    cluster: str = "zone",
    weight: str | None = None,
) -> DataFrame:
    """Coefficient and clustered standard error per ``by`` group.

    ``k`` is the number of regressors, ``extra_levels`` the fixed-effect levels beyond units and periods.
    """
    scores = influences(contrasts, by, treat, cluster, weight)
    out = scores.groupBy(*by, "coef", "n_units").agg(F.sum(F.col("s") * F.col("s")).alias("_v"), F.count(F.lit(1)).alias("n_clusters"))
    n_obs = F.col("n_units") * n_periods
    adj = clustered_adjustment(F.col("n_clusters"), n_obs, k, F.col("n_units") + n_periods - 1 + extra_levels)
    out = out.withColumns({"n_obs": n_obs, "se": F.sqrt(adj * F.col("_v"))})
    return out.withColumn("t", ratio("coef", "se")).select(*by, "coef", "se", "t", "n_obs", "n_clusters")


def with_p_values(estimates: DataFrame, t: str = "t", clusters: str = "n_clusters") -> DataFrame:
    """Two-sided p and 95 % interval from t(G-1). One row per estimate."""

    @F.pandas_udf("p double, crit double")
    def tail(tv, g):
        import pandas as pd

        p = [tails.t_two_sided(None if x is None or x != x else float(x), float(c) - 1) for x, c in zip(tv, g, strict=True)]
        crit = {c: tails.t_quantile(0.975, float(c) - 1) if c > 1 else None for c in set(g)}
        return pd.DataFrame({"p": p, "crit": [crit[c] for c in g]})

    out = estimates.withColumn("_t", tail(F.col(t).cast("double"), F.col(clusters).cast("double")))
    return out.select(
        *estimates.columns,
        F.col("_t.p").alias("p"),
        (F.col("coef") - F.col("_t.crit") * F.col("se")).alias("ci_low"),
        (F.col("coef") + F.col("_t.crit") * F.col("se")).alias("ci_high"),
    )


def covariance(contrasts: DataFrame, by: str, n_periods: int, k: int, treat: str = "treat", cluster: str = "zone") -> DataFrame:
    """Clustered covariance between all terms of one model: (by, a, b, v). Terms are periods, so few."""
    s = influences(contrasts, [by, "term"], treat, cluster)
    left = s.select(by, "cluster", F.col("term").alias("a"), F.col("s").alias("sa"), "n_units")
    right = s.select(by, "cluster", F.col("term").alias("b"), F.col("s").alias("sb"))
    out = left.join(right, [by, "cluster"]).groupBy(by, "a", "b", "n_units").agg(
        F.sum(F.col("sa") * F.col("sb")).alias("v"), F.countDistinct("cluster").alias("g")
    )
    n_obs = F.col("n_units") * n_periods
    adj = clustered_adjustment(F.col("g"), n_obs, k, F.col("n_units") + n_periods - 1)
    return out.select(by, "a", "b", (adj * F.col("v")).alias("v"), "g")


def wald(b: np.ndarray, v: np.ndarray) -> tuple[float, int, float]:
    """Wald statistic, rank and p-value of b = 0."""
    stat = float(b @ np.linalg.pinv(v, hermitian=True) @ b)
    rank = int(np.linalg.matrix_rank(v, hermitian=True))
    return stat, rank, tails.chi2_sf(stat, rank)
