"""Synthetic control: simplex weights of donor series.

Each target (the treated unit, and every placebo) is a task of its own that holds the series of its donors, units
times periods, and solves by accelerated projected gradients on them; no matrix of units by units is formed and no
series pass through the driver. A solve ends when its duality gap is small, and raises if it does not become so.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 1e-9  # of the objective at the start
MAX_STEPS = 200_000


def onto_simplex(v: np.ndarray) -> np.ndarray:
    """The closest point with nonnegative entries that sum to one."""
    u = np.sort(v)[::-1]
    excess = (np.cumsum(u) - 1.0) / np.arange(1, len(u) + 1)
    last = np.flatnonzero(u > excess)[-1]
    return np.maximum(v - excess[last], 0.0)


def simplex_weights(x: np.ndarray, y: np.ndarray, gap: float = GAP, max_steps: int = MAX_STEPS) -> np.ndarray:
    """Minimise |xw - y|² / 2 over the simplex (one column of ``x`` per donor), with restarts of the momentum."""
    n = x.shape[1]
    step = 1.0 / max(np.linalg.norm(x, 2) ** 2, 1e-300)
    w = ahead = np.full(n, 1.0 / n)
    size = max(float((x @ w - y) @ (x @ w - y)), float(y @ y) * 1e-6, 1e-300)
    t = 1.0
    for k in range(max_steps):
        new = onto_simplex(ahead - step * (x.T @ (x @ ahead - y)))
        if (ahead - new) @ (new - w) > 0:
            t = 1.0
        t_new = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        ahead = new + (t - 1.0) / t_new * (new - w)
        w, t = new, t_new
        if k % 10 == 9 or n == 1:
            slope = x.T @ (x @ w - y)
            if slope @ w - slope.min() <= gap * size:
                return w
    raise RuntimeError(f"donor weights have not converged after {max_steps} steps")


def index_series(panel: DataFrame, unit: str = "zone", period: str = "wk", value: str = "n") -> DataFrame:
    """Unit series divided by their pre-period mean, plus the sum of treated units as unit ``-1``: (u, period, post, y)."""
    rows = panel.select(F.when(F.col("treat") == 1, F.lit(-1)).otherwise(F.col(unit)).alias("u"), period, "post", value)
    sums = rows.groupBy("u", period, "post").agg(F.sum(value).cast("double").alias("v"))
    base = sums.where("post = 0").groupBy("u").agg(F.avg("v").alias("base"))
    return sums.join(base, "u").select("u", period, "post", F.try_divide("v", "base").alias("y"))


def weights_for(series: DataFrame, targets: DataFrame, period: str, demean: bool) -> DataFrame:
    """Donor weights for each target unit: (target, u, weight). Treated (-1) is never a donor.

    Only units with a value in every period before the policy take part. The targets are the treated unit and a
    chosen number of placebos, so their ids may be listed; a task holds the donors' series of one target.
    """
    pre = series.where("post = 0 AND y IS NOT NULL")
    whole = pre.groupBy("u").agg(F.array_sort(F.collect_list(F.struct(period, "y"))).alias("s"))
    length = whole.agg(F.max(F.size("s"))).scalar()
    arrays = whole.where(F.size("s") == length).select(F.col("u").cast("long").alias("u"), F.transform("s", lambda e: e["y"]).alias("x"))
    ids = sorted({int(r.u) for r in targets.select("u").collect()})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u")
        target = int(pdf["target"].iloc[0])
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        if demean:
            x = x - x.mean(axis=1, keepdims=True)
        own, donors = (pdf["u"] == target).to_numpy(), (~pdf["u"].isin([-1, target])).to_numpy()
        if not own.any() or not donors.any():
            return pd.DataFrame({"target": [], "u": [], "weight": []})
        return pd.DataFrame({"target": target, "u": pdf["u"].to_numpy()[donors], "weight": simplex_weights(x[donors].T, x[own][0])})

    offered = arrays.withColumn("target", F.explode(F.array(*[F.lit(i).cast("long") for i in ids]).cast("array<bigint>")))
    return offered.groupBy("target").applyInPandas(solve, "target long, u long, weight double")


def synthetic_series(series: DataFrame, weights: DataFrame, period: str, demean: bool) -> DataFrame:
    """Observed and synthetic series per target: (target, period, post, y, synth)."""
    donors = series.select("u", period, F.col("y").alias("yd"))
    synth = weights.where("weight > 0").join(donors, "u").groupBy("target", period).agg(F.sum(F.col("weight") * F.col("yd")).alias("synth"))
    own = series.select(F.col("u").cast("long").alias("target"), period, "post", "y")
    out = own.join(synth, ["target", period])
    if demean:
        level = out.where("post = 0").groupBy("target").agg(F.avg(F.col("y") - F.col("synth")).alias("lvl"))
        out = out.join(level, "target").withColumn("synth", F.col("synth") + F.col("lvl")).drop("lvl")
    return out


def fit_summary(series: DataFrame) -> DataFrame:
    """Root mean squared gap before and after, their ratio, mean gap and mean percent effect per target."""
    gap = F.col("y") - F.col("synth")

    def rms(post: int):
        return F.sqrt(F.avg(F.when(F.col("post") == post, gap * gap)))

    s = series.groupBy("target").agg(
        rms(0).alias("rmspe_pre"),
        rms(1).alias("rmspe_post"),
        F.avg(F.when(F.col("post") == 1, gap)).alias("avg_gap_post"),
        (100.0 * F.avg(F.when(F.col("post") == 1, F.try_divide("y", "synth") - 1.0))).alias("avg_pct_effect_post"),
    )
    return s.withColumn("ratio", F.try_divide("rmspe_post", "rmspe_pre"))


def placebo_p(summary: DataFrame) -> DataFrame:
    """Rank p-values of the treated unit among the placebos."""
    own = summary.where("target = -1").agg(F.struct(F.max("ratio").alias("r"), F.max(F.abs("avg_gap_post")).alias("g")).alias("own")).scalar()
    n = F.count(F.lit(1))
    return summary.where("target <> -1").agg(
        n.alias("placebo_n"),
        ((1 + F.sum((F.col("ratio") >= own["r"]).cast("int"))) / (1 + n)).alias("placebo_rank_p"),
        ((1 + F.sum((F.abs("avg_gap_post") >= own["g"]).cast("int"))) / (1 + n)).alias("placebo_gap_p"),
    )
