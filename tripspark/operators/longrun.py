"""Seasonal event studies over a long pre-period, trend adjustment and sensitivity bounds.

With group × month-of-year effects and a full base year, the effect of month m is the treated–control
gap in m minus the gap in the same month of the base year. Every summary (placebo year, trend-adjusted
effect, bounds) is a linear combination of those effects, hence one more set of time weights.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.exprs import uniform01, webb_weight
from tripspark.operators.contrasts import influences, projection_weights


@dataclass(frozen=True)
class TrendSpec:
    """Base year, months of the year left out, years of the trend fit and its degree."""

    base: int = 2022
    drop: tuple[int, ...] = ()
    trend: tuple[int, int] | None = (2023, 2024)
    degree: int = 1


# The specifications compared in the sensitivity table.
SPECS = {
    "S1": TrendSpec(),
    "S2": TrendSpec(drop=(1, 2)),
    "S3": TrendSpec(base=2023, trend=(2024, 2024)),
    "S4": TrendSpec(degree=2),
    "S5": TrendSpec(trend=(2024, 2024)),
    "S6": TrendSpec(trend=None, degree=0),
}


def months_between(first: int, last: int) -> list[str]:
    return [f"{y}-{m:02d}" for y in range(first, last + 1) for m in range(1, 13)]


def year_of(ym: str) -> int:
    return int(ym[:4])


def month_of(ym: str) -> int:
    return int(ym[5:])


def event_months(months: Sequence[str], spec: TrendSpec) -> list[str]:
    return [m for m in months if year_of(m) > spec.base and month_of(m) not in spec.drop]


def sample_months(months: Sequence[str], spec: TrendSpec) -> list[str]:
    return [m for m in months if year_of(m) >= spec.base and month_of(m) not in spec.drop]


def on_calendar(effects: dict[str, float], spec: TrendSpec) -> dict[str, float]:
    """Weights on monthly effects, as weights on months: each effect subtracts its base-year month."""
    out: dict[str, float] = {}
    for m, a in effects.items():
        base = f"{spec.base}-{m[5:]}"
        out[m] = out.get(m, 0.0) + a
        out[base] = out.get(base, 0.0) - a
    return {m: a for m, a in out.items() if abs(a) > 1e-15}


def year_mean(ev: Sequence[str], year: int) -> np.ndarray:
    hit = np.array([year_of(m) == year for m in ev], dtype=float)
    return hit / max(hit.sum(), 1.0)


def drift_adjusted(ev: Sequence[str], spec: TrendSpec, post: int = 2025) -> np.ndarray:
    """Weights of the step into the policy year, less the step that the drift of earlier years foretells.

    The drift is a polynomial in time whose slopes are least-squares weights on the months of the fit; its own
    step is the difference of the powers' means over the two years, so the constant drops out.
    """
    step = year_mean(ev, post) - year_mean(ev, post - 1)
    if spec.trend is None:
        return step
    t = np.array([year_of(m) - post + (month_of(m) - 1) / 12 for m in ev])
    powers = np.stack([t**d for d in range(1, spec.degree + 1)], axis=1)
    inside = np.array([spec.trend[0] <= year_of(m) <= spec.trend[1] for m in ev])
    slopes = np.zeros((spec.degree, len(ev)))
    slopes[:, inside] = projection_weights(powers[inside])
    return step - (step @ powers) @ slopes


def summary_terms(months: Sequence[str]) -> dict[str, dict[str, float]]:
    """Placebo year, effect, acceleration, trend-adjusted effect, slope and effect against the last pre-month."""
    spec = SPECS["S1"]
    ev = event_months(months, spec)
    y23, y24, y25 = (year_mean(ev, y) for y in (2023, 2024, 2025))
    pre = np.flatnonzero([year_of(m) <= 2024 for m in ev])
    slope = np.zeros(len(ev))
    slope[pre] = np.linalg.pinv(np.column_stack([np.ones(len(pre)), pre]))[1]
    last = np.zeros(len(ev))
    last[pre[-1]] = 1.0
    combos = {
        "placebo_2024_vs_2023": y24 - y23,
        "effect_2025_vs_2024": y25 - y24,
        "accel": (y25 - y24) - (y24 - y23),
        "effect_trend_adj": drift_adjusted(ev, spec),
        "pre_slope": slope,
        "effect_vs_last_pre": y25 - last,
    }
    return {name: on_calendar(dict(zip(ev, map(float, a), strict=True)), spec) for name, a in combos.items()}


def effect_terms(months: Sequence[str], spec: TrendSpec = SPECS["S1"]) -> dict[str, dict[str, float]]:
    """One term per month after the base year."""
    return {m: on_calendar({m: 1.0}, spec) for m in event_months(months, spec)}


def spec_terms(months: Sequence[str]) -> dict[str, dict[str, float]]:
    """The trend-adjusted effect under each specification."""
    out = {}
    for name, spec in SPECS.items():
        ev = event_months(months, spec)
        out[name] = on_calendar(dict(zip(ev, map(float, drift_adjusted(ev, spec)), strict=True)), spec)
    return out


def bounds(effects: DataFrame, theta: DataFrame, grid: Sequence[float], by: str = "outcome", post_months: int = 12) -> DataFrame:
    """Relative-magnitude bounds: the change of the bias per month is at most M times the largest
    change between two months before the policy.

    ``effects`` has (by, ym, coef) for months before the policy; ``theta`` (by, coef, se).
    """
    steps = effects.withColumn("delta", F.abs(F.col("coef") - F.lag("coef").over(Window.partitionBy(by).orderBy("ym"))))
    worst = steps.groupBy(by).agg(F.max("delta").alias("max_pre_delta"))
    mean_k = (post_months + 1) / 2.0
    grid_col = F.explode(F.array(*[F.lit(float(m)) for m in grid])).alias("m")
    out = theta.join(worst, by).select(by, "coef", "se", "max_pre_delta", grid_col)
    bound = F.col("m") * F.col("max_pre_delta") * mean_k
    return out.select(by, "m", F.col("coef").alias("theta"), "se", "max_pre_delta", (F.col("coef") - bound).alias("set_low"), (F.col("coef") + bound).alias("set_high"))


def bootstrap_draws(contrasts: DataFrame, by: Sequence[str], n_draws: int, seed: int, treat: str = "treat", cluster: str = "zone") -> DataFrame:
    """Draws of a linear effect: estimate plus Webb-weighted cluster influences: (*by, draw, coef, b)."""
    s = influences(contrasts, by, treat, cluster)
    rows = s.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))
    v = webb_weight(uniform01(F.lit(seed), "draw", "cluster"))
    return rows.groupBy(*by, "coef", "draw").agg(F.sum(v * F.col("s")).alias("d")).select(*by, "draw", "coef", (F.col("coef") + F.col("d")).alias("b"))


def bootstrap_bounds(effect_draws: DataFrame, theta_draws: DataFrame, grid: Sequence[float], by: str = "outcome", post_months: int = 12) -> DataFrame:
    """Confidence sets for the bounds, with the largest pre-change drawn again in each replicate."""
    steps = effect_draws.withColumn("delta", F.abs(F.col("b") - F.lag("b").over(Window.partitionBy(by, "draw").orderBy("ym"))))
    worst = steps.groupBy(by, "draw").agg(F.max("delta").alias("dmax"))
    grid_col = F.explode(F.array(*[F.lit(float(m)) for m in grid])).alias("m")
    rows = theta_draws.join(worst, [by, "draw"]).select(by, "draw", "coef", "b", "dmax", grid_col)
    bound = F.col("m") * F.col("dmax") * ((post_months + 1) / 2.0)
    out = rows.groupBy(by, "coef", "m").agg(
        F.percentile(F.col("b") - bound, F.lit(0.025)).alias("ci_low"), F.percentile(F.col("b") + bound, F.lit(0.975)).alias("ci_high")
    )
    return out.select(by, "m", F.col("coef").alias("theta"), "ci_low", "ci_high", ((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)).alias("covers_zero"))


def breakdown(sets: DataFrame, by: str = "outcome") -> DataFrame:
    """The smallest grid value at which the confidence set reaches zero, NULL if none does."""
    return sets.groupBy(by, "theta").agg(F.min(F.when(F.col("covers_zero"), F.col("m"))).alias("breakdown_m"))


def bias_weights(months: Sequence[str], spec: TrendSpec, post: int = 2025) -> tuple[float, float]:
    """The mean bias after the policy, in units of the bound: if its monthly change is bounded, and if its curvature is.

    A change of at most 1 a month adds up to k after k months; a curvature of at most 1 adds the changes up once more.
    """
    n = sum(year_of(m) == post for m in event_months(months, spec))
    change = np.cumsum(np.ones(n))
    return float(change.mean()), float(np.cumsum(change).mean())


def restriction_terms(months: Sequence[str], spec: TrendSpec, post: int = 2025) -> dict[str, dict[str, float]]:
    """What both restrictions need: each effect before the policy, the effect against the last of them (``theta_rm``),
    and the effect less the foretold drift (``theta_sd``)."""
    ev = event_months(months, spec)
    before = [m for m in ev if year_of(m) < post]
    last = np.array([m == before[-1] for m in ev], dtype=float)
    out = {m: on_calendar({m: 1.0}, spec) for m in before}
    out["theta_rm"] = on_calendar(dict(zip(ev, map(float, year_mean(ev, post) - last), strict=True)), spec)
    out["theta_sd"] = on_calendar(dict(zip(ev, map(float, drift_adjusted(ev, spec, post)), strict=True)), spec)
    return out


def largest_change(effects: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, dmax): the largest change between neighbouring months of (by, ym, value)."""
    order = Window.partitionBy(*by).orderBy("ym")
    return effects.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(order))).groupBy(*by).agg(F.max("_d").alias("dmax"))


def _grid(values: Sequence[float]) -> Column:
    return F.explode(F.array(*[F.lit(float(m)) for m in values])).alias("m")


def restricted_sets(draws: DataFrame, weights: dict[str, tuple[float, float]], changes: Sequence[float], curvatures: Sequence[float]) -> DataFrame:
    """Confidence sets under both restrictions: (spec, outcome, restriction, m, theta, ci_low, ci_high, covers_zero).

    ``draws`` has (spec, outcome, part, draw, coef, b) with the parts of `restriction_terms`; ``weights`` the
    `bias_weights` of each specification. ``changes`` are multiples of the largest change before the policy, which each
    draw estimates again; ``curvatures`` are maximal biases in standard errors of the drift-adjusted effect.
    """
    by = ["spec", "outcome"]
    w_rm = F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, w[0])])
    pre = draws.where(~F.col("part").isin("theta_rm", "theta_sd")).withColumnRenamed("part", "ym")
    worst = largest_change(pre, [*by, "draw"], "b")
    moved = draws.where("part = 'theta_rm'").join(worst, [*by, "draw"]).select(*by, "coef", "b", (F.col("dmax") * w_rm[F.col("spec")]).alias("unit"), _grid(changes))
    curved = draws.where("part = 'theta_sd'")
    spread = curved.groupBy(*by).agg(F.stddev_samp("b").alias("unit"))
    curved = curved.join(spread, by).select(*by, "coef", "b", "unit", _grid(curvatures))
    rows = moved.withColumn("restriction", F.lit("RM")).unionByName(curved.withColumn("restriction", F.lit("SD")))
    sets = rows.groupBy(*by, "restriction", "m", F.col("coef").alias("theta")).agg(
        F.percentile(F.col("b") - F.col("m") * F.col("unit"), F.lit(0.025)).alias("ci_low"),
        F.percentile(F.col("b") + F.col("m") * F.col("unit"), F.lit(0.975)).alias("ci_high"),
    )
    return sets.withColumn("covers_zero", (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))


def curvature_breakdown(draws: DataFrame, weights: dict[str, tuple[float, float]]) -> DataFrame:
    """The curvature at which the set of the drift-adjusted effect reaches zero, 0 if it holds zero anyway."""
    w_sd = F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, w[1])])
    q = draws.where("part = 'theta_sd'").groupBy("spec", "outcome", F.col("coef").alias("theta_sd")).agg(
        F.stddev_samp("b").alias("se_sd"), F.percentile("b", F.lit(0.025)).alias("lo"), F.percentile("b", F.lit(0.975)).alias("hi")
    )
    inside = (F.col("lo") <= 0) & (F.col("hi") >= 0)
    bias = F.when(inside, 0.0).otherwise(F.least(F.abs("lo"), F.abs("hi")))
    return q.select("spec", "outcome", "theta_sd", "se_sd", (bias / w_sd[F.col("spec")]).alias("breakdown_sd"), F.try_divide(bias, "se_sd").alias("breakdown_sd_rel_se"))
