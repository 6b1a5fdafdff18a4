"""Permutation, bootstrap and spatial inference, and corrections for multiple testing.

Random numbers are hashes of (seed, draw, unit), so a lost task recomputes the same draw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripspark.functions.exprs import uniform01, webb_weight
from tripspark.operators.spatial import pairs_within


def draws(spark: SparkSession, n: int, parts: int | None = None) -> DataFrame:
    """Draw numbers 1..n, spread over the cluster."""
    return spark.range(1, n + 1, 1, parts or spark.sparkContext.defaultParallelism).withColumnRenamed("id", "draw")


def _with_draws(units: DataFrame, n_draws: int) -> DataFrame:
    """Every unit once per draw: the unit row is repeated in place by a generator, without a join."""
    return units.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))


def permutation_coefficients(contrasts: DataFrame, unit: str, n_treated: int, n_draws: int, seed: int) -> DataFrame:
    """Difference in mean contrasts when ``n_treated`` control units are drawn as treated: (draw, coef).

    The contrast of each unit is fixed on a balanced panel, so a draw is one sum over its units.
    Units with the smallest hash values are the drawn ones.
    """
    base = _with_draws(contrasts.select(F.col(unit).alias("unit"), "c"), n_draws)
    ranked = base.withColumn(
        "r", F.row_number().over(Window.partitionBy("draw").orderBy(uniform01(F.lit(seed), "draw", "unit"), "unit"))
    )
    drawn = F.col("r") <= n_treated
    return ranked.groupBy("draw").agg((F.avg(F.when(drawn, F.col("c"))) - F.avg(F.when(~drawn, F.col("c")))).alias("coef"))


def two_sided_p(draws_df: DataFrame, real: Column, value: str = "coef") -> DataFrame:
    """(1 + draws at least as far from 0) / (1 + draws), with the spread of the draws."""
    return draws_df.agg(
        F.count(F.lit(1)).alias("n_perm"),
        ((1 + F.sum((F.abs(F.col(value)) >= F.abs(real)).cast("int"))) / (1 + F.count(F.lit(1)))).alias("p_two_sided"),
        F.avg(value).alias("perm_mean"),
        F.stddev_pop(value).alias("perm_sd"),
        F.percentile(value, F.lit(0.025)).alias("perm_p2_5"),
        F.percentile(value, F.lit(0.975)).alias("perm_p97_5"),
    )


def cluster_parts(scores: DataFrame, by: Sequence[str], cluster: str, x: str = "x", y: str = "y") -> DataFrame:
    """Per cluster: A = Σ x y and Q = Σ x² of demeaned columns."""
    return scores.groupBy(*by, F.col(cluster).alias("cluster")).agg(F.sum(F.col(x) * F.col(y)).alias("a"), F.sum(F.col(x) * F.col(x)).alias("q"))


def wild_bootstrap(parts: DataFrame, by: Sequence[str], n_draws: int, seed: int, adj: Column) -> DataFrame:
    """Wild cluster bootstrap with Webb weights: (*by, draw, t_null, t_centred).

    ``parts`` holds a, q and b (the estimate), one row per cluster. Σ (v·A - β·Q)² expands into four
    sums, so each draw is one pass over its clusters and one groupBy serves all draws and outcomes.
    The weight depends on draw and cluster only: outcomes share draws, as step-down tests need.
    """
    v = webb_weight(uniform01(F.lit(seed), "draw", "cluster"))
    rows = _with_draws(parts, n_draws).withColumn("v", v)
    rows = rows.withColumn("u", F.col("a") - F.col("b") * F.col("q"))  # scores of the estimated residuals

    def sums(c: str) -> dict[str, Column]:
        x = F.col("v") * F.col(c)
        return {f"s_{c}": F.sum(x), f"ss_{c}": F.sum(x * x), f"sq_{c}": F.sum(x * F.col("q"))}

    agg = {**sums("a"), **sums("u"), "sxx": F.sum("q"), "qq": F.sum(F.col("q") * F.col("q"))}
    g = rows.groupBy(*by, "draw").agg(*[e.alias(k) for k, e in agg.items()])

    def t_of(c: str) -> Column:
        beta = F.col(f"s_{c}") / F.col("sxx")
        ss = F.col(f"ss_{c}") - 2.0 * beta * F.col(f"sq_{c}") + beta * beta * F.col("qq")
        return F.try_divide(F.col(f"s_{c}"), F.sqrt(adj * F.greatest(ss, F.lit(0.0))))

    return g.select(*by, "draw", t_of("a").alias("t_null"), t_of("u").alias("t_centred"))


def wild_summary(boot: DataFrame, observed: DataFrame, by: Sequence[str]) -> DataFrame:
    """p-value under the null and the studentised interval; ``observed`` has coef, se and t."""
    joined = boot.join(observed, list(by))
    s = joined.groupBy(*by, "coef", "se", "t").agg(
        F.count(F.lit(1)).alias("n_draws"),
        F.avg((F.abs(F.col("t_null")) >= F.abs(F.col("t"))).cast("double")).alias("p_raw"),
        F.percentile("t_centred", F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
    )
    return s.select(
        *by,
        "coef",
        "se",
        F.greatest(F.col("p_raw"), 1.0 / (F.col("n_draws") + 1)).alias("p_wild"),
        (F.col("coef") - F.col("q")[1] * F.col("se")).alias("ci_low"),
        (F.col("coef") - F.col("q")[0] * F.col("se")).alias("ci_high"),
    )


def romano_wolf(boot: DataFrame, observed: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Step-down p-values on joint draws: the largest |t*| over the not yet rejected outcomes."""
    order = Window.orderBy(F.desc(F.abs("t")), outcome)  # one row per outcome
    ranked = observed.select(outcome, F.abs("t").alias("t_abs"), F.row_number().over(order).alias("step"))
    joined = boot.join(ranked, outcome)
    rest = Window.partitionBy("draw").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    worst = joined.withColumn("t_max", F.max(F.abs("t_centred")).over(rest))
    raw = worst.groupBy(outcome, "step").agg(
        F.avg((F.col("t_max") >= F.col("t_abs")).cast("double")).alias("p"), F.count(F.lit(1)).alias("n")
    )
    steps = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return raw.select(outcome, "step", F.greatest(F.max("p").over(steps), 1.0 / (F.col("n") + 1)).alias("romano_wolf"))


def holm_bh(tests: DataFrame, p: str, key: Sequence[str]) -> DataFrame:
    """Holm and Benjamini–Hochberg adjusted p-values over a family of tests (one row per test)."""
    m = F.count(F.lit(1)).over(Window.partitionBy())
    up = Window.orderBy(F.asc(p), *key)
    rank = F.row_number().over(up)
    out = tests.withColumns({"_m": m, "_i": rank})
    holm = F.max((F.col("_m") - F.col("_i") + 1) * F.col(p)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    down = Window.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    bh = F.min(F.col(p) * F.col("_m") / F.col("_i")).over(down)
    return out.withColumns({"p_holm": F.least(holm, F.lit(1.0)), "q_bh": F.least(bh, F.lit(1.0))}).drop("_m", "_i")


def twoway_variance(scores: DataFrame, by: Sequence[str], unit: str, period: str, s: str = "s") -> DataFrame:
    """Σ of squared cluster sums by unit, by period and by cell: (*by, v_unit, v_period, v_cell, n, g, w)."""

    def squares(keys: list[str], name: str) -> DataFrame:
        sums = scores.groupBy(*by, *keys).agg(F.sum(s).alias("x"))
        return sums.groupBy(*by).agg(F.sum(F.col("x") * F.col("x")).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    out = squares([unit], "v_unit").join(squares([period], "v_period"), list(by)).join(squares([unit, period], "v_cell"), list(by))
    return out


def conley_spatial(scores: DataFrame, points: DataFrame, by: Sequence[str], unit: str, period: str, cutoff: float, s: str = "s") -> DataFrame:
    """Σ over periods and unit pairs closer than the cutoff of S_g K(d) S_h, with the Bartlett kernel: (*by, spatial).

    ``points`` has unit, x and y. Pairs come from a grid join, so far units never meet.
    """
    near = pairs_within(points, unit, cutoff, both_directions=True).withColumn("kern", 1.0 - F.col("dist") / cutoff)
    cell = scores.groupBy(*by, unit, period).agg(F.sum(s).alias("s"))
    left = cell.select(*by, F.col(unit).alias("a"), period, F.col("s").alias("sa"))
    right = cell.select(*by, F.col(unit).alias("b"), period, F.col("s").alias("sb"))
    pairs = left.join(near, "a").join(right, [*by, "b", period])
    return pairs.groupBy(*by).agg(F.sum(F.col("sa") * F.col("kern") * F.col("sb")).alias("spatial"))


def twoway_se(variance: DataFrame, sxx: str, adj: Column) -> Column:
    """Two-way clustered error, not below the one-way error."""
    total = F.col("v_unit") + F.col("v_period") - F.col("v_cell")
    return F.sqrt(adj * F.greatest(total, F.col("v_unit"))) / F.col(sxx)


