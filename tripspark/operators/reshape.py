"""Quantiles, quantile bins, pivots and reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.exprs import uniform01
from tripspark.session import checkpointed


#: Up to this many groups the brackets of `exact_quantiles` travel to the rows; beyond it both sides are shuffled.
BROADCAST_GROUPS = 100_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], accuracy: int = 10_000) -> DataFrame:
    """Quantiles with linear interpolation per group, for groups of any size: (keys, prob, value).

    A sketch of bounded size brackets each wanted rank; only the values inside the brackets are
    then counted and ranked exactly. The sketch guarantees its rank error, so the bracket always
    holds the rank, and no task sees more than a thin slice of a group. With few groups the rows
    are never moved: only the values inside the brackets are.
    """
    if not keys:
        one = exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, accuracy)
        return one.drop("_all")
    x = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(*keys, x.alias("x"))
    slack = 3.0 / accuracy
    lows = [max(p - slack, 0.0) for p in probs]
    highs = [min(p + slack, 1.0) for p in probs]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("x", lows + highs, accuracy).alias("edges"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
    )
    k = len(probs)
    lo = [F.col("x_min") if lows[i] == 0.0 else F.get("edges", F.lit(i)) for i in range(k)]
    hi = [F.col("x_max") if highs[i] == 1.0 else F.get("edges", F.lit(k + i)) for i in range(k)]
    brackets = sketch.select(*keys, "n", F.array(*[F.struct(F.lit(p).alias("prob"), lo[i].alias("lo"), hi[i].alias("hi")) for i, p in enumerate(probs)]).alias("b"))
    brackets = checkpointed(brackets)  # one row per group: read twice below
    few = brackets.count() <= BROADCAST_GROUPS
    met = rows.join(F.broadcast(brackets) if few else brackets, keys)
    sides = []
    for i in range(k):
        below, above = F.col("x") < F.col("b")[i]["lo"], F.col("x") > F.col("b")[i]["hi"]
        sides += [F.sum(below.cast("long")).alias(f"_c{i}"), F.max(F.when(below, F.col("x"))).alias(f"_l{i}"), F.min(F.when(above, F.col("x"))).alias(f"_h{i}")]
    totals = met.groupBy(*keys).agg(*sides)
    around = totals.select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(p).alias("prob"), F.col(f"_c{i}").alias("below"), F.col(f"_l{i}").alias("before"), F.col(f"_h{i}").alias("after"))
                    for i, p in enumerate(probs)
                ]
            )
        ),
    )
    hits = F.filter("b", lambda r: (F.col("x") >= r["lo"]) & (F.col("x") <= r["hi"]))
    inside = met.select(*keys, "n", "x", F.explode(hits).alias("r")).groupBy(*keys, "n", "x", F.col("r.prob").alias("prob")).agg(F.count(F.lit(1)).alias("c"))
    ranked = inside.join(around, [*keys, "prob"])
    order = Window.partitionBy(*keys, "prob").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("upto", F.col("below") + F.sum("c").over(order))
    position = F.col("prob") * (F.col("n") - 1)
    first, second = F.floor(position), F.ceil(position)  # 0-based ranks to interpolate between
    ends = ranked.groupBy(*keys, "prob", "n", "below", "before", "after").agg(
        F.min(F.when(F.col("upto") > first, F.col("x"))).alias("a"), F.min(F.when(F.col("upto") > second, F.col("x"))).alias("b")
    )
    # a rank can sit one place outside its bracket, on the neighbouring value
    low = F.when(first < F.col("below"), F.col("before")).otherwise(F.coalesce("a", "after"))
    high = F.when(second < F.col("below"), F.col("before")).otherwise(F.coalesce("b", "after"))
    return ends.select(*keys, "prob", (low + (high - low) * (position - first)).alias("value"))


def quantile_edges(df: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Interpolated quantile edges, as one array per group, for groups of any size."""
    found = exact_quantiles(df, by or [], column, [i / bins for i in range(bins + 1)])
    listed = found.groupBy(*(by or [])).agg(F.array_sort(F.collect_list(F.struct("prob", "value"))).alias("pv"))  # bins + 1 values
    return listed.select(*(by or []), F.transform("pv", lambda e: e["value"]).alias("edges"))


def bin_of(value: str | Column, edges: Column, bins: int) -> Column:
    """Bin number from 1, closed on the right, with the lowest value in bin 1."""
    x = F.col(value) if isinstance(value, str) else value
    inner = F.slice(edges, 2, bins - 1)
    return F.when(x.isNotNull(), F.size(F.filter(inner, lambda e: e < x)) + 1)


def qcut(df: DataFrame, column: str, bins: int, name: str = "bin", by: list[str] | None = None) -> DataFrame:
    """Quantile bins with interpolated edges. Not ntile, which splits ties by rank."""
    edges = quantile_edges(df.where(F.col(column).isNotNull()), column, bins, by)
    if by:
        joined = df.join(edges, by, "left")
        return joined.withColumn(name, bin_of(column, F.col("edges"), bins)).drop("edges")
    one = edges.scalar()
    above = [(F.col(column) > F.get(one, F.lit(i))).cast("int") for i in range(1, bins)]
    return df.withColumn(name, sum(above, F.lit(1)))


def pivot_sum(df: DataFrame, keys: list[str], column: str, values: list, value: str, prefix: str = "") -> DataFrame:
    """Sums with fixed pivot values; the values are given, so no extra job looks for them."""
    aggs = [F.sum(F.when(F.col(column) == v, F.col(value))).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(*keys).agg(*aggs)


def row_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each listed column as percent of the row total, NULL counted as 0."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    total = sum(filled[1:], filled[0])
    return df.withColumns({c: 100.0 * F.try_divide(x, total) for c, x in zip(columns, filled, strict=True)})


def hash_sample(df: DataFrame, keys: list[str], rate: str | Column | float, seed: int) -> DataFrame:
    """Bernoulli sample decided by a hash of the row's key: the same rows on every run and partitioning."""
    p = F.col(rate) if isinstance(rate, str) else (rate if isinstance(rate, Column) else F.lit(rate))
    return df.where(uniform01(F.lit(seed), *keys) < p)


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The k largest rows, ties broken by key; each task keeps only k rows."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key: the first in the given order, found by an aggregate that combines before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], *[F.col(c).alias(f"_{c}") for c in others])
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_best"))
    return best.select(*keys, *[F.col(f"_best._{c}").alias(c) for c in others])
