"""Re-identification risk and differentially private counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.exprs import laplace_noise, uniform01


def k_anonymity(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Classes, share of rows in classes of 1, below 5 and below 10, and the median class size.

    Everything after the class counts works on the histogram of class sizes, which is tiny.
    """
    classes = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))  # a column of the set may be called k
    hist = classes.groupBy(F.col("_rows").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    return _risk(hist.withColumn("qi", F.lit(label)), ["qi"])


def _risk(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Measures of a histogram of class sizes (by, k, c)."""
    whole = Window.partitionBy(*by)
    h = hist.withColumns({"upto": F.sum("c").over(whole.orderBy("k")), "total": F.sum("c").over(whole)})
    rows = F.sum(F.col("k") * F.col("c"))

    def share(limit: int):
        return 100.0 * F.sum(F.when(F.col("k") < limit, F.col("k") * F.col("c")).otherwise(0)) / rows

    low = F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) / 2), F.col("k")))
    high = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("k")))
    return h.groupBy(*by).agg(
        F.sum("c").alias("classes"),
        rows.alias("trips"),
        share(2).alias("unique_pct"),
        share(5).alias("lt5_pct"),
        share(10).alias("lt10_pct"),
        ((low + high) / 2.0).alias("median_class"),
    )


def k_anonymity_sets(df: DataFrame, sets: dict[str, Sequence[str]], finest: Sequence[str], derived: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Risk of many column sets from one scan: rows are counted once by ``finest``, ``derived`` adds the columns that
    follow from those, and one roll-up over all sets gives one histogram of class sizes."""
    cells = derived(df.groupBy(*finest).agg(F.count(F.lit(1)).alias("n")))
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    classes = cells.groupingSets([list(s) for s in sets.values()], *columns).agg(F.sum("n").alias("k"), F.grouping_id().alias("g"))
    hist = classes.groupBy("g", "k").agg(F.count(F.lit(1)).alias("c"))
    left_out = {label: sum(1 << i for i, c in enumerate(reversed(columns)) if c not in s) for label, s in sets.items()}
    name = F.create_map(*[F.lit(x) for label, g in left_out.items() for x in (g, label)])
    return _risk(hist.select(F.element_at(name, F.col("g").cast("int")).alias("qi"), "k", "c"), ["qi"])


def laplace_sums(
    rows: DataFrame, keys: Sequence[str], cells: str, cell_keys: Sequence[str], value: str, eps: Sequence[float], reps: int, seed: int, floor: float = 1.0
) -> DataFrame:
    """Sums of noisy cells: ``cells`` is a short array of (cell_keys, value), and each row comes back once for each
    budget and replicate with the sum of its cells, each with its own noise and no less than ``floor``."""
    budgets = F.explode(F.array(*[F.lit(float(e)) for e in eps]))
    out = rows.withColumn("eps", budgets).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))

    def noisy(cell):
        u = uniform01(F.lit(seed), F.col("eps").cast("decimal(10,4)"), "rep", *keys, *[cell[k] for k in cell_keys])
        return F.greatest(cell[value] + laplace_noise(u, 1.0 / F.col("eps")), F.lit(floor))

    return out.withColumn(value, F.aggregate(cells, F.lit(0.0), lambda total, cell: total + noisy(cell))).drop(cells)
