"""Demand forecasts on daily series: back-test metrics, counterfactual effects and block bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.exprs import uniform01
from tripspark.operators.regression import ridge_loo


def metrics(df: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Days, mean absolute percent error, root mean squared error and percent bias."""
    e = F.col(actual) - F.col(predicted)
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("holdout_days"),
        (100.0 * F.avg(F.try_divide(F.abs(e), F.col(actual)))).alias("mape_pct"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (100.0 * F.avg(F.try_divide(e, F.col(actual)))).alias("bias_pct"),
    )


def fit_predict(df: DataFrame, train: Column, y: str, xs: Sequence[str], kind: str = "ridge", name: str = "pred", seed: int = 0) -> DataFrame:
    """Fit on the training rows and predict all rows."""
    rows = df.where(train)
    if kind == "ridge":
        return df.withColumn(name, ridge_loo(rows, y, xs).predict())
    assembler = VectorAssembler(inputCols=list(xs), outputCol="_f", handleInvalid="error")
    model = GBTRegressor(labelCol=y, featuresCol="_f", predictionCol=name, maxDepth=4, maxIter=20, stepSize=0.1, seed=seed).fit(assembler.transform(rows))
    return model.transform(assembler.transform(df)).drop("_f")


def monthly_block_ci(residuals: DataFrame, gaps: DataFrame, n_draws: int, seed: int, block: int = 7) -> DataFrame:
    """Interval of a mean log gap per month from blocks of consecutive pre-period residuals.

    ``residuals`` (i, r) are numbered from 0 in time order; ``gaps`` (month, days, gap). A draw takes
    ceil(days / block) blocks and keeps the first ``days`` values. Blocks become rows by a generator
    and meet the residuals by an equi-join on the day number.
    """
    n = residuals.count()
    need = F.ceil(F.col("days") / block).cast("int")
    rows = gaps.select("month", "days", F.explode(F.sequence(F.lit(1), F.lit(n_draws))).alias("draw"), need.alias("need"))
    rows = rows.select("month", "days", "draw", F.explode(F.sequence(F.lit(0), F.col("need") - 1)).alias("b"))
    start = F.floor(uniform01(F.lit(seed), "month", "draw", "b") * (n - block)).cast("int")
    rows = rows.withColumn("start", start)
    rows = rows.select("month", "days", "draw", "b", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o"))
    rows = rows.where(F.col("b") * block + F.col("o") < F.col("days")).withColumn("i", F.col("start") + F.col("o"))
    sims = rows.join(residuals, "i").groupBy("month", "draw").agg(F.avg("r").alias("sim"))
    q = sims.join(gaps, "month").groupBy("month", "days", "gap").agg(
        F.percentile(F.col("gap") - F.col("sim"), F.array(F.lit(0.025), F.lit(0.975))).alias("q")
    )

    def pct(c: Column) -> Column:
        return 100.0 * (F.exp(c) - 1.0)

    return q.select("month", "days", pct(F.col("gap")).alias("effect_pct"), pct(F.col("q")[0]).alias("ci_low"), pct(F.col("q")[1]).alias("ci_high"))


def numbered(df: DataFrame, order: str, name: str = "i") -> DataFrame:
    """Rows of one calendar series numbered from 0 in time order (one row per day, so short)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1)
