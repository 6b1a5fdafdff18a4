"""Doubly robust estimates: cross-fitted nuisances, partially linear and AIPW scores, heterogeneity.

Nuisance models are Spark ML estimators; every score after that is a Column and every estimate one
aggregate, so nothing row-sized leaves the executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.functions.exprs import ratio, uniform01
from tripspark.operators.reshape import qcut
from tripspark.session import checkpointed


def with_folds(df: DataFrame, key: Sequence[str], folds: int = 5, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.floor(uniform01(F.lit(seed), *key) * folds).cast("int"))


def _features(df: DataFrame, xs: Sequence[str], quadratic: bool) -> DataFrame:
    names = list(xs)
    if quadratic:
        extra = {f"_q_{a}_{b}": F.col(a) * F.col(b) for a, b in combinations_with_replacement(xs, 2)}
        df = df.withColumns(extra)
        names += list(extra)
    out = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(df)
    return out.drop(*[n for n in names if n.startswith("_q_")])


def _regressor(learner: str, y: str, out: str, seed: int):
    if learner == "gbt":
        return GBTRegressor(labelCol=y, predictionCol=out, maxDepth=4, maxIter=40, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    return LinearRegression(labelCol=y, predictionCol=out, regParam=0.01, solver="normal")


def _classifier(learner: str, d: str, seed: int):
    if learner == "gbt":
        return GBTClassifier(labelCol=d, probabilityCol="_p", maxDepth=4, maxIter=40, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    return LogisticRegression(labelCol=d, probabilityCol="_p", regParam=0.01)


def cross_fit(
    df: DataFrame, outcomes: Sequence[str], d: str, xs: Sequence[str], folds: int = 5, learner: str = "linear", quadratic: bool = True, seed: int = 0
) -> DataFrame:
    """Out-of-fold predictions: e_hat, and g_, mu1_, mu0_ per outcome. ``df`` has a fold column."""
    data = checkpointed(_features(df.withColumn("_d", F.col(d).cast("double")), xs, quadratic))
    parts = []
    for k in range(folds):
        train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
        model = _classifier(learner, "_d", seed).fit(train)
        scored = model.transform(test).withColumn("e_hat", vector_to_array("_p")[1]).drop("_p", "rawPrediction", "prediction")
        for y in outcomes:
            for name, rows in ((f"g_{y}", train), (f"mu1_{y}", train.where("_d = 1")), (f"mu0_{y}", train.where("_d = 0"))):
                scored = _regressor(learner, y, name, seed).fit(rows).transform(scored)
        parts.append(scored)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("features", "_d")


def plr(df: DataFrame, y: str, d: str, g: str, e: str) -> DataFrame:
    """Partially linear model: residual on residual, with its standard error."""
    ry, rd = F.col(y) - F.col(g), F.col(d) - F.col(e)
    s = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(rd * ry).alias("a"), F.sum(rd * rd).alias("q"),
        F.sum(ry * ry * rd * rd).alias("y2d2"), F.sum(ry * rd * rd * rd).alias("yd3"), F.sum(rd * rd * rd * rd).alias("d4"),
    )
    theta = ratio("a", "q")
    psi2 = (F.col("y2d2") - 2 * theta * F.col("yd3") + theta * theta * F.col("d4")) / F.col("n")
    se = F.sqrt(F.try_divide(psi2, F.pow(F.col("q") / F.col("n"), F.lit(2.0))) / F.col("n"))
    return s.select(theta.alias("plr_theta"), se.alias("plr_se"), "n")


def clip(e: str, low: float) -> Column:
    return F.least(F.greatest(F.col(e), F.lit(low)), F.lit(1.0 - low))


def aipw_score(y: str, d: str, e: Column, mu1: str, mu0: str) -> Column:
    yy, dd = F.col(y), F.col(d)
    return F.col(mu1) - F.col(mu0) + dd * (yy - F.col(mu1)) / e - (1 - dd) * (yy - F.col(mu0)) / (1 - e)


def overlap(e: str, low: float) -> Column:
    return (F.col(e) >= low) & (F.col(e) <= 1.0 - low)


def aipw(df: DataFrame, y: str, d: str, e: str, mu1: str, mu0: str, low: float = 0.05) -> DataFrame:
    """Average effect, effect on the treated, naive difference and sample size on the overlap region."""
    ec = clip(e, low)
    phi = aipw_score(y, d, ec, mu1, mu0)
    res = F.col(y) - F.col(mu0)
    att = (F.col(d) - (1 - F.col(d)) * ec / (1 - ec)) * res
    naive = df.agg((F.avg(F.when(F.col(d) == 1, F.col(y))) - F.avg(F.when(F.col(d) == 0, F.col(y)))).alias("x")).scalar()
    return df.where(overlap(e, low)).agg(
        F.avg(phi).alias("aipw_ate"),
        (F.stddev_samp(phi) / F.sqrt(F.count(F.lit(1)))).alias("aipw_se"),
        F.try_divide(F.avg(att), F.avg(F.col(d).cast("double"))).alias("aipw_att"),
        naive.alias("naive_diff"),
        F.count(F.lit(1)).alias("n_used"),
    )


def gates(df: DataFrame, tau: str, phi: str, bins: int = 5) -> DataFrame:
    """Mean score by quantile of the predicted effect."""
    return qcut(df, tau, bins, "grp").groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(phi).alias("gate"),
        (F.stddev_samp(phi) / F.sqrt(F.count(F.lit(1)))).alias("se"),
        F.avg(tau).alias("tau_mean"),
    )


def blp(df: DataFrame, tau: str, phi: str) -> DataFrame:
    """Best linear predictor of the score by the centred predicted effect, with robust errors."""
    m = df.agg(F.struct(F.avg(tau).alias("t"), F.avg(phi).alias("p"), F.regr_slope(phi, tau).alias("b")).alias("m")).scalar()
    z = F.col(tau) - m["t"]
    e = F.col(phi) - m["p"] - m["b"] * z
    s = df.agg(F.count(F.lit(1)).alias("n"), F.sum(z * z).alias("zz"), F.sum(e * e).alias("ee"), F.sum(z * z * e * e).alias("zzee"), F.first(m).alias("m"))
    return s.select(
        F.col("m.p").alias("beta1"),
        (F.sqrt("ee") / F.col("n")).alias("se1"),
        F.col("m.b").alias("beta2"),
        F.try_divide(F.sqrt("zzee"), F.col("zz")).alias("se2"),
    )


def clan(df: DataFrame, tau: str, traits: Sequence[str], bins: int = 5) -> DataFrame:
    """Mean traits of the groups with the smallest and the largest predicted effects."""
    cut = qcut(df, tau, bins, "grp")
    long = cut.select("grp", F.inline(F.array(*[F.struct(F.lit(c).alias("trait"), F.col(c).cast("double").alias("v")) for c in traits])))
    return long.groupBy("trait").agg(
        F.avg(F.when(F.col("grp") == 1, F.col("v"))).alias("low_group"), F.avg(F.when(F.col("grp") == bins, F.col("v"))).alias("high_group")
    )


def crump_threshold(df: DataFrame, e: str) -> float:
    """Crump's trimming point: the largest h = 1/(e(1-e)) not above twice the mean of smaller ones.

    Any h above twice the mean below it fails for all candidates in between, so the search jumps down
    to the next candidate: a few aggregates, no sort.
    """
    h = df.select((1.0 / (F.col(e) * (1.0 - F.col(e)))).alias("h")).where("h IS NOT NULL")
    top = h.agg(F.max("h")).first()[0]
    while top is not None:
        mean = h.where(F.col("h") <= top).agg(F.avg("h")).first()[0]
        if top <= 2.0 * mean:
            break
        top = h.where(F.col("h") <= 2.0 * mean).agg(F.max("h")).first()[0]
    # the root itself, not a power: a last digit decides whether the rows that set the point are kept
    return 0.0 if top is None else 0.5 - math.sqrt(max(0.25 - 1.0 / top, 0.0))


def trimmed(df: DataFrame, y: str, d: str, e: str, mu1: str, mu0: str, cluster: str, low: float, label: str) -> DataFrame:
    """AIPW at one trimming threshold with plain and clustered errors."""
    rows = df.where(overlap(e, low)).select(F.col(cluster).alias("c"), aipw_score(y, d, clip(e, low), mu1, mu0).alias("phi"), F.col(d).alias("d"))
    return _clustered(rows, label)


def ato(df: DataFrame, y: str, d: str, e: str, mu1: str, mu0: str, cluster: str, label: str = "overlap weights") -> DataFrame:
    """Augmented overlap-weighted effect."""
    ee, dd, yy = F.col(e), F.col(d), F.col(y)
    h = ee * (1 - ee)
    num = h * (F.col(mu1) - F.col(mu0)) + dd * (1 - ee) * (yy - F.col(mu1)) - (1 - dd) * ee * (yy - F.col(mu0))
    rows = df.select(F.col(cluster).alias("c"), num.alias("num"), h.alias("h"), dd.alias("d"))
    tot = rows.agg(F.struct(F.try_divide(F.sum("num"), F.sum("h")).alias("est"), F.avg("h").alias("hm")).alias("t")).scalar()
    psi = rows.select("c", "d", ((F.col("num") - tot["est"] * F.col("h")) / tot["hm"]).alias("phi"))
    return _clustered(psi, label).withColumn("estimate", tot["est"])


def _clustered(rows: DataFrame, label: str) -> DataFrame:
    """Mean with plain and clustered errors; without rows the count is 0 and the rest NULL."""
    per = rows.groupBy("c").agg(F.sum("phi").alias("s"), F.count(F.lit(1)).alias("n"))
    dev = F.col("s") - F.col("n") * rows.agg(F.avg("phi")).scalar()
    spread = per.agg(F.sqrt(F.sum(dev * dev))).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("n_used"), F.sum("d").cast("long").alias("n_treated"), F.avg("phi").alias("estimate"),
        F.stddev_samp("phi").alias("sd"),
    ).select(
        F.lit(label).alias("rule"), "n_used", "n_treated", "estimate",
        F.try_divide("sd", F.sqrt("n_used")).alias("se_iid"), F.try_divide(spread, F.col("n_used")).alias("se_cluster"),
    )
