"""The forest's scores against a walk node by node, and quantiles that leave the rows where they are."""

import numpy as np
import pytest

from tripspark.operators import forest, reshape


def test_scores_equal_a_walk_node_by_node(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    x[:5] = np.inf
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double, c double")
    names = ["a", "b", "c"]
    trees = forest.fit(df.where("a < double('inf')"), names, ["k"], trees=12, sample=32, seed=5)
    got = {r.k: r.score for r in forest.score(df, trees, names, ["k"]).collect()}
    grown = [g.sort_values("node").reset_index(drop=True) for _, g in trees.groupby("tree")]
    scale = np.mean([forest.mean_path(float(g["size"][0])) for g in grown])
    for i, row in enumerate(x):
        total = 0.0
        for g in grown:
            at = 0
            while g["feature"][at] >= 0:
                at = g["right"][at] if row[g["feature"][at]] >= g["split"][at] else g["left"][at]
            total += g["depth"][at] + float(forest.mean_path(float(g["size"][at])))
        assert got[i] == pytest.approx(2.0 ** (-total / len(grown) / scale), rel=1e-12)


def test_a_leaf_leads_to_itself(spark):
    df = spark.createDataFrame([(i, float(i % 9)) for i in range(64)], "k long, a double")
    trees = forest.fit(df, ["a"], ["k"], trees=3, sample=16, seed=1)
    for _, g in trees.groupby("tree"):
        feature, _, child, _, depth = forest._packed(g.sort_values("node"))
        for leaf in np.flatnonzero(g.sort_values("node")["feature"].to_numpy() < 0):
            assert list(child[2 * leaf : 2 * leaf + 2]) == [leaf, leaf]
        assert depth == g["depth"].max() and (feature >= 0).all()


@pytest.mark.parametrize("bound, joins", [(100_000, 1), (1, 0)])
def test_rows_stay_while_groups_are_few(spark, monkeypatch, bound, joins):
    monkeypatch.setattr(reshape, "BROADCAST_GROUPS", bound)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS x")
        found = reshape.exact_quantiles(df, ["g"], "x", [0.5])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert min(plan.count("BroadcastHashJoin"), 1) == joins
        assert {r.g: r.value for r in found.collect()} == {g: float(np.median(np.arange(g, 1000, 3))) for g in range(3)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
