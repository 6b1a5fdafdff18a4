"""Rings from points alone, against rings over the table of pairs."""

import numpy as np
from pyspark.sql import functions as F

from tripspark.operators import spatial


def test_rings_without_pairs_equal_rings_over_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    xy = rng.uniform(0, 1, size=(150, 2))
    rows = [(i, int(i % 40 != 0), *map(float, p)) for i, p in enumerate(xy)] + [(150, 1, None, 0.5), (151, 0, None, None), (152, 1, 9.0, 9.0)]
    p = spark.createDataFrame(rows, "k long, label int, x double, y double")
    want = {r.k: r.ring for r in spatial.rings(p, spatial.adjacency(p, "k", 0.1), "k", F.col("label") == 0).collect()}
    assert len(set(want.values())) > 4
    monkeypatch.delattr(spatial, "pairs_within")
    got = {r.k: r.ring for r in spatial.rings_within(p, "k", 0.1, F.col("label") == 0).collect()}
    assert got == want
