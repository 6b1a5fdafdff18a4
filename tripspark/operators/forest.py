"""Isolation forest: trees from small samples built in parallel, all rows scored in batches.

Each tree sees a bounded sample, so building is one small group per tree. The finished forest has at
most trees × 2·sample nodes and travels to the tasks as a broadcast variable; rows never move.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripspark.functions.exprs import uniform01
from tripspark.operators.reshape import exact_quantiles
from tripspark.session import checkpointed

NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, depth int, size int"


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    out = 2.0 * (np.log(big - 1.0) + 0.5772156649015329) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    nodes: list[tuple] = []
    work = [(x, 0, -1, False)]
    while work:
        pts, depth, parent, is_right = work.pop()
        here = len(nodes)
        if parent >= 0:
            f, s, left, right, d, size = nodes[parent]
            nodes[parent] = (f, s, left if is_right else here, here if is_right else right, d, size)
        spread = np.ptp(pts, axis=0) if len(pts) > 1 else np.zeros(pts.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= max_depth or len(usable) == 0:
            nodes.append((-1, 0.0, -1, -1, depth, len(pts)))
            continue
        f = int(rng.choice(usable))
        s = float(rng.uniform(pts[:, f].min(), pts[:, f].max()))
        nodes.append((f, s, -1, -1, depth, len(pts)))
        below = pts[:, f] < s
        work.append((pts[below], depth + 1, here, False))
        work.append((pts[~below], depth + 1, here, True))
    return nodes


def _tree_samples(df: DataFrame, key: Sequence[str], trees: int, sample: int, seed: int) -> DataFrame:
    """At most ``sample`` rows per tree, chosen by hash in one pass over the rows."""
    n = df.count()
    need = trees * sample * 1.3
    copies = min(trees, max(1, int(np.ceil(need / max(n, 1)))))
    rate = min(1.0, need / max(n * copies, 1))
    rows = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    rows = rows.where(uniform01(F.lit(seed), "_copy", *key) < rate)
    tree = F.floor(uniform01(F.lit(seed + 1), "_copy", *key) * trees).cast("int")
    rows = rows.withColumns({"tree": tree, "_h": uniform01(F.lit(seed + 2), "_copy", *key)})
    order = Window.partitionBy("tree").orderBy("_h", *key)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample)


def fit(df: DataFrame, features: Sequence[str], key: Sequence[str], trees: int = 200, sample: int = 256, seed: int = 0) -> pd.DataFrame:
    """The forest as a node table of bounded size."""
    max_depth = int(np.ceil(np.log2(max(sample, 2))))
    picked = _tree_samples(df.select(*key, *features), key, trees, sample, seed).select("tree", *features)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pts = pdf[list(features)].sort_values(list(features)).to_numpy(dtype=float)
        nodes = _grow(pts, np.random.default_rng([seed, tree]), max_depth)
        out = pd.DataFrame(nodes, columns=["feature", "split", "left", "right", "depth", "size"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", tree)
        return out

    return picked.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()


def _packed(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(feature, split, children, path, depth) of one tree; a leaf leads to itself, so all rows take ``depth`` equal steps."""
    at = np.arange(len(nodes), dtype=np.intp)
    feature = nodes["feature"].to_numpy()
    leaf = feature < 0
    child = np.stack([np.where(leaf, at, nodes[side].to_numpy()) for side in ("left", "right")], axis=1)
    path = nodes["depth"].to_numpy() + mean_path(nodes["size"].to_numpy())
    return np.where(leaf, 0, feature).astype(np.intp), nodes["split"].to_numpy(), child.ravel().astype(np.intp), path, int(nodes["depth"].max())


def score(df: DataFrame, forest: pd.DataFrame, features: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Anomaly score of every row, near 1 for isolated rows: (*kept, score)."""
    by_tree = [g.sort_values("node") for _, g in forest.groupby("tree")]
    packed = [_packed(g) for g in by_tree]
    sizes = [int(g["size"].iloc[0]) for g in by_tree]
    scale = float(np.mean(mean_path(np.array(sizes, dtype=float)))) if sizes else 1.0
    shared = df.sparkSession.sparkContext.broadcast(packed)
    names, keys = list(features), list(kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = len(pdf)
            x = pdf[names].to_numpy(dtype=float).ravel(order="F")  # feature by feature
            total = np.zeros(n)
            rows = np.arange(n)
            for feature, split, child, path, depth in shared.value:
                at = np.zeros(n, dtype=np.intp)
                for _ in range(depth):
                    value = x.take(feature.take(at) * n + rows)
                    at = child.take(2 * at + (value >= split.take(at)))
                total += path.take(at)
            out = pdf[keys].copy()
            out["score"] = np.power(2.0, -total / len(shared.value) / scale)
            yield out

    schema = df.select(*keys).schema.add("score", "double")
    return df.select(*keys, *names).mapInPandas(run, schema)


def filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing and infinite feature values replaced by the feature's exact median over the rows that have one."""
    usable = {f: F.when(~F.isnan(f) & (F.abs(f) < float("inf")), F.col(f)) for f in features}
    clean = df.withColumns({f: e for f, e in usable.items()})
    gaps = clean.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    for f in features:
        if gaps[f]:
            middle = exact_quantiles(clean.select(f), [], f, [0.5]).select("value").scalar()
            clean = clean.withColumn(f, F.coalesce(F.col(f), middle))
    return clean


def flag_anomalies(
    df: DataFrame, features: Sequence[str], key: Sequence[str], contamination: float = 0.005, trees: int = 200, seed: int = 0, carry: Sequence[str] = ()
) -> DataFrame:
    """Scores and a 0/1 flag for the ``contamination`` share with the highest scores: (*key, *carry, score, iso_flag).

    ``carry`` columns come along as they were; missing features are filled for the forest alone.
    """
    kept = [c for c in carry if c not in key]
    named = df.select(*key, *kept, *[F.col(f).alias(f"_f_{f}") for f in features])
    names = [f"_f_{f}" for f in features]
    named = checkpointed(filled(named, names))
    forest = fit(named, names, key, trees=trees, seed=seed)
    scores = checkpointed(score(named, forest, names, [*key, *kept]))
    limit = exact_quantiles(scores, [], "score", [1.0 - contamination]).select("value").scalar()
    return scores.withColumn("iso_flag", (F.col("score") > limit).cast("int"))
