"""Approximate nearest neighbours with a permutation index.

Each vector is described by its nearest pivots in order. It is posted in the inverted files of its first `POSTED`
pivots; a query visits the files of its first pivots, ranks what it finds by the footrule distance of the orders
(over the first `ORDERED` pivots, an absent pivot having the place after the last), and the better part of every
file is scored with the exact cosine in double precision. Equal vectors are indexed once.

Files and visits are cut into blocks of bounded size that meet in an equality join of block numbers. Every row is
indexed; the pivots are a bounded sample. Small tables are searched whole, since a query visits further files until
those hold `LEAST_POSTINGS` entries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripspark.llm.common import hash_order
from tripspark.session import checkpointed

PIVOTS = 128
POSTED = 8
VISITED = 24
ORDERED = 32
LEAST_POSTINGS = 4096
SCORED_SHARE = 0.4  # of a file block, by footrule, and at least
SCORED_LEAST = 512  # entries of it
FILE_BLOCK = 4096  # entries of a file in one task
VISIT_BLOCK = 2048  # visits of a file in one task
K = 5


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v: array<double>) of rows that take part.

    Left out: null ids, null or zero vectors, null or non-finite components, and vectors whose length is not the
    most frequent one (the smaller on a tie), since the measure is not defined between lengths.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad).filter(F.exists("v", lambda x: x != 0.0))
    top = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.filter(F.size("v") == (top.n if top else -1))


def classes(rows: DataFrame, k: int = K) -> DataFrame:
    """(h1, h2, v, ids): each different vector once, with the k + 1 smallest ids that have it.

    A window with a row limit is cut before its shuffle, so a vector that a third of the rows share moves k + 1
    rows from a task. h1 and h2 are a 128-bit hash of the vector.
    """
    keyed = rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2")).distinct()
    first = keyed.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("r") <= k + 1)
    return first.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))


def _orders(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable").astype(np.int16)


def ordered(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (h1, h2, v, ids) with ``near``, the pivots from near to far."""

    @F.pandas_udf("array<smallint>")
    def near(v: pd.Series) -> pd.Series:
        return pd.Series(list(_orders(np.stack(v.to_numpy()), pivots))) if len(v) else pd.Series([], dtype=object)

    return rows.withColumn("near", near("v"))


def _weights(orders: np.ndarray, length: int) -> np.ndarray:
    """length - place of each pivot, 0 if absent: less shared weight is more footrule distance."""
    w = np.zeros((len(orders), orders.shape[1]), dtype=np.uint8)
    take = min(length, orders.shape[1])
    np.put_along_axis(w, orders[:, :take].astype(np.int64), np.arange(length, length - take, -1, dtype=np.uint8)[None, :].repeat(len(orders), 0), 1)
    return w


def _search(files: pd.DataFrame, visits: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k + 1 of one file block for every visiting query."""
    if not len(files) or not len(visits):
        return pd.DataFrame({"q1": [], "q2": [], "h1": [], "h2": [], "score": [], "ids": []})
    x = np.stack(files.v.to_numpy())
    x_norm = np.linalg.norm(x, axis=1)
    w = np.ascontiguousarray(_weights(np.stack(files.near.to_numpy()), ORDERED).T)  # one row of weights for each pivot
    q = np.stack(visits.v.to_numpy())
    q_order = np.stack(visits.near.to_numpy()).astype(np.int64)
    keep = min(len(x), max(SCORED_LEAST, int(np.ceil(SCORED_SHARE * len(x)))))
    length = min(ORDERED, q_order.shape[1])
    out = []
    for i in range(len(q)):
        if keep < len(x):
            # footrule = constant - 2 * sum over pivots of the smaller weight, added up one inverted list at a time
            shared = np.zeros(len(x), dtype=np.uint16)
            for place in range(length):
                shared += np.minimum(w[q_order[i, place]], np.uint8(ORDERED - place))
            chosen = np.argpartition(-shared.astype(np.int32), keep - 1)[:keep]
        else:
            chosen = np.arange(len(x))
        s = (x[chosen] @ q[i]) / x_norm[chosen]
        best = chosen[np.argpartition(-s, min(len(s), 3 * k) - 1)[: 3 * k]]
        exact = (x[best] * q[i]).sum(axis=1) / (np.sqrt((x[best] ** 2).sum(axis=1)) * np.sqrt((q[i] ** 2).sum()))
        out.append((np.full(len(best), i), best, exact))
    i, best, s = (np.concatenate(c) for c in zip(*out, strict=True))
    return pd.DataFrame(
        {
            "q1": visits.h1.to_numpy()[i], "q2": visits.h2.to_numpy()[i], "h1": files.h1.to_numpy()[best],
            "h2": files.h2.to_numpy()[best], "score": s, "ids": files.ids.to_numpy()[best],
        }
    )


def nearest(rows: DataFrame, queries, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the usable rows that fulfil ``queries``, a condition on id.

    Candidates are all rows but the query's own; largest cosine first, ties to the smaller id; all candidates if
    there are fewer than k. Rows that repeat an id and a vector count once; an empty table gives no rows.
    """
    rows = checkpointed(rows)
    spark = rows.sparkSession
    distinct = checkpointed(classes(rows, k))
    chosen = distinct.orderBy(hash_order(F.struct("h1", "h2"), "pivots"), "h1", "h2").limit(pivots).select("v").toPandas()  # bounded sample
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(chosen):
        return spark.createDataFrame([], schema)
    p = np.stack(chosen.v.to_numpy())
    index = checkpointed(ordered(distinct, p / np.linalg.norm(p, axis=1, keepdims=True)))

    asked = rows.filter(queries).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"))
    asked = checkpointed(asked.distinct())
    searched = index.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v", "near")

    posted = index.select("h1", "h2", "v", "ids", "near", F.explode(F.slice("near", 1, POSTED)).alias("pivot"))
    held = {r.pivot: r.n for r in posted.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per pivot
    sizes = F.array(*[F.lit(held.get(i, 0)).cast("long") for i in range(len(chosen))])
    # files are visited in order, at least VISITED of them and until they hold LEAST_POSTINGS entries
    walk = searched.select("h1", "h2", "v", "near", F.posexplode("near").alias("place", "pivot"), sizes.alias("sizes"))
    before = F.expr("aggregate(slice(near, 1, place), 0L, (a, x) -> a + sizes[x])")
    walk = checkpointed(walk.filter((F.col("place") < VISITED) | (before < LEAST_POSTINGS)).drop("sizes", "place"))
    met = {r.pivot: r.n for r in walk.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}

    def blocks(counts, size):
        return F.array(*[F.lit(-(-counts.get(i, 0) // size) or 1).cast("int") for i in range(len(chosen))])

    of = F.col("pivot").cast("int")
    spread = posted.withColumns({"fb": F.expr("pmod(h1, 1000000007L)"), "nf": F.get(blocks(held, FILE_BLOCK), of), "nv": F.get(blocks(met, VISIT_BLOCK), of)})
    files = spread.select("h1", "h2", "v", "ids", "near", "pivot", F.expr("pmod(fb, nf)").alias("fb"), F.explode(F.expr("sequence(0L, nv - 1L)")).alias("vb"))
    turned = walk.withColumns({"vb": F.expr("pmod(h2, 1000000007L)"), "nf": F.get(blocks(held, FILE_BLOCK), of), "nv": F.get(blocks(met, VISIT_BLOCK), of)})
    visits = turned.select("h1", "h2", "v", "near", "pivot", F.explode(F.expr("sequence(0L, nf - 1L)")).alias("fb"), F.expr("pmod(vb, nv)").alias("vb"))
    keys = ["pivot", "fb", "vb"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search(left, right, k)

    found = files.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(run, "q1 long, q2 long, h1 long, h2 long, score double, ids array<long>")
    once = found.groupBy("q1", "q2", "h1", "h2").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    single = once.select("q1", "q2", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    top = single.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    lists = top.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    own = asked.join(lists, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")))
    kept = own.withColumn("best", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k))
    return kept.select("query_id", F.posexplode("best").alias("place", "b")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")
    )


def op9_nearest(embeddings: DataFrame) -> DataFrame:
    """Contract rows: the five nearest of every vector whose id is divisible by 50."""
    return nearest(usable(embeddings), F.col("id") % 50 == 0)
