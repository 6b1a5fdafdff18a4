"""Distance joins, adjacency, rings and polygon measures on vertex tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripspark.session import checkpointed


def _cells(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"_cx": F.floor(F.col("x") / size).cast("long"), "_cy": F.floor(F.col("y") / size).cast("long")})


def _spread(df: DataFrame) -> DataFrame:
    """The row once for its own grid cell and once for each of the eight around it."""
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("dx"), F.lit(j).cast("long").alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    out = df.withColumn("_s", F.explode(steps))
    return out.withColumns({"_cx": F.col("_cx") + F.col("_s.dx"), "_cy": F.col("_cy") + F.col("_s.dy")}).drop("_s")


def pairs_within(points: DataFrame, key: str, limit: float, both_directions: bool = False) -> DataFrame:
    """Pairs of points closer than ``limit``: (a, b, dist).

    Points meet only in the same or a neighbouring grid cell of side ``limit``: an equi-join on the
    cell, which Spark partitions and whose skewed cells adaptive execution splits.
    """
    grid = _cells(points.select(F.col(key).alias("k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), limit)
    left = grid.select(F.col("k").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "_cx", "_cy")
    right = _spread(grid).select(F.col("k").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "_cx", "_cy")
    order = F.col("a") != F.col("b") if both_directions else F.col("a") < F.col("b")
    joined = left.join(right, ["_cx", "_cy"]).where(order)
    dist = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return joined.select("a", "b", dist.alias("dist")).where(F.col("dist") < limit)


def adjacency(points: DataFrame, key: str, limit: float) -> DataFrame:
    """Directed edges in both directions between points closer than ``limit``."""
    one = pairs_within(points, key, limit).select("a", "b")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))


def neighbour_counts(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    counts = edges.groupBy(F.col("a").alias(key)).agg(F.count(F.lit(1)).alias("n_neighbors"))
    return nodes.select(key).join(counts, key, "left").fillna(0, ["n_neighbors"])


def rings(nodes: DataFrame, edges: DataFrame, key: str, is_seed: Column, max_ring: int = 5) -> DataFrame:
    """Number of steps from the seed set, up to ``max_ring``, NULL beyond: one aggregate per ring.

    ``max_ring`` is a parameter of the measure: nodes farther away have no ring.
    Each round keeps one row per node reached, so the work is edges × rounds and never all paths.
    """
    edges = checkpointed(edges)
    reached = nodes.where(is_seed).select(F.col(key).alias("v"), F.lit(0).alias("ring"))
    for step in range(1, max_ring + 1):
        frontier = reached.where(F.col("ring") == step - 1)
        nxt = edges.join(frontier, edges["a"] == frontier["v"], "left_semi").select(F.col("b").alias("v"), F.lit(step).alias("ring"))
        reached = checkpointed(reached.unionByName(nxt).groupBy("v").agg(F.min("ring").alias("ring")))
    return nodes.select(key).join(reached, F.col(key) == F.col("v"), "left").select(key, "ring")


def rings_within(points: DataFrame, key: str, limit: float, is_seed: Column, max_ring: int = 5) -> DataFrame:
    """`rings` over the pairs closer than ``limit``, without a table of them: crowded points have very many pairs.

    In each round the points still open look for one point of the last ring in their own and the eight cells around:
    a semi-join on the cell, so points are moved and pairs are not.
    """
    x, y = F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")
    grid = checkpointed(_cells(points.select(F.col(key).alias("v"), x, y, is_seed.alias("seed")), limit))
    reached = checkpointed(grid.where("seed").select("v", F.lit(0).alias("ring")).distinct())
    for step in range(1, max_ring + 1):
        last = grid.join(reached.where(F.col("ring") == step - 1).select("v"), "v", "left_semi")
        near = _spread(last.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("_cx").alias("_cx"), F.col("_cy").alias("_cy")))
        near = near.select("ax", "ay", F.col("_cx").alias("_nx"), F.col("_cy").alias("_ny"))
        left = grid.join(reached.select("v"), "v", "left_anti")
        met = (F.col("_cx") == F.col("_nx")) & (F.col("_cy") == F.col("_ny"))
        close = F.sqrt(F.pow(F.col("x") - F.col("ax"), 2) + F.pow(F.col("y") - F.col("ay"), 2)) < limit
        nxt = checkpointed(left.join(near, met & close, "left_semi").select("v").distinct().withColumn("ring", F.lit(step)))
        if nxt.isEmpty():
            break
        reached = reached.unionByName(nxt)
    found = reached.withColumnRenamed("v", "_v")
    return points.select(key).join(found, F.col(key) == F.col("_v"), "left").select(key, "ring")


def polygon_measures(vertices: DataFrame, unit: str = "zone", part: str = "part", order: str = "ord", scale: float = 1.0) -> DataFrame:
    """Area and centroid of each unit's polygons from ordered vertices (shoelace), in scaled units."""
    ring = Window.partitionBy(unit, part)
    nxt = ring.orderBy(order)
    first = F.first(F.struct("x", "y")).over(nxt.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = F.coalesce(F.lead(F.struct("x", "y")).over(nxt), first)
    v = vertices.select(unit, part, order, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("n", following)
    cross = F.col("x") * F.col("n.y") - F.col("n.x") * F.col("y")
    per_part = v.groupBy(unit, part).agg(
        (F.sum(cross) / 2).alias("a"),
        (F.sum((F.col("x") + F.col("n.x")) * cross) / 6).alias("mx"),
        (F.sum((F.col("y") + F.col("n.y")) * cross) / 6).alias("my"),
    )
    s = F.signum("a")
    total = per_part.groupBy(unit).agg(F.sum(s * F.col("a")).alias("area"), F.sum(s * F.col("mx")).alias("mx"), F.sum(s * F.col("my")).alias("my"))
    return total.select(
        unit,
        (F.col("area") * scale * scale).alias("area"),
        (F.try_divide("mx", "area") * scale).alias("cx"),
        (F.try_divide("my", "area") * scale).alias("cy"),
    )


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    at = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, length), F.lit(0.0))
    at = F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(px - ax - at * dx, 2) + F.pow(py - ay - at * dy, 2))


def nearest_target(points: DataFrame, key: str, targets: DataFrame, step: float) -> DataFrame:
    """Distance from each point to the nearest target point: (key, dist).

    NULL without targets, and for points with a missing or non-finite coordinate; such targets are left out.
    Points that find a target no farther than the grid cell are done; the others try cells twice as
    wide. Every round is an equi-join on cells, and the points still open are written between rounds,
    so the number of rounds is the logarithm of the largest distance.
    """
    usable = F.greatest(F.abs("x"), F.abs("y")) < float("inf")  # a comparison with NULL is not true, and NaN is the greatest
    usable = usable & F.col("x").isNotNull() & F.col("y").isNotNull()
    todo = points.select(F.col(key).alias("a"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(usable)
    goal = targets.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(usable)
    found = None
    size = step
    while not goal.isEmpty():
        near = _spread(_cells(goal, size)).select(F.col("x").alias("bx"), F.col("y").alias("by"), "_cx", "_cy")
        d = F.sqrt(F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2))
        hit = checkpointed(_cells(todo, size).join(near, ["_cx", "_cy"]).groupBy("a").agg(F.min(d).alias("dist")).where(F.col("dist") <= size))
        found = hit if found is None else found.unionByName(hit)
        todo = checkpointed(todo.join(hit, "a", "left_anti"))
        if todo.isEmpty():
            break
        size *= 2
    if found is None:
        return points.select(key, F.lit(None).cast("double").alias("dist"))
    return points.select(key).join(found, F.col(key) == F.col("a"), "left").select(key, "dist")


def outline(vertices: DataFrame, part: str = "part", order: str = "ord") -> DataFrame:
    """(ax, ay, bx, by): the sides of closed rings of ordered vertices."""
    ring = Window.partitionBy(part).orderBy(order)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here, first = F.struct("x", "y"), F.first(F.struct("x", "y")).over(whole)
    sides = vertices.select("x", "y", F.coalesce(F.lead(here).over(ring), first).alias("n"))
    return sides.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("n.x").alias("bx"), F.col("n.y").alias("by"))


def _side_cells(sides: DataFrame, size: float) -> DataFrame:
    """Each side once for every grid cell that it passes: it is cut into pieces no longer than a cell."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = F.ceil(F.sqrt(dx * dx + dy * dy) / size).cast("int")
    pieces = sides.withColumn("_n", F.greatest(n, F.lit(1))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    ends = [((F.col(a) + d * F.col("_i") / F.col("_n")) / size, (F.col(a) + d * (F.col("_i") + 1) / F.col("_n")) / size) for a, d in (("ax", dx), ("ay", dy))]
    for name, (one, two) in zip(("_cx", "_cy"), ends, strict=True):
        low, high = F.floor(F.least(one, two)).cast("long"), F.floor(F.greatest(one, two)).cast("long")
        pieces = pieces.withColumn(name, F.explode(F.sequence(low, high)))
    return pieces.select("ax", "ay", "bx", "by", "_cx", "_cy").distinct()


def distance_to_sides(points: DataFrame, key: str, sides: DataFrame, step: float) -> DataFrame:
    """Distance from each point to the nearest side: (key, dist); inside an outline this is the depth.

    As in `nearest_target`, points that find a side within a cell are done and the others try cells twice as wide; a
    side meets only points near the cells that it passes. NULL without sides and for points with a missing coordinate.
    """
    usable = (F.greatest(F.abs("x"), F.abs("y")) < float("inf")) & F.col("x").isNotNull() & F.col("y").isNotNull()
    todo = points.select(F.col(key).alias("a"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(usable)
    sides = checkpointed(sides.select(*[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")]))
    found, size = None, step
    while not sides.isEmpty():
        near = _spread(_side_cells(sides, size)).distinct()
        d = point_segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
        hit = checkpointed(_cells(todo, size).join(near, ["_cx", "_cy"]).groupBy("a").agg(F.min(d).alias("dist")).where(F.col("dist") <= size))
        found = hit if found is None else found.unionByName(hit)
        todo = checkpointed(todo.join(hit, "a", "left_anti"))
        if todo.isEmpty():
            break
        size *= 2
    if found is None:
        return points.select(key, F.lit(None).cast("double").alias("dist"))
    return points.select(key).join(found, F.col(key) == F.col("a"), "left").select(key, "dist")
