"""Spatial operators on points taken from the embeddings table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripspark.operators import clean, spatial
from tripspark.plans.registry import query

LIMIT = 0.02

_POINTS = {
    "pts": "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings",
    "pt_pairs": f"SELECT a.vec_id AS a, b.vec_id AS b FROM pts AS a JOIN pts AS b ON a.vec_id <> b.vec_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < {LIMIT}",
    "pt_dist": "SELECT p.vec_id, p.label, min(sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2))) AS dist FROM pts AS p CROSS JOIN (SELECT x, y FROM pts WHERE label = 0) AS s GROUP BY ALL",
    "zone_xy": "SELECT zone, grp, 200 * x AS x, 200 * y AS y FROM dim_zone JOIN pts ON zone = vec_id + 1",
    "zone_dist": "SELECT z.zone, min(sqrt(pow(z.x - s.x, 2) + pow(z.y - s.y, 2))) AS dist_km FROM zone_xy AS z CROSS JOIN (SELECT x, y FROM zone_xy WHERE grp = 'CRZ') AS s GROUP BY ALL",
}


def points(t):
    e = t.table("embeddings")
    return e.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def zone_points(t):
    """Zone coordinates in km: the first two embedding components, stretched."""
    p = points(t).select((F.col("vec_id") + 1).alias("zone"), (200 * F.col("x")).alias("x"), (200 * F.col("y")).alias("y"))
    return t.dim_zone.select(F.col("zone").cast("long").alias("zone"), "grp").join(p, "zone")


def zone_distance(t):
    z = zone_points(t)
    d = spatial.nearest_target(z, "zone", z.where("grp = 'CRZ'"), 5.0)
    return d.select(F.col("zone").cast("int").alias("zone"), F.col("dist").alias("dist_km"))


@query("adjacency_within", "SELECT a, b FROM pt_pairs", "", _POINTS)
def adjacency_within(t):
    """Edges in both directions between points closer than a limit."""
    return spatial.adjacency(points(t), "vec_id", LIMIT)


@query(
    "neighbour_counts",
    "SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_neighbors FROM pts LEFT JOIN (SELECT a, count(*) AS n FROM pt_pairs GROUP BY a) ON vec_id = a",
    "",
    _POINTS,
)
def neighbour_counts(t):
    """Number of neighbours of each point."""
    p = points(t)
    return spatial.neighbour_counts(p, spatial.adjacency(p, "vec_id", LIMIT), "vec_id")


_RING_SQL = "SELECT vec_id, 0 AS ring FROM pts WHERE label = 0"
_RINGS = dict(_POINTS)
_RINGS["r0"] = _RING_SQL
for _k in range(1, 6):
    _RINGS[f"r{_k}"] = (
        f"SELECT vec_id, ring FROM r{_k - 1} UNION SELECT DISTINCT b, {_k} FROM pt_pairs JOIN r{_k - 1} ON a = vec_id AND ring = {_k - 1}"
        f" WHERE b NOT IN (SELECT vec_id FROM r{_k - 1})"
    )


@query("adjacency_rings", "SELECT p.vec_id, CAST(ring AS INTEGER) AS ring FROM pts AS p LEFT JOIN r5 ON p.vec_id = r5.vec_id", "ring:0", _RINGS)
def adjacency_rings(t):
    """Steps from the seed set along adjacency edges, up to five."""
    p = points(t)
    return spatial.rings_within(p, "vec_id", LIMIT, F.col("label") == 0)


@query("distance_to_set", "SELECT vec_id, dist FROM pt_dist", "dist", _POINTS)
def distance_to_set(t):
    """Distance from each point to the nearest point of a target set."""
    p = points(t)
    return spatial.nearest_target(p, "vec_id", p.where("label = 0"), LIMIT)


_BANDS = """CASE WHEN grp = 'CRZ' THEN 'CRZ' WHEN grp = 'CRZ_PARTIAL' THEN 'CRZ_PARTIAL' WHEN dist_km <= 1 THEN '0-1 km' WHEN dist_km <= 2.5 THEN '1-2.5 km'
    WHEN dist_km <= 5 THEN '2.5-5 km' WHEN dist_km <= 10 THEN '5-10 km' ELSE '>10 km' END"""


@query(
    "distance_bands",
    f"SELECT {_BANDS} AS band, CAST(sum(n) AS BIGINT) AS n FROM zone_day_pu JOIN dim_zone USING (zone) JOIN zone_dist USING (zone) GROUP BY 1",
    "",
    _POINTS,
)
def distance_bands(t):
    """Trips per band of distance to the treated zones."""
    zones = t.dim_zone.join(zone_distance(t), "zone").select("zone", clean.distance_band("dist_km", "grp").alias("band"))
    return t.gold("zone_day_pu").join(zones, "zone").groupBy("band").agg(F.sum("n").alias("n"))


_POLY = {
    "poly": """SELECT label AS zone, x, y, row_number() OVER (PARTITION BY label ORDER BY atan2(y - my, x - mx), vec_id) AS ord FROM
        (SELECT *, avg(x) OVER (PARTITION BY label) AS mx, avg(y) OVER (PARTITION BY label) AS my FROM pts)""",
    "poly_next": "SELECT zone, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM poly WINDOW w AS (PARTITION BY zone ORDER BY ord)",
    "poly_sum": "SELECT zone, sum(x * ny - nx * y) / 2 AS a, sum((x + nx) * (x * ny - nx * y)) / 6 AS mx, sum((y + ny) * (x * ny - nx * y)) / 6 AS my FROM poly_next GROUP BY zone",
}


@query(
    "polygon_area_centroid",
    "SELECT zone, abs(a) AS area, mx / nullif(a, 0) AS cx, my / nullif(a, 0) AS cy FROM poly_sum",
    "area cx cy",
    {**_POINTS, **_POLY},
)
def polygon_area_centroid(t):
    """Area and centroid of the polygons spanned by each label's points, ordered by angle."""
    return spatial.polygon_measures(label_polygons(t))


def label_polygons(t):
    """The points of each label as a ring, ordered by angle around their mean."""
    p = points(t).withColumn("zone", F.col("label"))
    mid = p.groupBy("zone").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    order = Window.partitionBy("zone").orderBy(F.atan2(F.col("y") - F.col("my"), F.col("x") - F.col("mx")), "vec_id")
    return p.join(mid, "zone").withColumn("ord", F.row_number().over(order)).withColumn("part", F.lit(0))


@query(
    "outline_depth",
    """SELECT vec_id, min(sqrt(pow(px - ax - along * dx, 2) + pow(py - ay - along * dy, 2))) AS dist FROM (
         SELECT vec_id, p.x AS px, p.y AS py, s.x AS ax, s.y AS ay, nx - s.x AS dx, ny - s.y AS dy,
           least(greatest(coalesce(((p.x - s.x) * (nx - s.x) + (p.y - s.y) * (ny - s.y)) / nullif(pow(nx - s.x, 2) + pow(ny - s.y, 2), 0), 0), 0), 1) AS along
         FROM pts AS p CROSS JOIN (SELECT * FROM poly_next WHERE zone = 0) AS s WHERE p.label <> 0) GROUP BY vec_id""",
    "dist",
    {**_POINTS, **_POLY},
)
def outline_depth(t):
    """Distance of every point of the other labels to the outline of the treated one."""
    ring = label_polygons(t).where("zone = 0")
    return spatial.distance_to_sides(points(t).where("label <> 0"), "vec_id", spatial.outline(ring), LIMIT)
