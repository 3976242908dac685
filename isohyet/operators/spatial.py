"""Polygons as rows of edges: containment, rasters, areas, nearest units."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_geojson(features: DataFrame, geometry: str = "geometry", keys: list[str] | None = None) -> DataFrame:
    """Edges (keys, part, ring, seq, x1, y1, x2, y2) of Polygon and MultiPolygon texts; other and empty geometries give none."""
    keys = keys or ["unit_key"]
    kind = F.get_json_object(geometry, "$.type")
    coords = F.get_json_object(geometry, "$.coordinates")
    polygon, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    parts = F.when(kind == "Polygon", F.array(F.from_json(coords, polygon))).when(kind == "MultiPolygon", F.from_json(coords, many))
    rings = features.select(*keys, F.posexplode(parts).alias("part", "p")).select(*keys, "part", F.posexplode("p").alias("ring", "r"))
    points = rings.select(*keys, "part", "ring", "r", F.posexplode(F.slice("r", 1, F.greatest(F.size("r") - 1, F.lit(0)))).alias("seq", "a"))
    following = F.get("r", F.col("seq") + 1)
    return points.select(*keys, "part", "ring", "seq", F.col("a")[0].alias("x1"), F.col("a")[1].alias("y1"), following[0].alias("x2"), following[1].alias("y2"))


def area_centroid(edges: DataFrame, key: str = "unit_key") -> DataFrame:
    """Planar area (square degrees) and centroid from shoelace sums; holes count against the area by their turn."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = edges.groupBy(key).agg(F.sum(cross).alias("a2"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"))
    return sums.where("a2 <> 0").select(key, F.abs(F.col("a2") / 2).alias("area"), (F.col("sx") / (3 * F.col("a2"))).alias("cx"), (F.col("sy") / (3 * F.col("a2"))).alias("cy"))


def spherical_area_km2(edges: DataFrame, key: str = "unit_key", radius_km: float = 6371.0088) -> DataFrame:
    """Area on a sphere by line integrals of the sine of latitude; within 0.6 % of the ellipsoid's."""
    part = F.radians(F.col("x2") - F.col("x1")) * (2 + F.sin(F.radians("y1")) + F.sin(F.radians("y2")))
    return edges.groupBy(key).agg(F.abs(F.sum(part) * radius_km**2 / 2).alias("area_km2"))


# The WGS 84 ellipsoid (km, first eccentricity squared), and four-point Gauss-Legendre places and weights on [0, 1].
MAJOR_KM, E2 = 6378.137, 6.69437999014e-3
GAUSS = ((0.06943184420297371, 0.17392742256872692), (0.33000947820757187, 0.32607257743127307), (0.6699905217924281, 0.32607257743127307), (0.9305681557970262, 0.17392742256872692))


def _q(sin, log):
    """q of the authalic latitude for a sine of the geodetic one: the ellipsoid's area between equator and latitude is pi a^2 q."""
    e = math.sqrt(E2)
    return (1 - E2) * (sin / (1 - E2 * sin * sin) - log((1 - e * sin) / (1 + e * sin)) / (2 * e))


def ellipsoid_area_km2(edges: DataFrame, key: str = "unit_key") -> DataFrame:
    """Area on the WGS 84 ellipsoid, edges being straight in longitude and latitude as GeoJSON has them.

    The line integral of q over longitude, which is the sine of the authalic
    latitude but for a constant, at four Gauss places of each edge: exact to
    rounding for edges of a few degrees.
    """
    at = lambda t: F.sin(F.radians(F.col("y1") + (F.col("y2") - F.col("y1")) * t))
    mean = sum((_q(at(t), F.ln) * w for t, w in GAUSS), F.lit(0.0))
    return edges.groupBy(key).agg((F.abs(F.sum(F.radians(F.col("x2") - F.col("x1")) * mean)) * (MAJOR_KM**2 / 2)).alias("area_km2"))


#: The same over a table e of edges.
ELLIPSOID_SQL = f"""gauss(t, w) AS (VALUES {', '.join(f'({t!r}::DOUBLE, {w!r}::DOUBLE)' for t, w in GAUSS)}),
places AS (SELECT unit_key, radians(x2 - x1) * w AS dx, sin(radians(y1 + (y2 - y1) * t)) AS s FROM e, gauss),
ellipsoid_area AS (SELECT unit_key, abs(sum(dx * {1 - E2!r} * (s / (1 - {E2} * s * s) - ln((1 - {math.sqrt(E2)!r} * s) / (1 + {math.sqrt(E2)!r} * s)) / {2 * math.sqrt(E2)!r}))) * {MAJOR_KM**2 / 2!r} AS area_km2 FROM places GROUP BY ALL)"""


def bands(edges: DataFrame, size: float = 1.0) -> DataFrame:
    """Edges once for each latitude band they touch: the equi-join key of the containment test."""
    return edges.withColumn("band", F.explode(F.sequence(F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size))))


def containing(points: DataFrame, edges: DataFrame, point_key: str, key: str = "unit_key", size: float = 1.0) -> DataFrame:
    """(point, unit) of every unit that holds a point: odd crossings of a ray to the east, over edges of the point's band only."""
    p = points.select(point_key, "x", "y", F.floor(F.col("y") / size).alias("band"))
    e = bands(edges, size).select(key, "band", "x1", "y1", "x2", "y2")
    met = p.join(e, "band").where((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    right = F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return met.groupBy(point_key, key).agg((F.count_if(right) % 2).alias("odd")).where("odd = 1").select(point_key, key)


def extent(points: DataFrame, centres: DataFrame) -> float:
    """The longer side of the box around all points and centres; 0 without any."""
    both = points.select("x", "y").unionByName(centres.select(F.col("cx").alias("x"), F.col("cy").alias("y")))
    w, h = both.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    return max(w or 0.0, h or 0.0)


def nearest(points: DataFrame, centres: DataFrame, point_key: str, key: str = "unit_key", size: float = 1.0, wide: float | None = None) -> DataFrame:
    """(point, unit) of the nearest centre (cx, cy) in planar degrees, ties by name, for each point.

    One plan over a pyramid of cells, each level of twice the width of the one
    below, up to one as wide as everything (``wide``, looked for if not given).
    Occupied cells and their neighbours are marked on every level; a point's cell
    takes the lowest level on which it is marked. There a centre is nearer than
    2.83 widths, so the nine cells two levels up, of four widths each, hold the
    nearest for certain; only their centres are compared. Points of one cell are
    looked up once, joins have equi-keys.
    """
    wide = extent(points, centres) if wide is None else wide
    top = max(0, math.ceil(math.log2(max(wide, size) / size)) + 1)
    width = lambda level: F.lit(size) * F.pow(F.lit(2.0), level)
    cell = lambda v, level: F.floor(F.col(v) / width(F.col(level))).cast("long")
    around = lambda rows: rows.withColumn("di", F.explode(F.array(*[F.lit(o) for o in (-1, 0, 1)]))).withColumn("dj", F.explode(F.array(*[F.lit(o) for o in (-1, 0, 1)]))).withColumn("i", F.col("i") + F.col("di")).withColumn("j", F.col("j") + F.col("dj")).drop("di", "dj")
    upto = lambda last: F.explode(F.sequence(F.lit(0), F.lit(last))).alias("level")
    known = points.select(point_key, "x", "y").where("x is not null and y is not null").withColumn("zero", F.lit(0)).select(point_key, "x", "y", cell("x", "zero").alias("i0"), cell("y", "zero").alias("j0"))
    spread = centres.where("cx is not null and cy is not null").select(F.col(key).alias("unit__"), "cx", "cy", upto(top + 2)).select("unit__", "cx", "cy", "level", cell("cx", "level").alias("i"), cell("cy", "level").alias("j"))
    marked = around(spread.where(F.col("level") <= top).select("level", "i", "j").distinct()).distinct()
    # a cell's ancestors by halving, as floors of its own number
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    own = known.select("i0", "j0").distinct().select("i0", "j0", upto(top)).select("i0", "j0", "level", up("i0").alias("i"), up("j0").alias("j"))
    levels = own.join(marked, ["level", "i", "j"]).groupBy("i0", "j0").agg((F.min("level") + 2).alias("level"))
    asked = around(known.join(levels, ["i0", "j0"]).select(point_key, "x", "y", "level", up("i0").alias("i"), up("j0").alias("j")))
    gap = (F.col("cx") - F.col("x")) * (F.col("cx") - F.col("x")) + (F.col("cy") - F.col("y")) * (F.col("cy") - F.col("y"))
    best = asked.join(spread, ["level", "i", "j"]).groupBy(point_key).agg(F.min(F.struct(gap.alias("d"), F.col("unit__").alias("u"))).alias("m"))
    return best.select(point_key, F.col("m.u").alias(key))


def point_in_unit(points: DataFrame, edges: DataFrame, point_key: str, key: str = "unit_key", size: float = 1.0) -> DataFrame:
    """(point, unit, inside): the containing unit (the first by name), else that of the nearest centroid in planar degrees. Only points outside all units look for centroids."""
    inside = containing(points, edges, point_key, key, size).groupBy(point_key).agg(F.min(key).alias(key))
    # corners stand for centroids: no centroid is beyond them
    wide = extent(points, edges.select(F.col("x1").alias("cx"), F.col("y1").alias("cy")))
    fallback = nearest(points.join(inside, point_key, "left_anti"), area_centroid(edges, key), point_key, key, size, wide)
    return inside.withColumn("inside", F.lit(True)).unionByName(fallback.withColumn("inside", F.lit(False)))


def representative_points(edges: DataFrame, key: str = "unit_key") -> DataFrame:
    """(unit, x, y): a point inside each unit: in the middle of its widest stretch along the line half-way up its bounding box (a hair above it where that line meets a corner)."""
    box = edges.groupBy(key).agg(F.min(F.least("y1", "y2")).alias("low"), F.max(F.greatest("y1", "y2")).alias("high"))
    y = F.col("low") + (F.col("high") - F.col("low")) * 0.5000001
    line = edges.join(box.select(key, y.alias("y")), key).where((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    x = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    cuts = line.groupBy(key, "y").agg(F.sort_array(F.collect_list(x)).alias("xs"))
    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.size("xs") - 2, F.lit(0)), F.lit(2)), lambda i: F.struct((F.get("xs", i + 1) - F.get("xs", i)).alias("w"), ((F.get("xs", i) + F.get("xs", i + 1)) / 2).alias("x")))
    return cuts.where(F.size("xs") >= 2).select(key, F.array_max(spans)["x"].alias("x"), "y")


def rasterize_units(cells: DataFrame, edges: DataFrame, step: float, cell_key: str = "cell_id", key: str = "unit_key") -> DataFrame:
    """(unit, cell) of cells that a unit touches: a cell whose centre (x, y) is inside, or through which an edge runs.

    An edge meets candidate cells by column and row numbers, so both tests have
    equi-join keys; an edge is then clipped to the cell (Liang and Barsky).
    """
    if step <= 0:
        raise ValueError("cells must be of positive size: coordinates have to ascend")
    half = step / 2
    by_centre = containing(cells, edges, cell_key, key, step)
    number = lambda v: F.floor(F.col(v) / step)
    near = (
        edges.withColumn("col", F.explode(F.sequence(F.floor((F.least("x1", "x2")) / step) - 1, F.floor(F.greatest("x1", "x2") / step) + 1)))
        .withColumn("row", F.explode(F.sequence(F.floor((F.least("y1", "y2")) / step) - 1, F.floor(F.greatest("y1", "y2") / step) + 1)))
    )
    met = cells.select(cell_key, "x", "y", number("x").alias("col"), number("y").alias("row")).join(near, ["col", "row"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    enter, leave = F.lit(0.0), F.lit(1.0)
    fits = F.lit(True)
    for d, gap in ((-dx, F.col("x1") - (F.col("x") - half)), (dx, F.col("x") + half - F.col("x1")), (-dy, F.col("y1") - (F.col("y") - half)), (dy, F.col("y") + half - F.col("y1"))):
        ratio = gap / F.nullif(d, F.lit(0.0))
        enter = F.greatest(enter, F.when(d < 0, ratio).otherwise(0.0))
        leave = F.least(leave, F.when(d > 0, ratio).otherwise(1.0))
        fits = fits & ((d != 0) | (gap >= 0))
    by_edge = met.where(fits & (enter <= leave)).select(cell_key, key)
    return by_centre.unionByName(by_edge).distinct()


def units_in_box(edges: DataFrame, west: float, south: float, east: float, north: float, key: str = "unit_key") -> DataFrame:
    """Units whose bounding box meets the box."""
    box = edges.groupBy(key).agg(F.min("x1").alias("x0"), F.max("x1").alias("x9"), F.min("y1").alias("y0"), F.max("y1").alias("y9"))
    return box.where((F.col("x0") <= east) & (F.col("x9") >= west) & (F.col("y0") <= north) & (F.col("y9") >= south)).select(key)
