"""Points in polygons by quadtree cells, and State Plane vertices to longitude/latitude."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage


def make_point(df: DataFrame, lon: str, lat: str, x: str = "point_lon", y: str = "point_lat") -> DataFrame:
    """Add the point as two double columns; rows without a full coordinate are dropped."""
    return df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumns(
        {x: F.col(lon).cast("double"), y: F.col(lat).cast("double")})


# A cell of level l is ROOT / 2**l degrees wide. The origin is off any round number, so that
# no vertex or point of ordinary data lies on a border between cells.
ROOT = 0.32
ORIGIN = -0.000000371294
MOST_EDGES, DEEPEST = 16, 12


def _side(level) -> Column:
    return F.lit(ROOT) / F.pow(F.lit(2.0), level)


def _flips(x, y, right, bottom, edges) -> Column:
    """How many edges lie on the way from (x, y) along +x to the right border of a cell, and down
    that border to its bottom: where that is odd, the ends of the way differ in being inside."""
    def on_the_way(e):
        straddles = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        meets = (e["x1"] > right) != (e["x2"] > right)
        height = (e["y2"] - e["y1"]) * (right - e["x1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0)) + e["y1"]
        across = (straddles & (x < at) & (right >= at)).cast("int")
        return across + (meets & (height > bottom) & (height <= y)).cast("int")
    return F.aggregate(edges, F.lit(0), lambda n, e: n + on_the_way(e))


def _touching(edges, left, bottom, side) -> Column:
    """The edges that may reach into a cell; one too many does no harm."""
    slack = side * F.lit(1e-6) + F.lit(1e-12)
    west, east, south, north = left - slack, left + side + slack, bottom - slack, bottom + side + slack

    def touches(e):
        boxes = ((F.greatest(e["x1"], e["x2"]) >= west) & (F.least(e["x1"], e["x2"]) <= east)
                 & (F.greatest(e["y1"], e["y2"]) >= south) & (F.least(e["y1"], e["y2"]) <= north))

        def beside(px, py):  # on which side of the edge's line a corner is
            return (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
        corners = [beside(px, py) for px in (west, east) for py in (south, north)]
        return boxes & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)
    return F.filter(edges, touches)


def polygon_cells(polygons: DataFrame, edges: str, attributes: Sequence[str], most: int = MOST_EDGES,
                  deepest: int = DEEPEST) -> DataFrame:
    """A quadtree of cells per polygon: attributes, level, cx, cy, inside and edges.

    ``inside`` tells whether the lower right corner of the cell is inside (0 or 1), ``edges`` has those that
    reach into the cell. Cells with more than ``most`` edges are split, down to level ``deepest``; cells
    without an edge are wholly inside, or left out. The state of a corner follows from that of the
    parent cell, so only the first cells, of about half a polygon's extent, look at all its edges.
    """
    known = polygons.filter(F.size(edges) > 0).select(*attributes, F.col(edges).alias("_all"))
    known = known.withColumns({
        f"_{end}{axis}": pick(F.transform("_all", lambda e: of_edge(e[f"{axis}1"], e[f"{axis}2"])))
        for axis in ("x", "y") for end, pick, of_edge in (("low", F.array_min, F.least), ("high", F.array_max, F.greatest))})
    extent = F.greatest(F.col("_highx") - F.col("_lowx"), F.col("_highy") - F.col("_lowy"), F.lit(1e-12))
    # A polygon begins with cells of about half its extent.
    known = known.withColumn("level", F.least(F.greatest(F.floor(F.log2(F.lit(ROOT) / extent)) + 1, F.lit(0)), F.lit(deepest)).cast("int"))
    side = _side(F.col("level"))
    for axis in ("x", "y"):
        known = known.withColumn(f"c{axis}", F.explode(F.sequence(
            F.floor((F.col(f"_low{axis}") - ORIGIN) / side), F.floor((F.col(f"_high{axis}") - ORIGIN) / side))))
    left, bottom = F.col("cx") * side + ORIGIN, F.col("cy") * side + ORIGIN
    right = (F.col("cx") + 1) * side + ORIGIN

    def beyond(e):  # a ray along +x from the corner meets the edge
        at = (e["x2"] - e["x1"]) * (bottom - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return ((e["y1"] > bottom) != (e["y2"] > bottom)) & (right < at)
    found = known.select(
        *attributes, "level", "cx", "cy", (F.size(F.filter("_all", beyond)) % 2).alias("inside"),
        _touching(F.col("_all"), left, bottom, side).alias("edges"))
    found = stage(found.filter(_useful()), "cells")
    large = (F.size("edges") > most) & (F.col("level") < deepest)
    while found.filter(large).limit(1).count():
        found = stage(_split(found, attributes, large).filter(_useful()), "cells")
    return found


def _useful() -> Column:
    return (F.size("edges") > 0) | (F.col("inside") == 1)


def _split(cells: DataFrame, attributes: Sequence[str], large: Column) -> DataFrame:
    """Large cells in quarters, the others as they are."""
    quarters = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)])
    parent_right = (F.col("cx") + 1) * _side(F.col("level")) + ORIGIN
    parent_bottom = F.col("cy") * _side(F.col("level")) + ORIGIN
    kept = cells.filter(~large).select(*attributes, "level", "cx", "cy", "inside", "edges")
    parts = cells.filter(large).withColumns({"_right": parent_right, "_bottom": parent_bottom, "_q": F.explode(quarters)})
    parts = parts.withColumns({
        "_side": _side(F.col("level") + 1), "_cx": F.col("cx") * 2 + F.col("_q.dx"), "_cy": F.col("cy") * 2 + F.col("_q.dy")})
    left, bottom = F.col("_cx") * F.col("_side") + ORIGIN, F.col("_cy") * F.col("_side") + ORIGIN
    right = (F.col("_cx") + 1) * F.col("_side") + ORIGIN
    flips = _flips(right, bottom, F.col("_right"), F.col("_bottom"), F.col("edges"))
    return kept.unionByName(parts.select(
        *attributes, (F.col("level") + 1).alias("level"), F.col("_cx").alias("cx"), F.col("_cy").alias("cy"),
        ((F.col("inside") + flips) % 2).alias("inside"), _touching(F.col("edges"), left, bottom, F.col("_side")).alias("edges")))


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, edges: str,
                       attributes: Sequence[str], most: int = MOST_EDGES) -> DataFrame:
    """Inner join of points to the polygons that hold them.

    Polygons become cells of a quadtree (``polygon_cells``). A point is looked up by cell on each level
    that occurs, a few at most, and meets at most one cell of a polygon; the few edges of that cell
    decide, and none has to where the cell is wholly inside. A polygon may have several rings and
    parts: the edges of all of them, holes included, go into one array (even-odd rule).
    """
    found = polygon_cells(polygons, edges, attributes, most)
    side = _side(F.col("level"))
    cells = found.select(
        *attributes, F.col("level").alias("_level"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.col("inside").alias("_inside"),
        F.col("edges").alias("_edges"), ((F.col("cx") + 1) * side + ORIGIN).alias("_right"), (F.col("cy") * side + ORIGIN).alias("_bottom"))
    levels = sorted(r[0] for r in cells.select("_level").distinct().collect()) or [0]
    at = F.array(*[F.struct(
        F.lit(level).alias("level"), F.floor((F.col(x) - ORIGIN) / (ROOT / 2 ** level)).alias("cx"),
        F.floor((F.col(y) - ORIGIN) / (ROOT / 2 ** level)).alias("cy")) for level in levels])
    located = points.withColumn("_at", F.explode(at))
    same = ((F.col("_at.level") == F.col("_level")) & (F.col("_at.cx") == F.col("_cx")) & (F.col("_at.cy") == F.col("_cy")))
    flips = _flips(F.col(x), F.col(y), F.col("_right"), F.col("_bottom"), F.col("_edges"))
    odd = F.when(F.size("_edges") == 0, F.lit(True)).otherwise((F.col("_inside") + flips) % 2 == 1)
    return located.join(cells, same).filter(odd).drop("_at", *[c for c in cells.columns if c not in attributes])


@dataclass(frozen=True)
class ConicProjection:
    """Lambert conformal conic with two standard parallels (degrees, metres)."""

    semi_major: float
    inverse_flattening: float
    latitude_of_origin: float
    central_meridian: float
    parallel_1: float
    parallel_2: float
    false_easting: float
    false_northing: float
    metres_per_unit: float


# NAD83 State Plane New York Long Island, US survey feet.
NEW_YORK_LONG_ISLAND_FEET = ConicProjection(
    semi_major=6378137.0,
    inverse_flattening=298.257222101,
    latitude_of_origin=40.16666666666666,
    central_meridian=-74.0,
    parallel_1=40.66666666666666,
    parallel_2=41.03333333333333,
    false_easting=984250.0,
    false_northing=0.0,
    metres_per_unit=0.3048006096012192,
)


def reproject_vertices(df: DataFrame, x: str, y: str, projection: ConicProjection = NEW_YORK_LONG_ISLAND_FEET,
                       lon: str = "lon", lat: str = "lat", iterations: int = 5) -> DataFrame:
    """Add longitude and latitude of projected vertices, as closed-form column math."""
    p = projection
    flattening = 1.0 / p.inverse_flattening
    e = math.sqrt(2 * flattening - flattening * flattening)

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)

    def t(phi: float) -> float:
        s = e * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    phi0, phi1, phi2 = (math.radians(d) for d in (p.latitude_of_origin, p.parallel_1, p.parallel_2))
    n = (math.log(m(phi1)) - math.log(m(phi2))) / (math.log(t(phi1)) - math.log(t(phi2)))
    scale = p.semi_major * m(phi1) / (n * t(phi1) ** n)
    rho0 = scale * t(phi0) ** n

    east = (F.col(x) - F.lit(p.false_easting)) * F.lit(p.metres_per_unit)
    north = F.lit(rho0) - (F.col(y) - F.lit(p.false_northing)) * F.lit(p.metres_per_unit)
    out = df.withColumns({"_east": east, "_north": north}).withColumn(
        "_t", F.pow(F.sqrt(F.col("_east") * F.col("_east") + F.col("_north") * F.col("_north")) / scale, F.lit(1.0 / n)))
    half_pi = math.pi / 2

    def nearer(phi: Column, _) -> Column:
        s = F.lit(e) * F.sin(phi)
        return half_pi - 2 * F.atan(F.col("_t") * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    # A fold instead of repeated columns: the optimizer would copy those into each other.
    start = half_pi - 2 * F.atan(F.col("_t"))
    out = out.withColumn("_phi", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, nearer))
    return out.withColumns({
        lon: F.degrees(F.atan2(F.col("_east"), F.col("_north")) / n) + F.lit(p.central_meridian),
        lat: F.degrees("_phi"),
    }).drop("_east", "_north", "_t", "_phi")
