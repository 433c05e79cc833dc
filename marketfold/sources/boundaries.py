"""Neighborhood boundary table: attributes, vertices and rings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import scan
from ..operators.spatial import NEW_YORK_LONG_ISLAND_FEET, ConicProjection, reproject_vertices
from .sinks import stage

# Attribute columns of the boundary table.
ATTRIBUTES = {
    "borocode": "int", "boroname": "string", "countyfips": "string", "nta2020": "string", "ntaname": "string",
    "ntaabbrev": "string", "ntatype": "string", "cdta2020": "string", "cdtaname": "string",
    "shape_leng": "double", "shape_area": "double",
}


def load_boundaries(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """Boundary attributes from an ordinary table; geometry is loaded as vertices."""
    schema = ", ".join(f"{c} {kind}" for c, kind in ATTRIBUTES.items())
    return spark.read.format(fmt).schema(schema).options(**{"header": True, **options} if fmt == "csv" else options
                                                         ).load(path)


def nta_attributes(df: DataFrame) -> DataFrame:
    """The boundary attributes, in order and typed; numbers padded with blanks are accepted."""
    return df.select(*[
        (F.trim(F.col(c).cast("string")) if kind != "string" else F.rtrim(F.col(c))).try_cast(kind).alias(c)
        for c, kind in ATTRIBUTES.items()])


def assemble_edges(vertices: DataFrame, area: str, ring: Sequence[str], order: str, x: str, y: str,
                   out: str = "edges") -> DataFrame:
    """Vertex rows to one array of edges per area: all its rings, the outer ones of each part and the holes.

    ``ring`` names the columns that tell the rings of an area apart. Neighbours are found by a segmented
    scan, so no ring is gathered to be sorted. A ring is closed by an edge to its first vertex;
    where the data repeat that vertex, the edge has no length and is left out, as are all such
    edges. Vertices without a coordinate are left out, and rings with fewer than three edges.
    """
    keys = [area, *ring]
    known = vertices.dropna(subset=[x, y]).select(*keys, order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    along = scan(known.withColumn("_at", F.struct("_x", "_y")), keys, [order, "_x", "_y"], following={"_next": "_at"}, first={"_first": "_at"})
    end = F.coalesce("_next", "_first")
    sides = along.select(*keys, F.struct(
        F.col("_x").alias("x1"), F.col("_y").alias("y1"), end["_x"].alias("x2"), end["_y"].alias("y2")).alias("_edge"))
    real = sides.where((F.col("_edge.x1") != F.col("_edge.x2")) | (F.col("_edge.y1") != F.col("_edge.y2")))
    rings = real.groupBy(*keys).agg(F.collect_list("_edge").alias("_ring")).where(F.size("_ring") > 2)
    return rings.groupBy(area).agg(F.flatten(F.collect_list("_ring")).alias(out))


def boundary_polygons(attributes: DataFrame, vertices: DataFrame, key: str = "nta2020", ring: Sequence[str] = ("part", "ring"),
                      order: str = "corner", x: str = "x", y: str = "y",
                      projection: ConicProjection = NEW_YORK_LONG_ISLAND_FEET) -> DataFrame:
    """Boundary attributes with edges in longitude and latitude, from projected vertices: what ``locate`` takes."""
    # Written once: the long formulas would else be copied into each column derived from them.
    placed = stage(reproject_vertices(vertices, x, y, projection, "lon", "lat").select(key, *ring, order, "lon", "lat"), "vertices")
    return nta_attributes(attributes).join(assemble_edges(placed, key, ring, order, "lon", "lat"), key)
