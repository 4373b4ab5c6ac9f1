"""Points in polygons, and areas.

A boundary table has ``code``, ``name`` and ``rings``: array of rings, each an array of (x, y), closed or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweave.functions.geometry import albers, inside, signed_area

EDGE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def ring_edges(ring: Column) -> Column:
    """The edges of a ring; a ring that is not closed is closed."""
    n = F.size(ring)
    turned = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    both = F.zip_with(ring, turned, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return F.filter(both, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def with_edges(boundaries: DataFrame) -> DataFrame:
    """``code, name, pos, edges`` and the bounding box; areas without a geometry are left out.

    ``pos`` ranks the areas by code, so the first of several matches is the same in every run.
    """
    edges = F.flatten(F.transform("rings", ring_edges)).cast(EDGE)
    df = boundaries.where(F.col("rings").isNotNull()).select("code", "name", edges.alias("edges")).where(F.size("edges") > 0)
    ends = lambda k: F.transform("edges", lambda e: e[k])
    return df.select("code", "name", "edges", F.array_min(ends("x1")).alias("x_min"), F.array_max(ends("x1")).alias("x_max"), F.array_min(ends("y1")).alias("y_min"), F.array_max(ends("y1")).alias("y_max"))


def grid(df: DataFrame, cell: float) -> DataFrame:
    """A row for each grid cell that a bounding box touches, with the edges whose height range meets the cell's row.

    A ray to the right of a point crosses only edges at its height, so the rest of a large outline stays behind.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("long")
    df = df.withColumn("cy", F.explode(F.sequence(at("y_min"), at("y_max"))))
    low, high = F.col("cy") * F.lit(cell), (F.col("cy") + 1) * F.lit(cell)
    near = F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= low) & (F.least(e["y1"], e["y2"]) <= high))
    return df.withColumn("edges", near).withColumn("cx", F.explode(F.sequence(at("x_min"), at("x_max"))))


def candidates(points: DataFrame, boundaries: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Points with the areas whose bounding box holds them, by an equi-join on grid cells."""
    cells = grid(with_edges(boundaries), cell).withColumnRenamed("name", "area_name").withColumnRenamed("code", "area_code")
    at = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("long")
    keyed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("cx", at(x)).withColumn("cy", at(y))
    return keyed.join(cells, ["cx", "cy"]).where(F.col(x).between(F.col("x_min"), F.col("x_max")) & F.col(y).between(F.col("y_min"), F.col("y_max")))


def points_in_areas(points: DataFrame, boundaries: DataFrame, key: str, x: str, y: str, cell: float = 0.25) -> DataFrame:
    """``key, area_code, area_name``: the area that each point is within; a point on an edge is within none.

    Exact tests run where the join leaves the rows; of overlapping areas the least code is taken. Points without an
    area have no row (join back from the left).
    """
    hits = candidates(points, boundaries, x, y, cell).where(inside(F.col(x), F.col(y), F.col("edges")))
    return hits.groupBy(key).agg(F.min(F.struct("area_code", "area_name")).alias("hit")).select(key, "hit.area_code", "hit.area_name")


def areas(boundaries: DataFrame, project: bool = True) -> DataFrame:
    """``code, area``: in km2 from geodetic degrees, or in square units of plane coordinates.

    Rings run one way outside and the other way inside, so the absolute value of the signed sum is the area.
    """
    if project:
        boundaries = planar(boundaries)
    size = F.abs(signed_area(F.col("edges")))
    return with_edges(boundaries).select("code", (size / 1e6 if project else size).alias("area"))


def planar(boundaries: DataFrame) -> DataFrame:
    """Boundaries in degrees as boundaries in metres of the equal-area plane."""
    to = lambda p: F.struct(albers(p["x"], p["y"])[0].alias("x"), albers(p["x"], p["y"])[1].alias("y"))
    return boundaries.withColumn("rings", F.transform("rings", lambda r: F.transform(r, to)))
