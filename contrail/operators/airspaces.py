"""Points in polygons by a grid cover of each area: interior cells answer alone, only points in border cells look at edges.

An area is (key, rings): rings are arrays of (x, y) structs, x the longitude from -180 to 180, outer rings and holes of one or more polygons in
any order and orientation, closed or not. Inside is by the even-odd rule over all rings, so a hole needs no owner here. Areas over the antimeridian
come in two parts, as published shapes do. Null, empty and flat rings contain nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_polygon, signed_area

#: Cells along the longer side of an area's box; with it the size of a cover is bounded however large the area is.
ACROSS = 64
#: Degrees by which border cells are widened: far above the error of a clipped edge, far below any cell.
MARGIN = 1e-9


def edges(areas: DataFrame, key: str) -> DataFrame:
    """(key, level, e): the edges of each area, with the level of its cells (sides of 2 ** level degrees)."""
    ring = areas.select(key, F.posexplode("rings").alias("__k", "__ring")).filter(F.size("__ring") > 2)
    following = F.concat(F.slice("__ring", 2, F.size("__ring")), F.slice("__ring", 1, 1))
    pairs = F.zip_with("__ring", following, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    single = ring.select(key, F.explode(pairs).alias("e"))
    side = lambda k: F.max(F.greatest(f"e.{k}1", f"e.{k}2")) - F.min(F.least(f"e.{k}1", f"e.{k}2"))
    level = F.ceil(F.log2(F.greatest(side("x"), side("y"), F.lit(1e-6)) / ACROSS)).cast("int")
    return single.join(single.groupBy(key).agg(level.alias("level")), key)


def _side(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _crossings(found: Column, x: Column, y: Column) -> Column:
    """Edges right of the point that its level crosses."""
    right = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return F.size(F.filter(found, right))


def cover(areas: DataFrame, key: str) -> DataFrame:
    """(level, row, column, key, found): the cells that an area touches. ``found`` is null where the whole cell is inside; elsewhere it has the edges
    that decide for its points: those of the row that do not lie wholly to the left. What is gathered is one row of cells of one area."""
    side = _side(F.col("level"))
    e = {k: F.col(f"e.{k}") for k in ("x1", "y1", "x2", "y2")}
    low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    rows = edges(areas, key).withColumn("row", F.explode(F.sequence(F.floor(low / side), F.floor(high / side))))
    slope = (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
    at = lambda y: e["x1"] + (F.least(F.greatest(y, low), high) - e["y1"]) * slope
    # x of the edge where it enters and leaves the row; an edge along the row touches all cells between its ends
    enters, leaves = F.coalesce(at(F.col("row") * side), e["x1"]), F.coalesce(at((F.col("row") + 1) * side), e["x2"])
    part = F.struct(
        "e.*",
        F.floor((F.least(enters, leaves) - MARGIN) / side).alias("first"),
        F.floor((F.greatest(enters, leaves) + MARGIN) / side).alias("last"),
    )
    lines = rows.select(key, "level", "row", part.alias("e")).groupBy(key, "level", "row").agg(F.collect_list("e").alias("found"), F.min("e.first").alias("lo"), F.max("e.last").alias("hi"))
    cells = lines.select(key, "level", "row", "found", F.explode(F.sequence("lo", "hi")).alias("column"))
    border = F.exists("found", lambda e: F.col("column").between(e["first"], e["last"]))
    centre = (F.col("column") + 0.5) * side, (F.col("row") + 0.5) * side
    judged = cells.withColumn("border", border).filter(F.col("border") | (_crossings(F.col("found"), *centre) % 2 == 1))
    deciding = F.transform(F.filter("found", lambda e: (e["last"] >= F.col("column")) & (e["y1"] != e["y2"])), lambda e: F.struct(*(e[k].alias(k) for k in ("x1", "y1", "x2", "y2"))))
    return judged.select("level", "row", "column", key, F.when(F.col("border"), deciding).alias("found"))


def inside(points: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """Every point (lat, lon and further columns) with the key of each area that contains it.

    Points meet cells by equality, once for each level that any area has (sides are powers of two between some 1e-8 and 8 degrees, so there are
    few). Points without a position on the globe are in no area. Points must not have a column ``key``.
    """
    cells = cover(areas, key)
    levels = [r.level for r in edges(areas, key).select("level").distinct().collect()]  # 30 values at most, by the sizes of areas on a globe
    side = _side(F.col("level"))
    placed = points.filter("abs(lat) <= 90 AND abs(lon) <= 180").withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    placed = placed.withColumn("row", F.floor(F.col("lat") / side)).withColumn("column", F.floor(F.col("lon") / side))
    # the planner takes the cells for as small as the areas and would send them through the driver
    met = placed.join(cells.hint("merge"), ["level", "row", "column"])
    held = F.col("found").isNull() | (_crossings(F.col("found"), F.col("lon"), F.col("lat")) % 2 == 1)
    return met.filter(held).select(*points.columns, key)


def polygons(rings: DataFrame) -> DataFrame:
    """(path, record, polygon, rings) of ``sources.files.shapes``: each outer ring, first, with the holes inside it, in their order.

    A hole goes to the smallest outer ring of its record that holds its first point; one that lies in none stands for itself. ``polygon`` is the number of the outer ring.
    """
    one = rings.withColumn("size", F.abs(signed_area(F.col("points"))))
    outer = one.filter("outer").select("path", "record", F.col("ring").alias("polygon"), "size", F.col("points").alias("around"))
    holes = one.filter("NOT outer").select("path", "record", "ring", "points")
    start = F.get("points", F.lit(0))
    owned = holes.join(outer, ["path", "record"]).filter(in_polygon(start["x"], start["y"], F.col("around"))).groupBy("path", "record", "ring").agg(F.min_by("polygon", F.struct("size", "polygon")).alias("polygon"))
    placed = holes.join(owned, ["path", "record", "ring"], "left").select("path", "record", F.coalesce("polygon", "ring").alias("polygon"), "ring", "points")
    every = placed.unionByName(outer.select("path", "record", "polygon", F.col("polygon").alias("ring"), F.col("around").alias("points")))
    inner = F.col("ring") != F.col("polygon")
    grouped = every.groupBy("path", "record", "polygon").agg(F.array_sort(F.collect_list(F.struct(inner.alias("inner"), "ring", "points"))).alias("r"))
    return grouped.select("path", "record", "polygon", F.transform("r", lambda r: r["points"]).alias("rings"))
