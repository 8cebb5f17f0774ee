"""A hierarchical latitude/longitude grid in place of hexagons.

Cells of resolution r are squares of ``BASE_DEGREES / 2 ** r``; ids are longs that hold the resolution, row and
column, and order by resolution first. Any other cell function with the same signature can be passed to the
coverage operators.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_DEGREES = 16.0
_ROWS = 1 << 26


def cell_size(res: Column | int) -> Column:
    return F.lit(BASE_DEGREES) / F.pow(F.lit(2.0), res if isinstance(res, Column) else F.lit(res))


def cell_id(lat: Column, lon: Column, res: Column | int) -> Column:
    res = res if isinstance(res, Column) else F.lit(res)
    size = cell_size(res)
    row, column = F.floor((lat + 90) / size).cast("long"), F.floor((lon + 180) / size).cast("long")
    return (res.cast("long") * _ROWS + row) * _ROWS + column


def cell_parts(cell: Column) -> dict[str, Column]:
    """Resolution, and the south-west corner."""
    res = F.floor(cell / (_ROWS * _ROWS)).cast("int")
    row, column = (F.floor(cell / _ROWS) % _ROWS).cast("double"), (cell % _ROWS).cast("double")
    return {"res": res, "south": row * cell_size(res) - 90, "west": column * cell_size(res) - 180}


def cell_boundary(cell: Column) -> Column:
    """Closed ring of [lng, lat]."""
    p = cell_parts(cell)
    s, w, size = p["south"], p["west"], cell_size(p["res"])
    corner = lambda x, y: F.array(x, y)
    return F.array(corner(w, s), corner(w + size, s), corner(w + size, s + size), corner(w, s + size), corner(w, s))


def cells_of_box(south: float, west: float, north: float, east: float, res: int) -> Column:
    """Ids of all cells whose centre lies in the box (array); antimeridian boxes are split first."""
    size = BASE_DEGREES / 2**res

    def span(lo: float, hi: float, base: float) -> Column:
        import math

        first, last = math.ceil((lo + base) / size - 0.5), math.floor((hi + base) / size - 0.5)
        return F.sequence(F.lit(first), F.lit(last)) if last >= first else F.array().cast("array<int>")

    rows = span(south, north, 90)
    columns = span(west, east, 180) if west <= east else F.concat(span(west, 180, 180), span(-180, east, 180))
    one = lambda r, c: (F.lit(res).cast("long") * _ROWS + r.cast("long")) * _ROWS + c.cast("long")
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: one(r, c))))
