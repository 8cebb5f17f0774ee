"""Points and envelopes as structs, with their text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import in_box

_NUMBER = r"(-?[0-9.]+(?:[eE]-?[0-9]+)?)"


def point(lat: Column, lon: Column) -> Column:
    """Struct (x, y); null where a coordinate is."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y")))


def x(p: Column | str) -> Column:
    return (F.col(p) if isinstance(p, str) else p)["x"]


def y(p: Column | str) -> Column:
    return (F.col(p) if isinstance(p, str) else p)["y"]


def wkt(p: Column) -> Column:
    return F.concat(F.lit("POINT("), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"), F.lit(")"))


def from_wkt(s: Column) -> Column:
    """Null for anything but a point."""
    pattern = rf"^\s*POINT\s*\(\s*{_NUMBER}\s+{_NUMBER}\s*\)\s*$"
    g = lambda i: F.regexp_extract(s, pattern, i).try_cast("double")
    return F.when(s.rlike(pattern), F.struct(g(1).alias("x"), g(2).alias("y")))


def geojson(p: Column) -> Column:
    return F.when(p.isNotNull(), F.to_json(F.struct(F.lit("Point").alias("type"), F.array(p["x"], p["y"]).alias("coordinates"))))


def from_geojson(s: Column) -> Column:
    """Null for anything but a point."""
    c = F.from_json(s, "type string, coordinates array<double>")
    return F.when((c["type"] == "Point") & (F.size(c["coordinates"]) >= 2), F.struct(F.get(c["coordinates"], F.lit(0)).alias("x"), F.get(c["coordinates"], F.lit(1)).alias("y")))


def envelope(south: float, west: float, north: float, east: float) -> tuple[float, float, float, float]:
    if south > north:
        raise ValueError("south above north")
    return south, west, north, east


def within(p: Column, box: tuple[float, float, float, float]) -> Column:
    return in_box(p["y"], p["x"], *box)
