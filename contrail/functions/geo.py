"""Geographic column expressions. Angles in degrees, distances in metres on a sphere, altitudes in feet unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_000.0
FEET_PER_METRE = 3.28084
METRES_PER_NM = 1852.0

Num = Column | float | int


def col(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def haversine(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Great-circle distance."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def distance_3d(lat1: Num, lon1: Num, alt1_m: Column, lat2: Num, lon2: Num, alt2_m: Column) -> Column:
    """Adds the altitude difference where both altitudes are known."""
    flat = haversine(lat1, lon1, lat2, lon2)
    rise = F.coalesce(alt2_m - alt1_m, F.lit(0.0))
    return F.sqrt(flat * flat + rise * rise)


def angular_difference(a: Num, b: Num) -> Column:
    d = F.abs(col(a) - col(b)) % 360
    return F.least(d, 360 - d)


def normalized_heading(degrees: Column) -> Column:
    """Into 0 <= h < 360."""
    return F.pmod(degrees, F.lit(360.0))


def true_to_magnetic(true_heading: Column, declination: Column) -> Column:
    return normalized_heading(true_heading - declination)


def magnetic_to_true(magnetic_heading: Column, declination: Column) -> Column:
    return normalized_heading(magnetic_heading + declination)


def runway_ident(heading: Column) -> Column:
    """Two digits, 01 to 36."""
    tens = F.floor(heading / 10 + 0.5).cast("int") % 36
    return F.lpad(F.when(tens == 0, 36).otherwise(tens).cast("string"), 2, "0")


def in_box(lat: Column, lon: Column, south: Num, west: Num, north: Num, east: Num) -> Column:
    """Inclusive box; west > east crosses the antimeridian."""
    west, east = col(west), col(east)
    across = (lon >= west) | (lon <= east)
    return lat.between(col(south), col(north)) & F.when(west <= east, lon.between(west, east)).otherwise(across)


def boxes(south: Num, west: Num, north: Num, east: Num) -> Column:
    """One box, or two where it crosses the antimeridian, as an array of structs."""
    south, west, north, east = map(col, (south, west, north, east))
    box = lambda w, e: F.struct(south.alias("south"), w.alias("west"), north.alias("north"), e.alias("east"))
    return F.when(west <= east, F.array(box(west, east))).otherwise(F.array(box(west, F.lit(180.0)), box(F.lit(-180.0), east)))


def boxes_overlap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    return (a_min <= b_max) & (a_max >= b_min)


def grid_floor(x: Column, size: Num) -> Column:
    return F.floor(x / col(size)) * col(size)


def area_subject(prefix: str, lat: Column, lon: Column) -> Column:
    """Key of the one-degree square."""
    return F.concat_ws(".", F.lit(prefix), F.lit("area"), F.floor(lat).cast("string"), F.floor(lon).cast("string"))


def area_squares(south: Num, west: Num, north: Num, east: Num) -> Column:
    """All one-degree squares that a box touches, as an array of (lat, lon); poles clipped."""
    south, north = F.greatest(col(south), F.lit(-90.0)), F.least(col(north), F.lit(90.0))
    lats = F.sequence(F.floor(south), F.least(F.floor(north), F.lit(89)))
    span = lambda w, e: F.sequence(F.floor(col(w)), F.least(F.floor(col(e)), F.lit(179)))
    lons = F.when(col(west) <= col(east), span(west, east)).otherwise(F.concat(span(west, 179), span(-180, east)))
    return F.flatten(F.transform(lats, lambda a: F.transform(lons, lambda o: F.struct(a.alias("lat"), o.alias("lon")))))


def planar_metres(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    """Degrees times 111 000: cheap, for runway ends close by."""
    dlat, dlon = col(lat1) - col(lat2), col(lon1) - col(lon2)
    return F.sqrt(dlat * dlat + dlon * dlon) * METRES_PER_DEGREE


def signed_area(ring: Column) -> Column:
    """Shoelace sum of an array of (x, y) structs; negative is clockwise."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over an array of (x, y) structs."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crossed = F.zip_with(
        ring,
        following,
        lambda p, q: F.when(
            ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]), 1
        ).otherwise(0),
    )
    return F.aggregate(crossed, F.lit(0), lambda s, t: s + t) % 2 == 1


def agl_feet(msl_feet: Column, elevation_m: Column) -> Column:
    """Height over ground; null where the elevation is."""
    return F.round(msl_feet - elevation_m * FEET_PER_METRE).cast("int")


def bilinear(q11: Column, q21: Column, q12: Column, q22: Column, fx: Column, fy: Column) -> Column:
    """Elevation between four grid values, cut to whole metres after each of the three interpolations."""
    low = (q11 * (1 - fx) + q21 * fx).cast("int")
    high = (q12 * (1 - fx) + q22 * fx).cast("int")
    return (low * (1 - fy) + high * fy).cast("int")
