"""Mode S extended squitter fields and compact position reports, as column expressions (published formulas)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 131072.0
#: Latitudes at which the number of longitude zones falls from 59 to 1, by the published rule.
ZONE_EDGES = [
    math.degrees(math.acos(math.sqrt((1 - math.cos(math.pi / 30)) / (1 - math.cos(2 * math.pi / n))))) for n in range(59, 1, -1)
]


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is reckoned once however often f names it: an expression named twice is reckoned twice, and inside a fold at every step."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def zones(lat: Column) -> Column:
    """Longitude zones at a latitude."""
    return once(F.abs(lat), lambda a: F.aggregate(F.array(*map(F.lit, ZONE_EDGES)), F.lit(59), lambda s, e: s - F.when(a >= e, 1).otherwise(0)))


def global_position(lat0: Column, lon0: Column, lat1: Column, lon1: Column, odd_is_newer: Column) -> Column:
    """Struct (lat, lon) of an even (0) and an odd (1) report, null where they lie in different zones."""
    wrapped = lambda d: once(d, lambda d: F.when(d >= 270, d - 360).otherwise(d))

    def rows(c: Column) -> Column:
        """With the latitudes of both."""
        j = F.floor(59 * c["y0"] - 60 * c["y1"] + 0.5)
        even, odd = wrapped((360.0 / 60) * (F.pmod(j, F.lit(60)) + c["y0"])), wrapped((360.0 / 59) * (F.pmod(j, F.lit(59)) + c["y1"]))
        return F.struct(c["x0"].alias("x0"), c["x1"].alias("x1"), c["newer"].alias("newer"), even.alias("even"), odd.alias("odd"))

    def counted(c: Column) -> Column:
        """With the zones of both."""
        return F.struct(c["x0"].alias("x0"), c["x1"].alias("x1"), c["newer"].alias("newer"), F.when(c["newer"], c["odd"]).otherwise(c["even"]).alias("lat"), zones(c["even"]).alias("n_even"), zones(c["odd"]).alias("n_odd"))

    def place(c: Column) -> Column:
        n = F.when(c["newer"], c["n_odd"]).otherwise(c["n_even"])
        m = F.floor(c["x0"] * (n - 1) - c["x1"] * n + 0.5)
        count = F.greatest(n - F.when(c["newer"], 1).otherwise(0), F.lit(1))
        lon = once((F.lit(360.0) / count) * (F.pmod(m, count) + F.when(c["newer"], c["x1"]).otherwise(c["x0"])), lambda x: F.when(x >= 180, x - 360).otherwise(x))
        return F.when((c["n_even"] == c["n_odd"]) & c["lat"].between(-90, 90), F.struct(c["lat"].alias("lat"), lon.alias("lon")))

    numbers = F.struct((lat0 / SCALE).alias("y0"), (lon0 / SCALE).alias("x0"), (lat1 / SCALE).alias("y1"), (lon1 / SCALE).alias("x1"), odd_is_newer.alias("newer"))
    return once(numbers, lambda c: once(rows(c), lambda r: once(counted(r), place)))


def bits(frame_hex: Column, first: int, count: int) -> Column:
    """Bits of a frame in hexadecimal, 1-based, at most 60."""
    start, end = (first - 1) // 4, (first + count - 2) // 4
    word = F.conv(F.substring(frame_hex, start + 1, end - start + 1), 16, 10).cast("long")
    return F.shiftright(word, 4 * (end + 1) - (first + count - 1)).bitwiseAND(F.lit((1 << count) - 1).cast("long"))


def squitter(frame_hex: Column) -> Column:
    """Struct of a 112-bit extended squitter (format 17): address, type code, altitude, CPR fields; null for other frames."""
    kind = bits(frame_hex, 33, 5)
    airborne = kind.between(9, 18)
    code = bits(frame_hex, 41, 12)
    n = F.shiftright(code, 5) * 16 + code.bitwiseAND(15)
    letters = "#ABCDEFGHIJKLMNOPQRSTUVWXYZ#####_###############0123456789######"
    char = lambda k: F.substring(F.lit(letters), bits(frame_hex, 41 + 6 * k, 6).cast("int") + 1, F.lit(1))
    made = F.struct(
        bits(frame_hex, 9, 24).cast("int").alias("address"),
        kind.cast("int").alias("type_code"),
        F.when(airborne & (F.shiftright(code, 4).bitwiseAND(1) == 1), n * 25 - 1000).alias("altitude_ft"),
        F.when(airborne, bits(frame_hex, 54, 1)).alias("odd"),
        F.when(airborne, bits(frame_hex, 55, 17)).alias("cpr_lat"),
        F.when(airborne, bits(frame_hex, 72, 17)).alias("cpr_lon"),
        F.when(kind.between(1, 4), F.regexp_replace(F.concat(*map(char, range(8))), "[_#]", "")).alias("callsign"),
    )
    return F.when(frame_hex.rlike("^[0-9A-Fa-f]{28}$") & (bits(frame_hex, 1, 5) == 17), made)
