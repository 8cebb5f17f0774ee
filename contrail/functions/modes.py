"""Mode S frames as column expressions, by the published formulas: receiver framing, parity, addresses, velocities, surface reports and
positions from one frame and a place nearby. A frame is its bytes in hexadecimal: 14 digits (short) or 28 (long). ``cpr`` has the other fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .cpr import SCALE, bits, global_position, once, squitter, zones

#: Fixed value: the generator of the 24-bit parity, without its highest bit.
GENERATOR = 0xFFF409
PAIR_S = 10


def parity_table() -> list[int]:
    """Remainders of a byte followed by 24 zero bits."""
    table = []
    for byte in range(256):
        rest = byte << 16
        for _ in range(8):
            rest = (rest << 1 ^ (GENERATOR if rest & 0x800000 else 0)) & 0xFFFFFF
        table.append(rest)
    return table


def is_frame(frame_hex: Column) -> Column:
    return F.coalesce(frame_hex.rlike("^([0-9A-Fa-f]{14}|[0-9A-Fa-f]{28})$"), F.lit(False))


def _parity_of(digits: Column) -> Column:
    """Remainder of the bytes that these digits spell."""
    table = F.array(*map(F.lit, parity_table()))
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    step = lambda rest, i: (
        F.shiftleft(rest, 8).bitwiseXOR(F.get(table, F.shiftright(rest, 16).bitwiseXOR(byte(i)).bitwiseAND(255))).bitwiseAND(0xFFFFFF)
    )
    return F.aggregate(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), F.lit(0), step)


def _padded(digits: Column) -> Column:
    return F.concat(digits, F.lpad(F.hex(_parity_of(digits)), 6, "0"))


def parity(frame_hex: Column) -> Column:
    """What is left of a frame after division: 0 for a sound squitter, the address for replies that hide it there; null for no frame."""
    size = F.length(frame_hex)
    rest = _parity_of(F.substring(frame_hex, F.lit(1), size - 6))
    last = F.conv(F.substring(frame_hex, size - 5, F.lit(6)), 16, 10).cast("int")
    return F.when(is_frame(frame_hex), rest.bitwiseXOR(last))


def with_parity(digits: Column) -> Column:
    """A sound squitter from its digits without parity."""
    return once(digits, _padded)


def downlink_format(frame_hex: Column) -> Column:
    """Formats above 23 have two bits only."""
    return F.when(is_frame(frame_hex), F.least(bits(frame_hex, 1, 5), F.lit(24)).cast("int"))


def address(frame_hex: Column) -> Column:
    """The sender: spelled out in formats 11, 17 and 18 if their parity is sound (format 11 may carry the number of a ground station below 128), hidden in the parity of the replies."""
    parts = F.struct(downlink_format(frame_hex).alias("kind"), parity(frame_hex).alias("rest"), bits(frame_hex, 9, 24).cast("int").alias("spelled"))
    sender = lambda p: (
        F.when(p["kind"].isin(17, 18) & (p["rest"] == 0), p["spelled"])
        .when((p["kind"] == 11) & (p["rest"] < 128), p["spelled"])
        .when(p["kind"].isin(0, 4, 5, 16, 20, 21), p["rest"])
    )
    return once(parts, sender)


def unframed(raw: Column) -> Column:
    """Struct (kind, signal, frame) of what a receiver sends for a message: 0x1A, kind, six bytes of time, signal and 2, 7 or 14 bytes; null for others."""
    digits = F.hex(raw)
    payload = F.substring(digits, F.lit(19), F.length(digits) - 18)
    number = lambda at: F.conv(F.substring(digits, F.lit(at), F.lit(2)), 16, 10).cast("int")
    made = F.struct(number(3).alias("kind"), number(17).alias("signal"), payload.alias("frame"))
    return F.when(digits.startswith("1A") & F.length(payload).isin(4, 14, 28), made)


def _squitters(frame_hex: Column, first: int, last: int) -> Column:
    """A sound squitter of these type codes."""
    return squitter(frame_hex).isNotNull() & bits(frame_hex, 33, 5).between(first, last) & (parity(frame_hex) == 0)


def velocity(frame_hex: Column) -> Column:
    """Struct (speed_kt, track, heading, airspeed_kt, true_airspeed, climb_fpm) of a velocity report (type 19); null for other frames or a faulty parity."""
    me = lambda first, count: bits(frame_hex, 32 + first, count)
    sub = me(6, 3)
    step = F.when(sub.isin(2, 4), 4).otherwise(1)  # faster than sound
    east, north = me(15, 10), me(26, 10)
    speed = lambda sign, v: F.when(me(sign, 1) == 1, -1).otherwise(1) * (v - 1) * step
    x, y = speed(14, east), speed(25, north)
    over_ground = sub.isin(1, 2) & (east > 0) & (north > 0)
    through_air = sub.isin(3, 4)
    climb = F.when(me(38, 9) > 0, F.when(me(37, 1) == 1, -64).otherwise(64) * (me(38, 9) - 1))
    made = F.struct(
        F.when(over_ground, F.sqrt(x * x + y * y)).alias("speed_kt"),
        F.when(over_ground, F.pmod(F.degrees(F.atan2(x.cast("double"), y.cast("double"))), F.lit(360.0))).alias("track"),
        F.when(through_air & (me(14, 1) == 1), east * 360 / 1024.0).alias("heading"),
        F.when(through_air & (north > 0), (north - 1) * step).cast("int").alias("airspeed_kt"),
        F.when(through_air & (north > 0), me(25, 1) == 1).alias("true_airspeed"),
        climb.cast("int").alias("climb_fpm"),
    )
    return F.when(_squitters(frame_hex, 19, 19) & sub.between(1, 4), made)


#: Fixed values of surface movement: from this code on, the knots of the code and the knots of each further one.
MOVEMENT = [(2, 0.125, 0.125), (9, 1.0, 0.25), (13, 2.0, 0.5), (39, 15.0, 1.0), (94, 70.0, 2.0), (109, 100.0, 5.0), (124, 175.0, 0.0)]


def surface(frame_hex: Column) -> Column:
    """Struct (speed_kt, track, odd, cpr_lat, cpr_lon) of a report from the ground (types 5 to 8)."""
    me = lambda first, count: bits(frame_hex, 32 + first, count)
    code = me(6, 7)
    knots = F.when(code == 1, 0.0)
    for (first, base, each), (end, *_) in zip(MOVEMENT, [*MOVEMENT[1:], (125,)], strict=True):
        knots = knots.when((code >= first) & (code < end), base + (code - first) * each)
    made = F.struct(
        knots.alias("speed_kt"),
        F.when(me(13, 1) == 1, me(14, 7) * 360 / 128.0).alias("track"),
        me(22, 1).alias("odd"),
        me(23, 17).alias("cpr_lat"),
        me(40, 17).alias("cpr_lon"),
    )
    return F.when(_squitters(frame_hex, 5, 8), made)


def local_position(cpr_lat: Column, cpr_lon: Column, odd: Column, near_lat: Column, near_lon: Column, on_surface: bool = False) -> Column:
    """Struct (lat, lon) from one report and a place within half a zone: 180 nautical miles in the air, 45 on the ground."""
    span = 90.0 if on_surface else 360.0
    fit = lambda ref, part, size: size * (F.floor(ref / size) + F.floor(F.lit(0.5) + F.pmod(ref, size) / size - part) + part)
    lat = fit(near_lat, cpr_lat / SCALE, F.lit(span) / (60 - odd))
    lon = fit(near_lon, cpr_lon / SCALE, F.lit(span) / F.greatest(zones(lat) - odd, F.lit(1)))
    lon = F.pmod(lon + 180, F.lit(360.0)) - 180
    return F.when(lat.between(-90, 90), F.struct(lat.alias("lat"), lon.alias("lon")))


def compact(lat: Column, lon: Column, odd: Column) -> Column:
    """Struct (cpr_lat, cpr_lon): the numbers that an airborne report carries."""
    code = lambda x, size: F.pmod(F.floor(SCALE * F.pmod(x, size) / size + 0.5), F.lit(int(SCALE))).cast("long")
    rows = F.lit(360.0) / (60 - odd)
    y = code(lat, rows)
    shown = rows * (y / SCALE + F.floor(lat / rows))  # zones are those of the latitude that a receiver reads
    return F.struct(y.alias("cpr_lat"), code(lon, F.lit(360.0) / F.greatest(zones(shown) - odd, F.lit(1))).alias("cpr_lon"))


def paired_positions(frames: DataFrame, within_s: float = PAIR_S) -> DataFrame:
    """Positions of airborne reports: each with the newest report of the other kind of the same sender, at most within_s seconds before.

    frames: received_at, frame_id, frame. Returns frame_id, address, received_at, altitude_ft, lat, lon; frames without a partner, or with one in
    another zone, give no row, and so do those with a faulty parity.
    """
    read = frames.withColumns({"__s": squitter(F.col("frame")), "address": address(F.col("frame"))}).filter("__s.odd IS NOT NULL AND address IS NOT NULL")
    order = W.partitionBy("address").orderBy("received_at", "frame_id").rowsBetween(W.unboundedPreceding, -1)
    report = F.struct("__s.cpr_lat", "__s.cpr_lon", "received_at")
    other = lambda kind: F.last(F.when(F.col("__s.odd") == kind, report), ignorenulls=True).over(order)
    newest = F.when(F.col("__s.odd") == 1, other(0)).otherwise(other(1))
    both = read.select("*", newest.alias("__o")).filter((F.unix_micros("received_at") - F.unix_micros("__o.received_at")) / 1e6 <= within_s)
    odd = F.col("__s.odd") == 1
    pick = lambda c, even: F.when(odd == even, F.col(f"__o.{c}")).otherwise(F.col(f"__s.{c}"))
    place = global_position(pick("cpr_lat", True), pick("cpr_lon", True), pick("cpr_lat", False), pick("cpr_lon", False), odd)
    return both.select("frame_id", "address", "received_at", F.col("__s.altitude_ft").alias("altitude_ft"), place.alias("__p")).filter("__p IS NOT NULL").select(
        "frame_id", "address", "received_at", "altitude_ft", "__p.lat", "__p.lon"
    )
