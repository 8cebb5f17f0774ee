"""Decoders of text lines: column expressions over a string column, bad lines give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import device_id
from ..functions.geo import FEET_PER_METRE  # noqa: F401  re-exported for sinks

_POSITION = (
    r"^([^>\s]+)>([^,:]+),([^:]*):[/@](\d{6})h(\d{2})(\d{2}\.\d{2})([NS])(.)(\d{3})(\d{2}\.\d{2})([EW])(.)"
    r"(?:(\d{3})/(\d{3}))?(?:/A=(-?\d{5,6}))?(.*)$"
)
MOST_ALTITUDE_FT = 100_000


def replay_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """S7: "time raw" lines to (received_at, raw); lines without a time are dropped."""
    parts = F.split(value, " ", 2)
    return df.select(F.try_to_timestamp(parts[0]).alias("received_at"), F.get(parts, F.lit(1)).alias("raw")).filter("received_at IS NOT NULL")


def message_kind(raw: Column) -> Column:
    """Server, position, status or unknown."""
    return (
        F.when(raw.startswith("#"), "server").when(raw.rlike(_POSITION), "position").when(raw.rlike(r"^[^:]+:>"), "status").otherwise("unknown")
    )


def position(raw: Column) -> Column:
    """Struct of a position line, null for any other, and above 100 000 ft."""
    g = lambda i: F.nullif(F.regexp_extract(raw, _POSITION, i), F.lit(""))
    comment = F.regexp_extract(raw, _POSITION, 16)
    extra = lambda p: F.nullif(F.regexp_extract(comment, p, 1), F.lit(""))
    fine = extra(r"!W(\d)\d!"), extra(r"!W\d(\d)!")
    minutes = lambda i, k: g(i).try_cast("double") + F.coalesce(fine[k].try_cast("double") / 1000, F.lit(0.0))
    lat = (g(5).try_cast("double") + minutes(6, 0) / 60) * F.when(g(7) == "S", -1).otherwise(1)
    lon = (g(9).try_cast("double") + minutes(10, 1) / 60) * F.when(g(11) == "W", -1).otherwise(1)
    altitude = g(15).try_cast("int")
    course = g(13).try_cast("int")
    made = F.struct(
        g(1).alias("source"),
        F.element_at(F.split(g(3), ","), -1).alias("receiver"),
        g(4).alias("hhmmss"),
        F.round(lat, 7).alias("lat"),
        F.round(lon, 7).alias("lon"),
        F.when(course < 360, course).when(course == 360, 0).alias("track"),
        g(14).try_cast("int").alias("speed_kt"),
        altitude.alias("altitude_ft"),
        extra(r"([+-]\d+)fpm").try_cast("int").alias("climb_fpm"),
        extra(r"([+-]\d+\.?\d*)rot").try_cast("double").alias("turn_rot"),
        device_id(extra(r"\bid([0-9A-Fa-f]{8,10})\b")).alias("device"),
    )
    return F.when(raw.rlike(_POSITION) & (F.coalesce(altitude, F.lit(0)) <= MOST_ALTITUDE_FT), made)


def receiver_status(raw: Column) -> Column:
    """Figures of a status comment."""
    g = lambda p: F.nullif(F.regexp_extract(raw, p, 1), F.lit("")).try_cast("double")
    made = F.struct(
        F.regexp_extract(raw, "^([^>]+)>", 1).alias("receiver"),
        F.regexp_extract(raw, r":>(\d{6})h", 1).alias("hhmmss"),
        g(r"CPU:(\d+\.?\d*)").alias("cpu_load"),
        g(r"RAM:(\d+\.?\d*)/").alias("ram_free_mb"),
        g(r"RAM:\d+\.?\d*/(\d+\.?\d*)MB").alias("ram_total_mb"),
        g(r"NTP:(\d+\.?\d*)ms").alias("ntp_ms"),
        g(r"([+-]\d+\.?\d*)C").alias("cpu_temperature"),
        g(r"(\d+)/\d+Acfts").alias("visible_aircraft"),
        g(r"RF:([+-]\d+)").alias("rf_ppm"),
    )
    return F.when(raw.rlike(r"^[^:]+:>"), made)


def server_message(raw: Column) -> Column:
    """S13: "# software date GMT server endpoint"."""
    p = r"^#\s+(\S.*?)\s+(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT (\S+) (\S+)"
    g = lambda i: F.regexp_extract(raw, p, i)
    made = F.struct(g(1).alias("software"), F.try_to_timestamp(g(2), F.lit("d MMM yyyy HH:mm:ss")).alias("sent"), g(3).alias("server"), g(4).alias("endpoint"))
    return F.when(raw.rlike(p), made)


def sbs(raw: Column) -> Column:
    """A 22-field line; at least five fields, MSG, type 1-8 and a hexadecimal address, else null; empty fields are null."""
    f = F.split(raw, ",", -1)
    at = lambda i: F.nullif(F.trim(F.get(f, F.lit(i))), F.lit(""))
    flag = lambda i: F.when(at(i).isin("1", "-1"), True).when(at(i) == "0", False)
    made = F.struct(
        at(1).try_cast("int").alias("kind"),
        F.conv(at(4), 16, 10).cast("int").alias("address"),
        at(10).alias("callsign"),
        at(11).try_cast("int").alias("altitude_ft"),
        at(12).try_cast("double").alias("speed_kt"),
        at(13).try_cast("double").alias("track"),
        at(14).try_cast("double").alias("lat"),
        at(15).try_cast("double").alias("lon"),
        at(16).try_cast("int").alias("climb_fpm"),
        at(17).alias("squawk"),
        flag(21).alias("on_ground"),
    )
    good = (F.size(f) >= 5) & (at(0) == "MSG") & at(1).try_cast("int").between(1, 8) & at(4).rlike("^[0-9A-Fa-f]{1,6}$")
    return F.when(F.coalesce(good, F.lit(False)), made)


def filter_terms(text: str) -> list[tuple[str, bool, list[str]]]:
    """Terms of a server-side filter: kind, negated, arguments; unknown terms stay."""
    out = []
    for token in text.split():
        negated = token.startswith("-")
        kind, *rest = token.lstrip("-").split("/")
        out.append((kind, negated, rest))
    return out


def filter_column(text: str, lat: Column, lon: Column, source: Column, own: tuple[float, float] | None = None, **columns: Column) -> Column:
    """The predicate of a filter; any plain term lets a row in, any negated one keeps it out.

    Range (r), area (a), prefix (p) and buddy (b) terms look at the place and the source; m at the distance from ``own``; t (one-letter type), s (symbol), u
    (destination), e (entry station) and g (addressee) at the column that the caller gives under that letter. Without it, and for unknown
    terms, no row meets the term.
    """
    from ..functions.geo import haversine, in_box

    yes, no = [], []
    for kind, negated, args in filter_terms(text):
        if kind == "r" and len(args) >= 3:
            c = haversine(float(args[0]), float(args[1]), lat, lon) <= float(args[2]) * 1000
        elif kind == "a" and len(args) >= 4:
            north, west, south, east = map(float, args[:4])
            c = in_box(lat, lon, south, west, north, east)
        elif kind == "p":
            c = source.rlike("^(" + "|".join(map(_quoted, args)) + ")")
        elif kind == "b":
            c = source.isin(args)
        elif kind == "m" and own and args:
            c = haversine(own[0], own[1], lat, lon) <= float(args[0]) * 1000
        elif kind in ("t", "s") and kind in columns and args:
            c = columns[kind].isin(list(args[0]))
        elif kind in ("u", "e", "g") and kind in columns:
            c = columns[kind].isin(args)
        else:
            c = F.lit(False)
        (no if negated else yes).append(F.coalesce(c, F.lit(False)))
    out = F.lit(not yes)
    for c in yes:
        out = out | c
    for c in no:
        out = out & ~c
    return out


def _quoted(x: str) -> str:
    import re

    return re.escape(x)
