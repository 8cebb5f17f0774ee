"""Readers of reference files. Schemas are given, so no read infers one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AIRPORTS = (
    "id long, ident string, type string, name string, latitude_deg decimal(10,8), longitude_deg decimal(11,8), elevation_ft int, "
    "continent string, iso_country string, iso_region string, municipality string, scheduled_service string, icao_code string, "
    "iata_code string, gps_code string, local_code string, home_link string, wikipedia_link string, keywords string"
)
RUNWAYS = (
    "id long, airport_ref long, airport_ident string, length_ft int, width_ft int, surface string, lighted int, closed int, "
    "le_ident string, le_latitude_deg double, le_longitude_deg double, le_elevation_ft int, le_heading_degt double, "
    "le_displaced_threshold_ft int, he_ident string, he_latitude_deg double, he_longitude_deg double, he_elevation_ft int, "
    "he_heading_degt double, he_displaced_threshold_ft int"
)


def airports(spark: SparkSession, path: str) -> DataFrame:
    """S17."""
    return spark.read.schema(AIRPORTS).csv(path, header=True, escape='"').withColumn("scheduled_service", F.lower("scheduled_service") == "yes")


def runways(spark: SparkSession, path: str) -> DataFrame:
    """S18."""
    return spark.read.schema(RUNWAYS).csv(path, header=True, escape='"').withColumns({"lighted": F.col("lighted") == 1, "closed": F.col("closed") == 1})


def runway_end_rows(df: DataFrame) -> DataFrame:
    """Two rows per runway, those with coordinates."""
    end = lambda p: F.struct(F.lit(p).alias("end"), F.col(f"{p}_ident").alias("ident"), F.col(f"{p}_latitude_deg").alias("lat"), F.col(f"{p}_longitude_deg").alias("lon"), F.col(f"{p}_heading_degt").alias("heading"))
    return df.select("id", "airport_ref", F.explode(F.array(end("le"), end("he"))).alias("e")).select("id", "airport_ref", "e.*").filter("lat IS NOT NULL AND lon IS NOT NULL")


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


#: Plain text columns of the registration file and their names here; fixed values.
REGISTRATION_TEXTS = {
    "SERIAL NUMBER": "serial_number", "MFR MDL CODE": "model_code", "ENG MFR MDL": "engine_code", "TYPE REGISTRANT": "registrant_type", "NAME": "name",
    "STREET": "street", "STREET2": "street2", "CITY": "city", "STATE": "state", "ZIP CODE": "zip", "REGION": "region", "COUNTY": "county",
    "COUNTRY": "country", "CERTIFICATION": "certification", "TYPE AIRCRAFT": "aircraft_type", "TYPE ENGINE": "engine_type", "STATUS CODE": "status",
    "UNIQUE ID": "unique_id", "KIT MFR": "kit_maker", "KIT MODEL": "kit_model",
}


def registrations(spark: SparkSession, path: str) -> DataFrame:
    """Padded registration columns by header; 0 and blank are null, Y/N flags, yyyyMMdd days, hexadecimal and octal addresses.

    Columns that a file does not have are null.
    """
    df = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = df.toDF(*(c.strip().strip("\ufeff") for c in df.columns))
    text = lambda c: _text(c) if c in df.columns else F.lit(None).cast("string")
    day = lambda c: F.to_date(F.try_to_timestamp(text(c), F.lit("yyyyMMdd")))
    return df.select(
        F.concat(F.lit("N"), text("N-NUMBER")).alias("registration"),
        *(text(c).alias(name) for c, name in REGISTRATION_TEXTS.items()),
        F.nullif(text("YEAR MFR").try_cast("int"), F.lit(0)).alias("year"),
        day("LAST ACTION DATE").alias("last_action"),
        day("CERT ISSUE DATE").alias("issued"),
        day("AIR WORTH DATE").alias("airworthy"),
        day("EXPIRATION DATE").alias("expires"),
        (text("FRACT OWNER") == "Y").alias("fractional"),
        F.array_compact(F.array(*(text(f"OTHER NAMES({k})") for k in range(1, 6)))).alias("other_names"),
        F.coalesce(F.conv(text("MODE S CODE HEX"), 16, 10), F.conv(text("MODE S CODE"), 8, 10)).cast("int").alias("address"),
    )


def fixed_width(df: DataFrame, layout: dict[str, tuple[int, int]], value: str = "value") -> DataFrame:
    """Columns by 1-based first and last character; blank is null."""
    return df.select(*(F.nullif(F.trim(F.substring(value, a, b - a + 1)), F.lit("")).alias(c) for c, (a, b) in layout.items()))


#: 1-based first and last characters of the aircraft model file's columns; fixed values.
MODEL_LAYOUT = {
    "manufacturer_code": (1, 3), "model_code": (4, 5), "series_code": (6, 7), "manufacturer": (9, 38), "model": (40, 59), "aircraft_type": (61, 61),
    "engine_type": (63, 64), "category": (66, 66), "certification": (68, 68), "engines": (70, 71), "seats": (73, 75), "weight_class": (77, 83),
    "cruising_speed": (85, 88), "certificate": (90, 105), "certificate_holder": (107, 157),
}


def aircraft_models(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the fixed-width model file; the head line, short lines and lines without a manufacturer code are dropped."""
    lines = spark.read.text(path).filter(F.length("value") >= 156)
    rows = fixed_width(lines, MODEL_LAYOUT).filter("manufacturer_code IS NOT NULL AND manufacturer_code <> 'COD'")
    return rows.withColumns({c: F.nullif(F.col(c).try_cast("int"), F.lit(0)) for c in ("engines", "seats", "cruising_speed")})


def receivers(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Receivers, links and photos of one JSON document."""
    schema = "receivers array<struct<callsign:string,description:string,contact:string,links:array<struct<rel:string,href:string>>,photos:array<string>>>"
    every = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("receivers").alias("r")).select("r.*")
    return {
        "receivers": every.select("callsign", "description", "contact"),
        "links": every.select("callsign", F.posexplode("links").alias("position", "l")).select("callsign", "position", "l.*"),
        "photos": every.select("callsign", F.posexplode("photos").alias("position", "url")),
    }


def adsb_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; short_type: category, number of engines, kind of engine."""
    df = spark.read.schema("icao string, reg string, icaotype string, short_type string, ownop string, year string, mil boolean").json(path)
    part = lambda i: F.nullif(F.substring("short_type", i, 1), F.lit(""))
    return df.filter(F.col("icao").rlike("^[0-9A-Fa-f]{6}$")).select(
        F.conv("icao", 16, 10).cast("int").alias("address"), "reg", "icaotype", part(1).alias("category"), part(2).try_cast("int").alias("engines"), part(3).alias("engine_kind"), "ownop", F.col("year").try_cast("int").alias("year"), "mil"
    )


def unified_devices(by_priority: list[DataFrame]) -> DataFrame:
    """One row per address, from the first source that has it."""
    from ..operators.merge import last_of

    every = None
    for k, df in enumerate(by_priority):
        d = df.withColumn("priority", F.lit(-k))
        every = d if every is None else every.unionByName(d, allowMissingColumns=True)
    return last_of(every, "address", "priority").drop("priority")


def elevation_points(df: DataFrame, size: int = 1201) -> DataFrame:
    """(tile_lat, tile_lon, row, col, metres) from binary tiles (path, content); -32768 is no value.

    The name gives the south-west corner; big-endian 16-bit numbers, north row first.
    """
    import numpy as np
    import pandas as pd

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                lat = int(name[1:3]) * (1 if name[0] in "Nn" else -1)
                lon = int(name[4:7]) * (1 if name[3] in "Ee" else -1)
                grid = np.frombuffer(content, ">i2").reshape(size, size)
                for r in range(size):
                    values = grid[r].astype("int64")
                    yield pd.DataFrame({"tile_lat": lat, "tile_lon": lon, "row": r, "col": np.arange(size), "metres": values})[values > -32768]

    return df.select("path", "content").mapInPandas(run, "tile_lat long, tile_lon long, row long, col long, metres long")


def with_elevation(points: DataFrame, grid: DataFrame, size: int = 1201) -> DataFrame:
    """Points (lat, lon, ...) with elevation_m by bilinear interpolation over four joined grid values; null where any is missing."""
    from ..functions.geo import bilinear

    n = size - 1
    y, x = (F.col("lat") - F.floor("lat")) * n, (F.col("lon") - F.floor("lon")) * n
    # the key is made of the point itself, so a second run that orders rows in another way changes nothing
    p = points.withColumns(
        {
            "__id": F.struct("lat", "lon"),
            "tile_lat": F.floor("lat"),
            "tile_lon": F.floor("lon"),
            "__r": F.least(F.floor(n - y), F.lit(n - 1)),
            "__c": F.least(F.floor(x), F.lit(n - 1)),
        }
    )
    p = p.withColumns({"__fy": (n - y) - F.col("__r"), "__fx": x - F.col("__c")})
    corner = F.explode(F.array(*(F.struct((F.col("__r") + i).alias("row"), (F.col("__c") + j).alias("col"), F.lit(2 * i + j).alias("k")) for i in (0, 1) for j in (0, 1))))
    at = p.select("__id", "tile_lat", "tile_lon", "__fx", "__fy", "__r", "__c").distinct().select("__id", "tile_lat", "tile_lon", "__fx", "__fy", corner.alias("e")).select("__id", "tile_lat", "tile_lon", "__fx", "__fy", "e.*")
    q = [F.max(F.when(F.col("k") == k, F.col("metres"))) for k in range(4)]  # null, and so the result, where one is missing
    found = at.join(grid, ["tile_lat", "tile_lon", "row", "col"]).groupBy("__id").agg(
        bilinear(q[0], q[1], q[2], q[3], F.first("__fx"), F.first("__fy")).alias("elevation_m")
    )
    return p.join(found, "__id", "left").drop("__id", "tile_lat", "tile_lon", "__r", "__c", "__fx", "__fy")


def aircraft_types(spark: SparkSession, path: str) -> DataFrame:
    """Model codes with their description and kind of wing; rows without a code are dropped."""
    df = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = df.toDF(*(c.strip().strip("\ufeff").lower().replace(" ", "_") for c in df.columns))
    code = F.upper(F.nullif(F.trim(F.col(df.columns[0])), F.lit("")))
    return df.withColumn(df.columns[0], code).filter(F.col(df.columns[0]).isNotNull())


#: Altitudes in airspace files that are codes; fixed values.
ALTITUDE_CODES = {-9998: 18000}


def airspace_altitude(feet: Column) -> Column:
    out = feet
    for code, value in ALTITUDE_CODES.items():
        out = F.when(feet == code, value).otherwise(out)
    return out.cast("int")


def shapes(df: DataFrame) -> DataFrame:
    """(path, record, ring, points array<struct<x, y>>, outer) of binary polygon shape files (path, content).

    A record has parts of points (published layout: big-endian record heads, little-endian content, shape type 5). Clockwise rings are outer.
    """
    import struct

    import pandas as pd

    def rings(content: bytes):  # noqa: ANN202
        at = 100
        while at + 12 <= len(content):
            number, words = struct.unpack_from(">ii", content, at)
            body = at + 8
            if struct.unpack_from("<i", content, body)[0] == 5:
                parts, n = struct.unpack_from("<ii", content, body + 36)
                first = [*struct.unpack_from(f"<{parts}i", content, body + 44), n]
                xy = struct.unpack_from(f"<{2 * n}d", content, body + 44 + 4 * parts)
                for k in range(parts):
                    yield number, k, [{"x": xy[2 * i], "y": xy[2 * i + 1]} for i in range(first[k], first[k + 1])]
            at = body + 2 * words

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(path, *r) for r in rings(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "record", "ring", "points"])

    from ..functions.geo import signed_area

    read = df.select("path", "content").mapInPandas(run, "path string, record long, ring long, points array<struct<x: double, y: double>>")
    return read.withColumn("outer", signed_area(F.col("points")) < 0)
