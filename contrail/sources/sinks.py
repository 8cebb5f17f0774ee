"""Exports and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import cell_boundary


def igc_coordinate(x: Column, degrees: int, positive: str, negative: str) -> Column:
    """DDMMmmm or DDDMMmmm and the hemisphere."""
    milli = F.round(F.abs(x) * 60_000).cast("long")
    return F.concat(
        F.lpad(F.floor(milli / 60_000).cast("string"), degrees, "0"), F.lpad((milli % 60_000).cast("string"), 5, "0"), F.when(x >= 0, positive).otherwise(negative)
    )


def igc_record(time: Column, lat: Column, lon: Column, alt_ft: Column) -> Column:
    """A B record; both altitudes in whole metres, not below 0; V and zeros without an altitude."""
    metres = F.lpad(F.greatest(F.lit(0), F.round(F.coalesce(alt_ft, F.lit(0)) * 0.3048)).cast("long").cast("string"), 5, "0")
    validity = F.when(alt_ft.isNull(), "V").otherwise("A")
    return F.concat(F.lit("B"), F.date_format(time, "HHmmss"), igc_coordinate(lat, 2, "N", "S"), igc_coordinate(lon, 3, "E", "W"), validity, metres, metres)


def _ordered(fixes: DataFrame, key: str, line: Column) -> DataFrame:
    """One array of lines per flight, whose length the flight's duration bounds."""
    rows = fixes.select(key, F.struct("received_at", "fix_id", line.alias("line")).alias("s"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]).alias("lines"), F.min("s.received_at").alias("began"))


def igc(fixes: DataFrame, key: str) -> DataFrame:
    """A file's text for each flight."""
    b = _ordered(fixes, key, igc_record(F.col("received_at"), F.col("lat"), F.col("lon"), F.col("alt_ft")))
    day = F.concat(F.lit("HFDTE"), F.date_format("began", "ddMMyy"))
    head = F.concat_ws("\r\n", F.lit("AXXX000"), day, F.lit("HFFXA035"), F.lit("HFDTM100GPSDATUM:WGS-1984"), F.lit("I00"))
    return b.select(key, F.concat(head, F.lit("\r\n"), F.array_join("lines", "\r\n"), F.lit("\r\n")).alias("text"))


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


#: Line colours by whole hundreds of metres a flight climbs, as aabbggrr.
KML_COLOURS = ["ff00ff00", "ff00ffff", "ff0080ff", "ff0000ff"]


def kml(fixes: DataFrame, key: str) -> DataFrame:
    """K9: a document with the track of each flight, coloured by its height span, and placemarks of its first and last fix."""
    point = F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string"), F.round(F.coalesce("alt_ft", F.lit(0)) * 0.3048).cast("long").cast("string"))
    lines = _ordered(fixes, key, point)
    spans = fixes.groupBy(key).agg(F.coalesce((F.max("alt_ft") - F.min("alt_ft")) * 0.3048, F.lit(0.0)).alias("span"))
    colour = F.element_at(F.array(*map(F.lit, KML_COLOURS)), F.least(F.floor(F.col("span") / 500), F.lit(len(KML_COLOURS) - 1)).cast("int") + 1)
    mark = lambda name, at: F.concat(F.lit(f"<Placemark><name>{name}</name><Point><coordinates>"), at, F.lit("</coordinates></Point></Placemark>"))
    return lines.join(spans, key).select(
        key,
        F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Style id="track"><LineStyle><color>'),
            colour,
            F.lit('</color><width>3</width></LineStyle></Style><Placemark><name>'),
            _escaped(F.col(key).cast("string")),
            F.lit("</name><styleUrl>#track</styleUrl><LineString><altitudeMode>absolute</altitudeMode><coordinates>"),
            F.array_join("lines", " "),
            F.lit("</coordinates></LineString></Placemark>"),
            mark("Takeoff", F.element_at("lines", 1)),
            mark("Landing", F.element_at("lines", -1)),
            F.lit("</Document></kml>"),
        ).alias("text"),
    )


def geojson(coverage: DataFrame) -> DataFrame:
    """One feature per cell, ring closed, [lng, lat]."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(cell_boundary(F.col("cell"))).alias("coordinates"))
    properties = F.struct(F.lower(F.hex("cell")).alias("cell"), F.col("n_fixes"), ((F.col("last_seen") - F.col("first_seen")) / 3600.0).alias("hours"))
    return coverage.select("cell", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))


def subjects(fixes: DataFrame, prefix: str) -> DataFrame:
    """K7: topic and value of each fix, by aircraft and by one-degree square."""
    from ..functions.geo import area_subject

    topics = F.array(F.concat_ws(".", F.lit(prefix), F.lit("fix"), F.col("aircraft_id").cast("string")), area_subject(prefix, F.col("lat"), F.col("lon")))
    return fixes.select(F.explode(topics).alias("topic"), F.to_json(F.struct(*fixes.columns)).alias("value"))


def archive(df: DataFrame, time: str, path: str, before: Column) -> DataFrame:
    """K4, K5: writes whole UTC days before the bound as compressed JSON lines by day, and returns the rows that stay."""
    day = F.to_date(time)
    old = df.filter(day < before).withColumn("day", day)
    # a day goes to as many tasks as its hours, so that no task writes a whole day
    old.repartition("day", F.hour(time)).write.partitionBy("day").option("compression", "gzip").json(path)
    return df.filter((day >= before) | F.col(time).isNull())


def from_archive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S27."""
    return spark.read.schema(schema).json(path)


def dump(df: DataFrame, path: str) -> None:
    """K12."""
    df.write.json(path)


def daily_text(df: DataFrame, time: str, raw: str, path: str, codec: str = "gzip") -> None:
    """K6: raw lines as compressed text files by UTC day; codecs are those of the installed Hadoop libraries."""
    day = F.to_date(time)
    df.select(raw, day.alias("day"), F.hour(time).alias("__hour")).repartition("day", "__hour").drop("__hour").write.mode("append").partitionBy("day").option("compression", codec).text(path)
