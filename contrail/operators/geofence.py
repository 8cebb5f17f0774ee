"""Geofences made of altitude layers, and exits from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geo import METRES_PER_NM, haversine

LAYERS = "array<struct<floorFt:int,ceilingFt:int,radiusNm:double>>"


def parsed(json: Column) -> Column:
    """M6."""
    return F.from_json(json, LAYERS)


def status(layers: Column, altitude_ft: Column, distance_m: Column) -> Column:
    """Inside if any layer of this altitude (ends included) reaches so far; else outside, no_layer or no_altitude."""
    here = F.filter(layers, lambda x: (altitude_ft >= x["floorFt"]) & (altitude_ft <= x["ceilingFt"]))
    inside = F.exists(here, lambda x: distance_m <= x["radiusNm"] * METRES_PER_NM)
    return F.when(altitude_ft.isNull(), "no_altitude").when(F.size(here) == 0, "no_layer").when(inside, "inside").otherwise("outside")


def checked(fixes: DataFrame, fences: DataFrame) -> DataFrame:
    """Fixes of each fence's aircraft with their status; fences: fence_id, aircraft_id, centre_lat, centre_lon, layers."""
    d = haversine(F.col("lat"), F.col("lon"), F.col("centre_lat"), F.col("centre_lon"))
    return fixes.join(fences, "aircraft_id").withColumn("status", status(F.col("layers"), F.col("alt_ft"), d))


def exits(fixes: DataFrame, fences: DataFrame) -> DataFrame:
    """Fixes that are outside while the one before, of the same aircraft and fence, was inside."""
    w = W.partitionBy("fence_id", "aircraft_id").orderBy("received_at", "fix_id")
    seen = checked(fixes, fences).withColumn("before", F.lag("status").over(w))
    return seen.filter("before = 'inside' AND status = 'outside'").select("fence_id", "aircraft_id", "fix_id")
