"""The flight domain on the star-schema tables: deterministic arithmetic, the same in Spark and in the oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of all registered queries.
AS_OF = "2024-02-01 00:00:00"
FLIGHTS_AS_OF = "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixes(table(spark, sf_dir, "events"))


def _fixes(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.select(
        e.alias("fix_id"),
        F.col("user_id").alias("aircraft_id"),
        F.col("ts").cast("timestamp").alias("received_at"),
        (30 + (e * 7919 % 2000) / 100.0).alias("lat"),
        (-10 + (e * 10473 % 3000) / 100.0).alias("lon"),
        (e * 31 % 12000).alias("alt_ft"),
        (e * 17 % 5000).alias("agl_ft"),
        F.col("value").alias("speed_kt"),
        (e * 37 % 360).cast("double").alias("track"),
        (e * 13 % 2001 - 1000).alias("climb_fpm"),
        (e % 20).alias("receiver_id"),
        F.col("event_type").alias("kind"),
        F.col("props").alias("metadata"),
    )


def fixes_between(spark: SparkSession, sf_dir: str, first: str, end: str) -> DataFrame:
    """Fixes from first to before end (UTC); the bounds are on the stored column, so the scan skips row groups."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    inside = table(spark, sf_dir, "events").filter((F.col("ts") >= at(first)) & (F.col("ts") < at(end)))
    return _fixes(inside)


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    takeoff = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(k % 24).cast("int"))
    landing = takeoff + F.make_dt_interval(mins=(k % 400).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("flight_id"),
        F.col("o_custkey").alias("aircraft_id"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey") % 25).alias("club_id"),
        takeoff.alias("takeoff"),
        F.when(F.col("o_orderstatus") != "P", landing).alias("landing"),
        F.col("o_totalprice").alias("distance_m"),
        (k % 50).alias("dep"),
        F.when(k % 7 != 0, k * 3 % 50).alias("arr"),
        (F.col("o_orderpriority") == "1-URGENT").alias("towed"),
    )


def aircraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("aircraft_id"),
        F.col("c_name").alias("registration"),
        F.col("c_nationkey").cast("long").alias("club_id"),
        F.col("c_mktsegment").alias("category"),
    )


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        (s % 50).alias("slot"),
        s.alias("airport_id"),
        F.col("s_name").alias("ident"),
        (30 + (s * 733 % 2000) / 100.0).alias("lat"),
        (-10 + (s * 1471 % 3000) / 100.0).alias("lon"),
        (s * 7 % 360).cast("double").alias("heading"),
    )


def clubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("club_id"), F.col("n_name").alias("name"))


SQL = f"""
fixes AS (
  SELECT event_id AS fix_id, user_id AS aircraft_id, ts AS received_at,
         30 + (event_id * 7919 % 2000) / 100.0::DOUBLE AS lat, -10 + (event_id * 10473 % 3000) / 100.0::DOUBLE AS lon,
         event_id * 31 % 12000 AS alt_ft, event_id * 17 % 5000 AS agl_ft, value AS speed_kt,
         (event_id * 37 % 360)::DOUBLE AS track, event_id * 13 % 2001 - 1000 AS climb_fpm,
         event_id % 20 AS receiver_id, event_type AS kind, props AS metadata FROM events),
flights AS (
  SELECT *, CASE WHEN status <> 'P' THEN takeoff + to_minutes(flight_id % 400) END AS landing FROM (
    SELECT o_orderkey AS flight_id, o_custkey AS aircraft_id, CASE WHEN o_custkey % 11 <> 0 THEN o_custkey % 25 END AS club_id,
           o_orderdate + to_hours(o_orderkey % 24) AS takeoff, o_orderstatus AS status, o_totalprice AS distance_m,
           o_orderkey % 50 AS dep, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey * 3 % 50 END AS arr,
           o_orderpriority = '1-URGENT' AS towed FROM orders)),
aircraft AS (
  SELECT c_custkey AS aircraft_id, c_name AS registration, c_nationkey::BIGINT AS club_id, c_mktsegment AS category FROM customer),
airports AS (
  SELECT s_suppkey % 50 AS slot, s_suppkey AS airport_id, s_name AS ident, 30 + (s_suppkey * 733 % 2000) / 100.0::DOUBLE AS lat,
         -10 + (s_suppkey * 1471 % 3000) / 100.0::DOUBLE AS lon, (s_suppkey * 7 % 360)::DOUBLE AS heading FROM supplier),
clubs AS (SELECT n_nationkey::BIGINT AS club_id, n_name AS name FROM nation),
as_of AS (SELECT TIMESTAMP '{AS_OF}' AS t, TIMESTAMP '{FLIGHTS_AS_OF}' AS tf)
"""


def sql(body: str) -> str:
    """Oracle SQL: the domain's tables, and further CTEs or the query."""
    body = body.strip()
    return f"WITH {SQL}{', ' + body[5:] if body.startswith('WITH ') else body}"


#: Seconds between two timestamps, and haversine metres, as DuckDB macros spelled out.
def seconds(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a})) / 1000000.0"


def metres(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(sin(radians(({lat2}) - ({lat1})) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians(({lon2}) - ({lon1})) / 2) ** 2)"
    return f"(2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a})))"
