"""Registered spatial and stateful queries, with their oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import area_squares, in_box
from ..operators import geofence, paths, receivers, sessions, spatial, tracks
from . import domain as d
from .domain import metres, sql

FENCE = '[{"floorFt":0,"ceilingFt":5000,"radiusNm":300.0},{"floorFt":5001,"ceilingFt":10000,"radiusNm":600.0}]'


def _right(s, p):  # noqa: ANN001, ANN202
    return d.airports(s, p).select("airport_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))


def _fences(s, p):  # noqa: ANN001, ANN202
    return d.aircraft(s, p).select(
        (F.col("aircraft_id") % 7).alias("fence_id"), "aircraft_id", F.lit(40.0).alias("centre_lat"), F.lit(5.0).alias("centre_lon"), geofence.parsed(F.lit(FENCE)).alias("layers")
    )


def _statuses(s, p):  # noqa: ANN001, ANN202
    f = d.fixes(s, p).select("receiver_id", "received_at", "fix_id", (F.col("fix_id") % 100 / 100.0).alias("cpu_load"), (F.col("fix_id") % 90).cast("double").alias("cpu_temperature"))
    return tracks.latest(f, "receiver_id", "received_at", "fix_id", "cpu_load", "cpu_temperature")


NOW = "2024-01-30 00:00:00"


def _subscriptions(s, p):  # noqa: ANN001, ANN202
    a = F.col("aircraft_id")
    now = F.lit(NOW).cast("timestamp")
    return d.aircraft(s, p).select(
        a.alias("alert_id"), (a % 23).alias("receiver_id"), (a % 5 != 0).alias("on_down"), (a % 3 != 0).alias("on_cpu"), (a % 4 != 0).alias("on_temperature"),
        F.when(a % 2 == 0, 60).otherwise(10_000_000).alias("down_minutes"), F.lit(0.5).alias("most_cpu"), F.lit(45.0).alias("most_temperature"), (a % 40 + 5).alias("base_minutes"),
        (a % 13).alias("consecutive"), F.when(a % 13 > 0, F.timestamp_micros(F.unix_micros(now) - a * 37 % 2000 * 60_000_000)).alias("last_alerted_at"), F.when(a % 13 > 0, "cpu").alias("last_condition"),
    )


def _boxed(s, p):  # noqa: ANN001, ANN202
    f = d.flights(s, p).filter("landing IS NOT NULL")
    lat, lon = F.col("flight_id") % 60, F.col("flight_id") * 7 % 170
    return f.select("flight_id", F.col("takeoff").alias("first"), F.col("landing").alias("last"), lat.alias("min_lat"), (lat + 2).alias("max_lat"), lon.alias("min_lon"), (lon + 5).alias("max_lon"))


BOXED = """b AS (SELECT flight_id, takeoff AS first, landing AS last, flight_id % 60 AS la, flight_id * 7 % 170 AS lo FROM flights WHERE landing IS NOT NULL)"""

QUERIES = {
    "p6_in_box": (
        lambda s, p: d.fixes(s, p).filter(in_box(F.col("lat"), F.col("lon"), 35.0, 12.0, 45.0, -5.0)).select("fix_id", "lat", "lon"),
        sql("SELECT fix_id, lat, lon FROM fixes WHERE lat BETWEEN 35 AND 45 AND (lon >= 12 OR lon <= -5)"),
    ),
    "p9_within_radius": (
        lambda s, p: spatial.within_radius(d.fixes(s, p), 40.0, 5.0, 200_000.0).select("fix_id", F.round("distance_m", 2).alias("distance_m")),
        sql(f"SELECT fix_id, round(m, 2) AS distance_m FROM (SELECT fix_id, {metres('40.0', '5.0', 'lat', 'lon')} AS m FROM fixes) WHERE m <= 200000"),
    ),
    "j9_nearest_airport": (
        lambda s, p: spatial.nearest(d.fixes(s, p), _right(s, p), "fix_id", "airport_id", 50_000.0),
        sql(f"""SELECT fix_id, airport_id, round(m, 3) AS distance_m FROM (SELECT fix_id, airport_id, {metres('f.lat', 'f.lon', 'a.lat', 'a.lon')} AS m
              FROM fixes f JOIN airports a ON abs(f.lat - a.lat) < 1) WHERE m <= 50000 QUALIFY row_number() OVER (PARTITION BY fix_id ORDER BY m, airport_id) = 1"""),
    ),
    "j10_runway_ends": (
        lambda s, p: spatial.nearest_runway_ends(d.fixes(s, p), spatial.runway_ends(d.airports(s, p)), 30_000.0, 4).select("fix_id", "rank", "airport_id", F.round("planar_m", 3).alias("planar_m")),
        sql("""WITH ends AS (SELECT airport_id, k, lat + k * 0.009 * cos(radians(heading)) AS la, lon + k * 0.009 * sin(radians(heading)) AS lo FROM airports, (VALUES (-1), (1)) t(k))
            SELECT fix_id, rn - 1 AS rank, airport_id, round(m, 3) AS planar_m FROM (SELECT fix_id, airport_id, m, row_number() OVER (PARTITION BY fix_id ORDER BY m, airport_id) AS rn FROM
              (SELECT fix_id, airport_id, sqrt((f.lat - la) ** 2 + (f.lon - lo) ** 2) * 111000.0 AS m FROM fixes f JOIN ends ON abs(f.lat - la) < 0.5) WHERE m <= 30000) WHERE rn <= 4"""),
    ),
    "j11_tow_candidates": (
        lambda s, p: spatial.tow_candidates(d.fixes(s, p).filter("kind = 'purchase'"), d.fixes(s, p).filter("kind <> 'purchase'"), 300_000.0, 3600),
        sql(f"""SELECT f.fix_id, f.aircraft_id, min(o.aircraft_id) AS towed_id FROM fixes f JOIN fixes o ON abs(epoch_us(f.received_at) - epoch_us(o.received_at)) <= 3600000000
              AND f.aircraft_id <> o.aircraft_id AND f.kind = 'purchase' AND o.kind <> 'purchase' WHERE {metres('f.lat', 'f.lon', 'o.lat', 'o.lon')} <= 300000 GROUP BY ALL HAVING count(DISTINCT o.aircraft_id) = 1"""),
    ),
    "j14_overlapping_flights": (
        lambda s, p: spatial.overlapping_flights(_boxed(s, p)),
        sql(f"""WITH {BOXED} SELECT x.flight_id, y.flight_id AS flight_id2 FROM b x JOIN b y ON x.flight_id <> y.flight_id AND x.first <= y.last AND x.last >= y.first
            AND x.la <= y.la + 2 AND x.la + 2 >= y.la AND x.lo <= y.lo + 5 AND x.lo + 5 >= y.lo"""),
    ),
    "g13_area_squares": (
        lambda s, p: d.airports(s, p).select("airport_id", F.explode(area_squares(F.col("lat") - 1, F.col("lon") - 1, F.col("lat") + 1, F.col("lon") + 1)).alias("q")).select("airport_id", F.col("q.lat").alias("south"), F.col("q.lon").alias("west")),
        sql("""SELECT airport_id, a AS south, o AS west FROM (SELECT airport_id, lon, unnest(range(floor(lat - 1)::BIGINT, floor(lat + 1)::BIGINT + 1)) AS a FROM airports) t,
            LATERAL (SELECT unnest(range(floor(t.lon - 1)::BIGINT, floor(t.lon + 1)::BIGINT + 1)) AS o)"""),
    ),
    "t15_geofence_status": (
        lambda s, p: geofence.checked(d.fixes(s, p), _fences(s, p)).groupBy("fence_id", "status").agg(F.count("*").alias("n")),
        sql(f"""SELECT aircraft_id % 7 AS fence_id, CASE WHEN alt_ft > 10000 THEN 'no_layer' WHEN m <= 1852.0 * CASE WHEN alt_ft <= 5000 THEN 300 ELSE 600 END THEN 'inside' ELSE 'outside' END AS status, count(*) AS n
            FROM (SELECT *, {metres('lat', 'lon', '40.0', '5.0')} AS m FROM fixes WHERE aircraft_id IN (SELECT aircraft_id FROM aircraft)) GROUP BY ALL"""),
    ),
    "t16_geofence_exits": (
        lambda s, p: geofence.exits(d.fixes(s, p), _fences(s, p)),
        sql(f"""WITH c AS (SELECT aircraft_id % 7 AS fence_id, aircraft_id, fix_id, received_at, CASE WHEN alt_ft > 10000 THEN 'no_layer' WHEN m <= 1852.0 * CASE WHEN alt_ft <= 5000 THEN 300 ELSE 600 END THEN 'inside' ELSE 'outside' END AS st
              FROM (SELECT *, {metres('lat', 'lon', '40.0', '5.0')} AS m FROM fixes WHERE aircraft_id IN (SELECT aircraft_id FROM aircraft)))
            SELECT fence_id, aircraft_id, fix_id FROM c QUALIFY st = 'outside' AND lag(st) OVER (PARTITION BY aircraft_id ORDER BY received_at, fix_id) = 'inside'"""),
    ),
    "t18_receiver_alerts": (
        lambda s, p: receivers.alerts(_statuses(s, p), F.lit("2024-01-30 00:00:00").cast("timestamp"), 60.0, 0.5, 45.0),
        sql("""WITH l AS (SELECT DISTINCT ON (receiver_id) *, epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(received_at) > 3600000000 AS down FROM fixes ORDER BY receiver_id, received_at DESC, fix_id DESC)
            SELECT receiver_id, 'down' AS alert FROM l WHERE down UNION ALL SELECT receiver_id, 'cpu' FROM l WHERE NOT down AND fix_id % 100 / 100.0 > 0.5
            UNION ALL SELECT receiver_id, 'temperature' FROM l WHERE NOT down AND fix_id % 90 > 45"""),
    ),
    "t18_alert_rounds": (
        lambda s, p: receivers.checked(_subscriptions(s, p), _statuses(s, p), F.lit(NOW).cast("timestamp")).withColumn("last_alerted_at", F.unix_micros("last_alerted_at")).drop("on_down", "on_cpu", "on_temperature", "down_minutes", "most_cpu", "most_temperature"),
        sql(f"""WITH l AS (SELECT DISTINCT ON (receiver_id) receiver_id, received_at, fix_id % 100 / 100.0 AS cpu, fix_id % 90 AS heat FROM fixes ORDER BY receiver_id, received_at DESC, fix_id DESC),
              a AS (SELECT aircraft_id AS alert_id, aircraft_id % 23 AS receiver_id, aircraft_id % 40 + 5 AS base_minutes, aircraft_id % 13 AS n, aircraft_id * 37 % 2000 AS ago FROM aircraft),
              c AS (SELECT a.*, l.receiver_id IS NULL AS absent, epoch_us(TIMESTAMP '{NOW}') - epoch_us(l.received_at) > CASE WHEN alert_id % 2 = 0 THEN 60 ELSE 10000000 END * 60000000::BIGINT AS down, cpu, heat FROM a LEFT JOIN l USING (receiver_id)),
              w AS (SELECT *, CASE WHEN absent THEN NULL WHEN down THEN CASE WHEN alert_id % 5 <> 0 THEN 'down' END WHEN alert_id % 3 <> 0 AND cpu > 0.5 THEN 'cpu' WHEN alert_id % 4 <> 0 AND heat > 45 THEN 'temperature' END AS condition FROM c),
              o AS (SELECT *, CASE WHEN absent THEN 'unknown' WHEN condition IS NULL THEN CASE WHEN n > 0 THEN 'clear' ELSE 'quiet' END WHEN n > 0 AND ago < least(base_minutes * 2 ** (n - 1), 1440) THEN 'wait' ELSE 'send' END AS outcome FROM w)
            SELECT alert_id, receiver_id, base_minutes, CASE outcome WHEN 'send' THEN n + 1 WHEN 'clear' THEN 0 ELSE n END AS consecutive,
              CASE WHEN outcome = 'send' THEN epoch_us(TIMESTAMP '{NOW}') WHEN n > 0 THEN epoch_us(TIMESTAMP '{NOW}') - ago * 60000000::BIGINT END AS last_alerted_at,
              CASE WHEN outcome = 'send' THEN condition WHEN outcome <> 'clear' AND n > 0 THEN 'cpu' END AS last_condition, outcome, condition FROM o"""),
    ),
    "t8_flights": (lambda s, p: sessions.sessionize(d.fixes(s, p)), None),
    # one group is one flight between gaps, not an aircraft's history
    "g4_path_figures": (lambda s, p: paths.path_figures(tracks.with_sessions(d.fixes(s, p)).withColumn("flight", F.concat_ws("-", "aircraft_id", "session")), "flight"), None),
}
