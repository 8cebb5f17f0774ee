"""Registered updates, near-ground rules, transponder fixes and function columns, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells, codes, countries, geo, points, text, when
from ..operators import ground, merge, rollups, tracks, transponder, updates
from . import domain as d
from .domain import metres, seconds, sql
from .rollup_queries import _trips

TRIPS = "trips AS (SELECT fix_id AS flight_id, aircraft_id, received_at AS first, received_at + to_minutes(fix_id % 300) AS last FROM fixes WHERE kind = 'click')"
RATES = """rates AS (SELECT *, CASE WHEN floor((epoch_us(received_at) - epoch_us(pt)) / 1e6) > 0 THEN (alt_ft - pa) / floor((epoch_us(received_at) - epoch_us(pt)) / 1e6) * 60 END AS rate FROM
  (SELECT *, lag(alt_ft) OVER w AS pa, lag(received_at) OVER w AS pt FROM fixes WINDOW w AS (PARTITION BY aircraft_id ORDER BY received_at, fix_id))),
rel AS (SELECT * FROM (SELECT *, avg(rate) OVER (PARTITION BY aircraft_id ORDER BY received_at, fix_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS mean_climb FROM rates)
  WHERE mean_climb > 1 AND climb_fpm < -1)"""
ADDRESS = "(aircraft_id * 7919 * 2111 % 16777216)"
RAW_ID = "(fix_id * 2654435761 % 4294967296)"
RING = [(0.0, 35.0), (12.0, 33.0), (15.0, 45.0), (5.0, 40.0), (-4.0, 47.0)]
LAST_FIX = "takeoff + to_minutes(flight_id % 300)"
TAIL = "('N' || (aircraft_id % 100000) || CASE aircraft_id % 4 WHEN 1 THEN 'A' WHEN 2 THEN 'IO' WHEN 3 THEN 'bz' ELSE '' END)"
MESSAGES = """m AS (SELECT fix_id AS message_id, aircraft_id, received_at, CASE WHEN fix_id % 3 = 0 THEN lat END AS lat, CASE WHEN fix_id % 3 = 0 THEN lon END AS lon,
  CASE WHEN fix_id % 4 = 0 THEN alt_ft END AS altitude_ft, CASE WHEN fix_id % 5 < 2 THEN speed_kt END AS speed_kt, CASE WHEN fix_id % 5 = 1 THEN track END AS track,
  CASE WHEN fix_id % 7 = 1 THEN 'C' || (fix_id % 13) END AS callsign, CASE WHEN fix_id % 11 = 1 THEN (fix_id % 7777)::VARCHAR END AS squawk,
  CASE WHEN fix_id % 2 = 1 THEN fix_id % 6 < 3 END AS on_ground FROM fixes),
b AS (SELECT *, lat IS NOT NULL AS pos, speed_kt IS NOT NULL OR track IS NOT NULL AS vel, last_value(on_ground IGNORE NULLS) OVER (PARTITION BY aircraft_id ORDER BY received_at, message_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM m),
kept AS (SELECT * FROM b WHERE NOT (on_ground IS NOT NULL AND NOT pos AND NOT vel AND callsign IS NULL AND squawk IS NULL AND altitude_ft IS NULL AND coalesce(known = on_ground, false)))"""


def messages(s, p):  # noqa: ANN001, ANN201
    i = F.col("fix_id")
    return d.fixes(s, p).select(
        i.alias("message_id"), "aircraft_id", "received_at", F.when(i % 3 == 0, F.col("lat")).alias("lat"), F.when(i % 3 == 0, F.col("lon")).alias("lon"),
        F.when(i % 4 == 0, F.col("alt_ft")).alias("altitude_ft"), F.when(i % 5 < 2, F.col("speed_kt")).alias("speed_kt"), F.when(i % 5 == 1, F.col("track")).alias("track"),
        F.lit(None).cast("long").alias("climb_fpm"), F.when(i % 7 == 1, F.concat(F.lit("C"), i % 13)).alias("callsign"),
        F.when(i % 11 == 1, (i % 7777).cast("string")).alias("squawk"), F.when(i % 2 == 1, i % 6 < 3).alias("on_ground"),
    )


def _addressed(s, p):  # noqa: ANN001, ANN202
    return d.aircraft(s, p).select("aircraft_id", (F.col("aircraft_id") * 7919 * 2111 % 16777216).alias("address"))


def _tail(c="aircraft_id"):  # noqa: ANN001, ANN202
    k = F.col(c)
    return F.concat(F.lit("N"), (k % 100000).cast("string"), F.when(k % 4 == 1, "A").when(k % 4 == 2, "IO").when(k % 4 == 3, "bz").otherwise(""))


def _states(s, p):  # noqa: ANN001, ANN202
    f = d.flights(s, p)
    return f.withColumns({"last_fix": F.col("takeoff") + F.make_dt_interval(mins=(F.col("flight_id") % 300).cast("int")), "timed_out_at": F.lit(None).cast("timestamp")})


def _events(s, p):  # noqa: ANN001, ANN202
    return d.fixes(s, p).filter("kind = 'signup'").select(F.col("fix_id").alias("event_id"), "aircraft_id", "received_at", "lat", "lon")


def _now():  # noqa: ANN202
    return F.lit(d.FLIGHTS_AS_OF).cast("timestamp")


def _runways(at_airport: bool):  # noqa: ANN202
    from ..operators.spatial import runway_ends

    return lambda s, p: ground.runways_used(_events(s, p), d.fixes(s, p), runway_ends(d.airports(s, p)), F.lit(3.5), at_airport, 7200, 40_000.0, 10)


def _runways_sql(at_airport: bool) -> str:
    ident = lambda h: f"lpad((CASE WHEN floor({h} / 10 + 0.5)::INT % 36 = 0 THEN 36 ELSE floor({h} / 10 + 0.5)::INT % 36 END)::VARCHAR, 2, '0')"
    diff = lambda h: f"least(abs(course - ({h})) % 360, 360 - abs(course - ({h})) % 360)"
    return sql(f"""WITH e AS (SELECT * FROM fixes WHERE kind = 'signup'),
        c AS (SELECT e.fix_id, e.lat, e.lon, avg(f.track) AS course FROM e JOIN fixes f ON f.aircraft_id = e.aircraft_id AND abs(epoch_us(f.received_at) - epoch_us(e.received_at)) <= 7200000000 GROUP BY ALL),
        ends AS (SELECT airport_id, k, CASE WHEN k < 0 THEN 'le' ELSE 'he' END AS nm, CASE WHEN k < 0 THEN heading ELSE (heading + 180) % 360 END AS h, lat + k * 0.009 * cos(radians(heading)) AS la, lon + k * 0.009 * sin(radians(heading)) AS lo FROM airports, (VALUES (-1), (1)) t(k)),
        near AS (SELECT c.*, airport_id, nm, h, sqrt((lat - la) ** 2 + (lon - lo) ** 2) * 111000.0 AS m FROM c JOIN ends ON abs(lat - la) < 0.5),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY fix_id ORDER BY m, airport_id, nm) AS rn FROM near WHERE m <= 40000),
        diffs AS (SELECT *, {diff('h')} AS this, {diff('(h + 180) % 360')} AS other FROM ranked WHERE rn <= 10),
        best AS (SELECT DISTINCT ON (fix_id) fix_id, least(this, other) AS dd, CASE WHEN this < other THEN h ELSE (h + 180) % 360 END AS hh FROM diffs ORDER BY fix_id, least(this, other), rn),
        hit AS (SELECT fix_id, {ident('hh')} AS matched FROM best WHERE {'true' if at_airport else 'dd < 30'})
        SELECT c.fix_id AS event_id, coalesce(matched, {ident('((course - 3.5) % 360 + 360) % 360')}) AS runway, matched IS NULL AS inferred FROM c LEFT JOIN hit USING (fix_id)""")


def _country_rows() -> str:
    return ", ".join(f"({a}, {b}, '{c}')" for a, b, c in countries.ADDRESS_BLOCKS)


def _ring_rows() -> str:
    return ", ".join(f"({x}, {y}, {u}, {v})" for (x, y), (u, v) in zip(RING, [*RING[1:], RING[0]], strict=True))


def _ring():  # noqa: ANN202
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING))


QUERIES = {
    "x6_update_where": (
        lambda s, p: updates.update_where(
            d.flights(s, p).select("flight_id", "takeoff", "landing"), d.flights(s, p).filter("flight_id % 3 = 0").select("flight_id", F.expr("takeoff + INTERVAL 1 HOUR").alias("landing")), "flight_id", F.col("landing").isNull()
        ).select("flight_id", F.unix_timestamp("landing").alias("landed")),
        sql("SELECT flight_id, epoch_us(CASE WHEN landing IS NULL AND flight_id % 3 = 0 THEN takeoff + INTERVAL 1 HOUR ELSE landing END) // 1000000 AS landed FROM flights"),
    ),
    "x7_bulk_timeout": (
        lambda s, p: updates.timed_out(_states(s, p), _now(), 86400 * 365).select("flight_id", F.unix_timestamp("timed_out_at").alias("timed_out")),
        sql(f"SELECT flight_id, CASE WHEN landing IS NULL AND {LAST_FIX} < tf - INTERVAL 365 DAY THEN epoch_us({LAST_FIX} + INTERVAL 1 HOUR) // 1000000 END AS timed_out FROM flights, as_of"),
    ),
    "x8_deletes": (
        lambda s, p: updates.visible(
            updates.soft_deleted(updates.deleted(d.aircraft(s, p), d.aircraft(s, p).filter("club_id = 3"), "aircraft_id").withColumn("deleted_at", F.lit(None).cast("timestamp")), d.aircraft(s, p).filter("category = 'BUILDING'"), "aircraft_id", _now())
        ).groupBy("club_id", "category").agg(F.count("*").alias("n")),
        sql("SELECT club_id, category, count(*) AS n FROM aircraft WHERE club_id <> 3 AND category <> 'BUILDING' GROUP BY ALL"),
    ),
    "x10_generated_points": (
        lambda s, p: d.airports(s, p).select("airport_id", points.wkt(points.point(F.col("lat"), F.col("lon"))).alias("wkt"), points.geojson(points.point(F.col("lat"), F.col("lon"))).alias("geojson"),
            points.within(points.point(F.col("lat"), F.col("lon")), points.envelope(35.0, -5.0, 45.0, 12.0)).alias("inside"), cells.cell_id(F.col("lat"), F.col("lon"), 5).alias("cell")),
        sql("""SELECT airport_id, 'POINT(' || lon || ' ' || lat || ')' AS wkt, '{"type":"Point","coordinates":[' || lon || ',' || lat || ']}' AS geojson, lat BETWEEN 35 AND 45 AND lon BETWEEN -5 AND 12 AS inside,
            ((5 * 67108864 + floor((lat + 90) / 0.5)::BIGINT) * 67108864 + floor((lon + 180) / 0.5)::BIGINT) AS cell FROM airports"""),
    ),
    "g10_read_points": (
        lambda s, p: d.airports(s, p).select("airport_id", points.from_wkt(points.wkt(points.point(F.col("lat"), F.col("lon")))).alias("p")).select("airport_id", points.y("p").alias("y"), points.x("p").alias("x")),
        sql("SELECT airport_id, lat AS y, lon AS x FROM airports"),
    ),
    "x11_backfill": (
        lambda s, p: updates.backfilled(d.aircraft(s, p).select("aircraft_id", F.when(F.col("aircraft_id") % 3 == 0, F.col("registration")).when(F.col("aircraft_id") % 3 == 1, " ").alias("registration"), F.when(F.col("club_id") > 5, F.col("club_id")).alias("club_id")),
            {"registration": F.concat(F.lit("N"), F.col("aircraft_id").cast("string")), "club_id": F.lit(-1).cast("long")}),
        sql("SELECT aircraft_id, CASE WHEN aircraft_id % 3 = 0 THEN registration ELSE 'N' || aircraft_id END AS registration, CASE WHEN club_id > 5 THEN club_id ELSE -1 END AS club_id FROM aircraft"),
    ),
    "x12_repaired_addresses": (
        lambda s, p: updates.repaired_addresses(_addressed(s, p).withColumn("address_type", F.lit("unknown")), d.fixes(s, p).select("aircraft_id", "received_at", F.col("fix_id").alias("message_id"), F.lpad(F.hex(F.col("fix_id") * 2654435761 % 4294967296), 8, "0").alias("raw_id"))),
        sql(f"""SELECT aircraft_id, coalesce(r & 16777215, {ADDRESS}) AS address, coalesce(CASE (r >> 24) & 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'icao' WHEN 2 THEN 'flarm' WHEN 3 THEN 'ogn' END, 'unknown') AS address_type
            FROM aircraft LEFT JOIN (SELECT DISTINCT ON (aircraft_id) aircraft_id, {RAW_ID} AS r FROM fixes ORDER BY aircraft_id, received_at DESC, fix_id DESC) USING (aircraft_id)"""),
    ),
    "s10_device_ids": (
        lambda s, p: d.fixes(s, p).select("fix_id", codes.device_id(F.lpad(F.hex(F.col("fix_id") * 2654435761 % 4294967296), 8, "0")).alias("d")).select("fix_id", F.col("d.address").cast("long").alias("address"), "d.address_type", "d.category"),
        sql(f"""SELECT fix_id, r & 16777215 AS address, ['unknown', 'icao', 'flarm', 'ogn'][((r >> 24) & 3) + 1] AS address_type, [{", ".join(f"'{c}'" for c in codes.OGN_CATEGORIES)}][((r >> 26) & 15) + 1] AS category
            FROM (SELECT fix_id, {RAW_ID} AS r FROM fixes)"""),
    ),
    "w11_canonical_ids": (
        lambda s, p: updates.canonical_ids(d.table(s, p, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 10, F.col("p_size")).alias("size")), "p_partkey", ["p_brand", "size"]),
        "SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY p_brand, CASE WHEN p_size > 10 THEN p_size END ORDER BY p_partkey) AS canonical_id FROM part",
    ),
    "p12_dynamic_filter": (
        lambda s, p: updates.filtered(d.fixes(s, p), F.col("receiver_id") == 7, None, updates.altitudes_overlap(F.col("alt_ft"), F.col("alt_ft") + 500, 2000, 9000), None).select("fix_id", "alt_ft"),
        sql("SELECT fix_id, alt_ft FROM fixes WHERE receiver_id = 7 AND alt_ft + 500 >= 2000 AND alt_ft <= 9000"),
    ),
    "p13_altitude_overlap": (
        lambda s, p: rollups.flight_boxes(d.fixes(s, p), "aircraft_id").join(d.fixes(s, p).groupBy("aircraft_id").agg(F.min("alt_ft").alias("low"), F.max("alt_ft").alias("high")), "aircraft_id").filter(updates.altitudes_overlap(F.col("low"), F.col("high"), 11000, 11999)).select("aircraft_id", "low", "high"),
        sql("SELECT aircraft_id, min(alt_ft) AS low, max(alt_ft) AS high FROM fixes GROUP BY 1 HAVING max(alt_ft) >= 11000 AND min(alt_ft) <= 11999"),
    ),
    "p15_suppressed": (
        lambda s, p: d.fixes(s, p).filter(~F.col("kind").isin("view", "click") & (F.col("receiver_id") != 0)).groupBy("kind", "receiver_id").agg(F.count("*").alias("n")),
        sql("SELECT kind, receiver_id, count(*) AS n FROM fixes WHERE kind NOT IN ('view', 'click') AND receiver_id <> 0 GROUP BY ALL"),
    ),
    "p16_flight_views": (
        lambda s, p: d.flights(s, p).select(F.col("flight_id").alias("id"), F.to_json(F.struct(F.col("flight_id").alias("id"), F.struct(F.col("dep").alias("slot"), F.unix_timestamp("takeoff").alias("at")).alias("departure"),
            F.struct(F.col("arr").alias("slot"), F.unix_timestamp("landing").alias("at")).alias("arrival"), "towed"), {"ignoreNullFields": "false"}).alias("view")),
        sql("""SELECT flight_id AS id, '{"id":' || flight_id || ',"departure":{"slot":' || dep || ',"at":' || epoch_us(takeoff) // 1000000 || '},"arrival":{"slot":' || coalesce(arr::VARCHAR, 'null') || ',"at":' || coalesce((epoch_us(landing) // 1000000)::VARCHAR, 'null')
            || '},"towed":' || towed || '}' AS view FROM flights"""),
    ),
    "m5_json_built": (
        lambda s, p: d.flights(s, p).select("flight_id", F.to_json(F.struct("club_id", "arr", "dep")).alias("meta")),
        sql("""SELECT flight_id, '{' || concat_ws(',', '"club_id":' || club_id, '"arr":' || arr, '"dep":' || dep) || '}' AS meta FROM flights"""),
    ),
    "m7_any_of": (
        lambda s, p: d.fixes(s, p).filter(F.array_contains(F.array(*map(F.lit, (3, 5, 8))).cast("array<bigint>"), F.col("receiver_id"))).groupBy("receiver_id").agg(F.count("*").alias("n")),
        sql("SELECT receiver_id, count(*) AS n FROM fixes WHERE receiver_id = ANY([3, 5, 8]) GROUP BY 1"),
    ),
    "l2_nulls_last": (
        lambda s, p: d.flights(s, p).orderBy(F.col("arr").asc_nulls_last(), F.col("landing").desc_nulls_last(), "flight_id").limit(60).select("flight_id", "arr"),
        sql("SELECT flight_id, arr FROM flights ORDER BY arr ASC NULLS LAST, landing DESC NULLS LAST, flight_id LIMIT 60"),
    ),
    "f13_digests": (
        lambda s, p: d.table(s, p, "part").select("p_partkey", F.sha2("p_name", 256).alias("sha"), F.md5("p_name").alias("md5"), F.hex(F.encode("p_type", "UTF-8")).alias("hex"), F.base64(F.encode("p_brand", "UTF-8")).alias("b64")),
        "SELECT p_partkey, sha256(p_name) AS sha, md5(p_name) AS md5, hex(p_type) AS hex, to_base64(encode(p_brand)) AS b64 FROM part",
    ),
    "w10_ordered_lists": (
        lambda s, p: tracks.fixes_of_flights(d.fixes(s, p), _trips(s, p)).groupBy("flight_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("received_at", "fix_id"))), lambda x: x["fix_id"].cast("string")), ",").alias("fixes")),
        sql(f"WITH {TRIPS} SELECT flight_id, string_agg(fix_id, ',' ORDER BY received_at, fix_id) AS fixes FROM trips t JOIN fixes f ON f.aircraft_id = t.aircraft_id AND f.received_at BETWEEN t.first AND t.last GROUP BY 1"),
    ),
    "t17_tow_releases": (
        lambda s, p: ground.tow_releases(d.fixes(s, p), climbing=1.0).select("aircraft_id", "fix_id", "alt_ft", "mean_climb"),
        sql(f"WITH {RATES} SELECT aircraft_id, fix_id, alt_ft, round(mean_climb, 3) AS mean_climb FROM rel"),
    ),
    "a23_release_heights": (
        lambda s, p: ground.release_heights(ground.tow_releases(d.fixes(s, p), climbing=1.0), _trips(s, p), d.fixes(s, p)),
        sql(f"""WITH {TRIPS}, {RATES}, first AS (SELECT DISTINCT ON (flight_id) flight_id, alt_ft AS first_ft FROM trips t JOIN fixes f ON f.aircraft_id = t.aircraft_id AND f.received_at BETWEEN t.first AND t.last ORDER BY flight_id, received_at, fix_id),
            up AS (SELECT DISTINCT ON (flight_id) flight_id, fix_id AS release_fix, alt_ft AS release_ft FROM trips t JOIN rel f ON f.aircraft_id = t.aircraft_id AND f.received_at BETWEEN t.first AND t.last ORDER BY flight_id, received_at, fix_id)
            SELECT flight_id, release_fix, release_ft, first_ft, release_ft - first_ft AS height_ft FROM up JOIN first USING (flight_id)"""),
    ),
    "t23_runways_at_airport": (_runways(True), _runways_sql(True)),
    "t23_runways": (_runways(False), _runways_sql(False)),
    "t4_ground_changes": (
        lambda s, p: transponder.changes(messages(s, p)).groupBy("aircraft_id").agg(F.count("*").alias("n"), F.max("message_id").alias("last")),
        sql(f"WITH {MESSAGES} SELECT aircraft_id, count(*) AS n, max(message_id) AS last FROM kept GROUP BY 1"),
    ),
    "t3_accumulated_fixes": (
        lambda s, p: transponder.accumulated(messages(s, p), 7200).drop("received_at", "climb_fpm"),
        sql(f"""WITH {MESSAGES}, l AS (SELECT *, last_value(CASE WHEN pos THEN received_at END IGNORE NULLS) OVER w AS pat, last_value(lat IGNORE NULLS) OVER w AS plat, last_value(lon IGNORE NULLS) OVER w AS plon,
              last_value(CASE WHEN pos OR altitude_ft IS NOT NULL THEN {{'a': altitude_ft}} END IGNORE NULLS) OVER w AS al, last_value(CASE WHEN vel THEN {{'s': speed_kt, 't': track, 'at': received_at}} END IGNORE NULLS) OVER w AS v,
              last_value(callsign IGNORE NULLS) OVER w AS cs, last_value(squawk IGNORE NULLS) OVER w AS sq, last_value(on_ground IGNORE NULLS) OVER w AS og FROM kept WINDOW w AS (PARTITION BY aircraft_id ORDER BY received_at, message_id ROWS UNBOUNDED PRECEDING))
            SELECT aircraft_id, message_id, CASE WHEN pos THEN 'position' WHEN vel THEN 'velocity' WHEN callsign IS NOT NULL THEN 'identification' WHEN squawk IS NOT NULL THEN 'squawk' WHEN altitude_ft IS NOT NULL THEN 'altitude' ELSE 'position' END AS trigger,
              plat AS lat, plon AS lon, al.a AS altitude_ft, CASE WHEN floor({seconds('v.at', 'received_at')}) <= 7200 THEN v.s END AS speed_kt, CASE WHEN floor({seconds('v.at', 'received_at')}) <= 7200 THEN v.t END AS track,
              cs AS callsign, sq AS squawk, og AS on_ground, round({seconds('pat', 'received_at')} * 1000)::BIGINT AS position_age_ms FROM l WHERE floor({seconds('pat', 'received_at')}) <= 7200 AND og IS NOT NULL"""),
    ),
    "f7_address_countries": (
        lambda s, p: countries.with_address_country(_addressed(s, p), "address"),
        sql(f"SELECT aircraft_id, {ADDRESS} AS address, code AS country FROM aircraft LEFT JOIN (VALUES {_country_rows()}) t(a, b, code) ON {ADDRESS} BETWEEN a AND b"),
    ),
    "f5_registrations": (
        lambda s, p: d.aircraft(s, p).select("aircraft_id", codes.icao_to_us_registration(F.lit(0xA00001) + F.col("aircraft_id") * 37 % 700000).alias("us"), codes.icao_to_canadian_registration(F.lit(0xC00001) + F.col("aircraft_id") * 17 % 52728).alias("ca"))
        .withColumns({"us_back": codes.us_registration_to_icao(F.col("us")).cast("long"), "ca_back": codes.canadian_registration_to_icao(F.col("ca")).cast("long")}),
        sql("""WITH n AS (SELECT aircraft_id, 10485761 + aircraft_id * 37 % 700000 AS i, 12582913 + aircraft_id * 17 % 52728 AS j FROM aircraft),
            u AS (SELECT *, (i - 10485761) // 703 + 1 AS num, (i - 10485761) % 703 AS suf, (j - 12582913) // 17576 AS blk, (j - 12582913) % 17576 AS three FROM n)
            SELECT aircraft_id, CASE WHEN num <= 999 AND i <= 11400809 THEN 'N' || num || CASE WHEN suf = 0 THEN '' WHEN suf <= 26 THEN chr((64 + suf)::INT) ELSE chr((65 + (suf - 27) // 26)::INT) || chr((65 + (suf - 27) % 26)::INT) END END AS us,
              CASE WHEN blk <> 1 AND blk < 4 AND j <= 12635640 THEN 'C' || ['F', 'G', 'H', 'I'][blk + 1] || chr((65 + three // 676)::INT) || chr((65 + three // 26 % 26)::INT) || chr((65 + three % 26)::INT) END AS ca,
              CASE WHEN num <= 999 AND i <= 11400809 THEN i END AS us_back, CASE WHEN blk <> 1 AND blk < 4 AND j <= 12635640 THEN j END AS ca_back FROM u"""),
    ),
    "f_identifiers": (
        lambda s, p: d.aircraft(s, p).select("aircraft_id", text.is_us_registration(_tail()).alias("is_us"), text.hex_address(F.col("aircraft_id") * 7919 % 16777216).alias("hex"), text.from_hex(text.hex_address(F.col("aircraft_id") * 7919 % 16777216)).alias("back"),
            text.callsign_changed(F.when(F.col("aircraft_id") % 3 != 0, F.concat(F.lit(" "), (F.col("aircraft_id") % 5).cast("string"))), (F.col("aircraft_id") % 7).cast("string")).alias("changed"),
            text.learned_callsign(F.when(F.col("aircraft_id") % 3 != 0, F.lit("  ")), F.concat(F.lit(" C"), (F.col("aircraft_id") % 7).cast("string"), F.lit(" "))).alias("learned"),
            text.display_name(F.when(F.col("aircraft_id") % 2 == 0, F.col("category")), F.when(F.col("aircraft_id") % 3 == 0, _tail()), F.lit("icao"), F.col("aircraft_id")).alias("display")),
        sql(f"""SELECT aircraft_id, regexp_full_match(upper({TAIL}), 'N([0-9]{{1,5}}|[0-9]{{1,4}}[A-HJ-NP-Z]|[0-9]{{1,3}}[A-HJ-NP-Z]{{2}})') AS is_us, printf('%06X', aircraft_id * 7919 % 16777216) AS hex, aircraft_id * 7919 % 16777216 AS back,
            aircraft_id % 3 <> 0 AND aircraft_id % 5 <> aircraft_id % 7 AS changed, 'C' || (aircraft_id % 7) AS learned,
            CASE WHEN aircraft_id % 6 = 0 THEN category || ' (' || {TAIL} || ')' WHEN aircraft_id % 3 = 0 THEN {TAIL} WHEN aircraft_id % 2 = 0 THEN category ELSE 'ICAO-' || printf('%06X', aircraft_id) END AS display FROM aircraft"""),
    ),
    "f_names_and_addresses": (
        lambda s, p: d.clubs(s, p).select("club_id", text.is_soaring_club(F.concat("name", F.when(F.col("club_id") % 3 == 0, " Gliding Club").when(F.col("club_id") % 3 == 1, " soarers").otherwise(" Aero"))).alias("soaring"),
            text.is_soaring_club_on_load(F.concat("name", F.when(F.col("club_id") % 3 == 0, " Gliding Club").when(F.col("club_id") % 3 == 1, " soarers").otherwise(" Aero"))).alias("on_load"),
            text.zip_code(F.when(F.col("club_id") % 3 == 0, F.lpad(F.col("club_id").cast("string"), 5, "0")).when(F.col("club_id") % 3 == 1, F.concat(F.lit("12345-"), F.lpad(F.col("club_id").cast("string"), 4, "0"))).otherwise(" AB 1 ")).alias("zip"),
            text.joined_parts(F.col("name"), F.lit(" "), F.when(F.col("club_id") > 9, F.lit("x ")), F.lit("Road 5")).alias("joined"),
            text.normalized_manufacturer(F.concat("name", F.lit(" AIRCRAFT CORP.")), {"PERU AIRCRAFT CORP.": "Peru Air"}).alias("maker")),
        sql("""SELECT club_id, club_id % 3 <> 2 AS soaring, club_id % 3 = 1 AS on_load, CASE club_id % 3 WHEN 0 THEN printf('%05d', club_id) WHEN 1 THEN printf('12345-%04d', club_id) ELSE 'AB 1' END AS zip,
            name || CASE WHEN club_id > 9 THEN ', x' ELSE '' END || ', Road 5' AS joined, CASE WHEN name = 'PERU' THEN 'Peru Air' ELSE array_to_string(list_transform(string_split(lower(name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS maker FROM clubs"""),
    ),
    "f14_restricted_operations": (
        lambda s, p: d.clubs(s, p).select("club_id", F.array_join(codes.restricted_operations((F.col("club_id") % 4).cast("string"), (F.col("club_id") * 37).cast("string")), ",").alias("operations")),
        sql(f"""SELECT club_id, CASE WHEN club_id % 4 = 3 THEN concat_ws(',', {", ".join(f"CASE WHEN contains((club_id * 37)::VARCHAR, '{k}') THEN '{v}' END" for k, v in codes.RESTRICTED_OPERATIONS.items())}) ELSE '' END AS operations FROM clubs"""),
    ),
    "p18_type_codes": (
        lambda s, p: d.fixes(s, p).select(codes.ogn_category(F.col("receiver_id")).alias("category"), codes.airspace_type(F.col("receiver_id") * 2).alias("airspace")).groupBy("category", "airspace").agg(F.count("*").alias("n")),
        sql(f"""SELECT [{", ".join(f"'{c}'" for c in codes.OGN_CATEGORIES)}][(receiver_id & 15) + 1] AS category, coalesce([{", ".join(f"'{c}'" for c in codes.AIRSPACE_TYPES)}][receiver_id * 2 + 1], 'not_assigned') AS airspace, count(*) AS n FROM fixes GROUP BY ALL"""),
    ),
    "d_flight_states": (
        lambda s, p: _states(s, p).select("flight_id", when.flight_state(F.col("landing"), F.when(F.col("flight_id") % 9 == 0, F.col("last_fix")), F.col("last_fix"), F.lit("2001-07-01").cast("timestamp")).alias("state"),
            when.within_hours(F.col("takeoff"), F.lit("2001-07-01").cast("timestamp"), 1000).alias("recent"), when.on_day(F.col("takeoff"), F.lit("1998-02-03").cast("date")).alias("that_day"), F.round(when.hours_between(F.col("takeoff"), F.col("landing")), 6).alias("hours")),
        sql(f"""SELECT flight_id, CASE WHEN flight_id % 9 = 0 THEN 'timed_out' WHEN landing IS NOT NULL THEN 'complete' WHEN {LAST_FIX} < TIMESTAMP '2001-07-01' - INTERVAL 10 MINUTE THEN 'stale' ELSE 'active' END AS state,
            takeoff >= TIMESTAMP '2001-07-01' - INTERVAL 1000 HOUR AS recent, takeoff::DATE = DATE '1998-02-03' AS that_day, round({seconds('takeoff', 'landing')} / 3600, 6) AS hours FROM flights"""),
    ),
    "g_fix_geometry": (
        lambda s, p: d.fixes(s, p).select("fix_id", F.round(geo.angular_difference(F.col("track"), 350.0), 6).alias("turn"), F.round(geo.distance_3d(40.0, 5.0, F.lit(0.0), F.col("lat"), F.col("lon"), F.col("alt_ft") * 0.3048), 2).alias("metres"),
            geo.runway_ident(F.col("track")).alias("runway"), F.round(geo.true_to_magnetic(F.col("track"), F.lit(3.5)), 6).alias("magnetic"), F.round(geo.magnetic_to_true(F.col("track"), F.lit(3.5)), 6).alias("true"),
            geo.agl_feet(F.col("alt_ft"), F.col("receiver_id") * 10.5).cast("long").alias("agl"),
            geo.bilinear(F.col("fix_id") % 100, F.col("fix_id") % 70, F.col("fix_id") % 50, F.col("fix_id") % 90, F.col("fix_id") % 8 / 8.0, F.col("fix_id") % 4 / 4.0).cast("long").alias("ground")),
        sql(f"""SELECT fix_id, round(least(abs(track - 350) % 360, 360 - abs(track - 350) % 360), 6) AS turn, round(sqrt({metres('40.0', '5.0', 'lat', 'lon')} ** 2 + (alt_ft * 0.3048) ** 2), 2) AS metres,
            lpad((CASE WHEN floor(track / 10 + 0.5)::INT % 36 = 0 THEN 36 ELSE floor(track / 10 + 0.5)::INT % 36 END)::VARCHAR, 2, '0') AS runway, round((track + 356.5) % 360, 6) AS magnetic, round((track + 3.5) % 360, 6) AS true,
            round(alt_ft - receiver_id * 10.5 * 3.28084)::BIGINT AS agl,
            trunc(trunc((fix_id % 100) * (1 - fix_id % 8 / 8.0) + (fix_id % 70) * (fix_id % 8 / 8.0)) * (1 - fix_id % 4 / 4.0) + trunc((fix_id % 50) * (1 - fix_id % 8 / 8.0) + (fix_id % 90) * (fix_id % 8 / 8.0)) * (fix_id % 4 / 4.0))::BIGINT AS ground FROM fixes"""),
    ),
    "p10_in_polygon": (
        lambda s, p: d.fixes(s, p).filter(geo.in_polygon(F.col("lon"), F.col("lat"), _ring())).select("fix_id"),
        sql(f"""SELECT fix_id FROM fixes WHERE (SELECT count(*) FROM (VALUES {_ring_rows()}) t(x, y, u, v) WHERE (y > lat) <> (v > lat) AND lon < (u - x) * (lat - y) / (v - y) + x) % 2 = 1"""),
    ),
    "g18_signed_areas": (
        lambda s, p: d.clubs(s, p).select("club_id", geo.signed_area(F.transform(_ring(), lambda q: F.struct((q["x"] * F.col("club_id")).alias("x"), q["y"].alias("y")))).alias("area")),
        sql(f"SELECT club_id, (SELECT sum(x * y2 * club_id - x2 * y * club_id) / 2 FROM (VALUES {_ring_rows()}) t(x, y, x2, y2)) AS area FROM clubs"),
    ),
    "j8_cells_of_box": (
        lambda s, p: rollups.coverage(d.fixes(s, p), [3]).join(s.range(1).select(F.explode(cells.cells_of_box(35.0, -5.0, 46.0, 12.0, 3)).alias("cell")), "cell").groupBy("cell").agg(F.sum("n_fixes").alias("n")),
        sql("""SELECT ((3 * 67108864 + r) * 67108864 + c) AS cell, count(*)::BIGINT AS n FROM (SELECT floor((lat + 90) / 2)::BIGINT AS r, floor((lon + 180) / 2)::BIGINT AS c FROM fixes)
            WHERE r * 2 - 89 BETWEEN 35 AND 46 AND c * 2 - 179 BETWEEN -5 AND 12 GROUP BY 1"""),
    ),
    "g9_cell_corners": (
        lambda s, p: d.airports(s, p).select("airport_id", F.col("lat"), F.col("lon"), cells.cell_id(F.col("lat"), F.col("lon"), 6).alias("cell")).select("airport_id", *(c.alias(k) for k, c in cells.cell_parts(F.col("cell")).items() if k != "res"), F.element_at(F.element_at(cells.cell_boundary(F.col("cell")), 3), 1).alias("east")),
        sql("SELECT airport_id, floor((lat + 90) / 0.25) * 0.25 - 90 AS south, floor((lon + 180) / 0.25) * 0.25 - 180 AS west, floor((lon + 180) / 0.25) * 0.25 - 180 + 0.25 AS east FROM airports"),
    ),
    "m2_boxes": (
        lambda s, p: d.airports(s, p).select("airport_id", F.posexplode(geo.boxes(F.col("lat") - 1, F.pmod(F.col("lon") * 9 + 175, F.lit(360.0)) - 180, F.col("lat") + 1, F.pmod(F.col("lon") * 9 + 185, F.lit(360.0)) - 180)).alias("k", "b")).select("airport_id", "k", F.round("b.west", 6).alias("west"), F.round("b.east", 6).alias("east")),
        sql("""SELECT airport_id, k, CASE WHEN w <= e OR k = 0 THEN w ELSE -180 END AS west, CASE WHEN w <= e OR k = 1 THEN e ELSE 180 END AS east FROM (SELECT airport_id, round(((lon * 9 + 175) % 360 + 360) % 360 - 180, 6) AS w, round(((lon * 9 + 185) % 360 + 360) % 360 - 180, 6) AS e FROM airports) t,
            (VALUES (0), (1)) v(k) WHERE k = 0 OR w > e"""),
    ),
    "u3_source_priority": (
        lambda s, p: merge.last_of(d.fixes(s, p).select("aircraft_id", (F.col("receiver_id") * 1000000 + F.col("fix_id") % 1000000).alias("rank"), "fix_id", "kind"), "aircraft_id", "rank"),
        sql("SELECT DISTINCT ON (aircraft_id) aircraft_id, receiver_id * 1000000 + fix_id % 1000000 AS rank, fix_id, kind FROM fixes ORDER BY aircraft_id, rank DESC, fix_id DESC"),
    ),
    "a21_daily_archive_counts": (
        lambda s, p: rollups.grouped_counts(d.fixes(s, p).select(F.date_format("received_at", "yyyy-MM-dd").alias("day"), "kind"), "day", "kind"),
        sql("SELECT strftime(received_at, '%Y-%m-%d') AS day, kind, count(*) AS n FROM fixes GROUP BY ALL"),
    ),
    "s12_receiver_positions": (
        lambda s, p: tracks.latest(d.fixes(s, p), "receiver_id", "received_at", "fix_id", "lat", "lon").drop("received_at"),
        sql("SELECT DISTINCT ON (receiver_id) receiver_id, fix_id, lat, lon FROM fixes ORDER BY receiver_id, received_at DESC, fix_id DESC"),
    ),
    "s29_time_pruned_scan": (
        lambda s, p: d.fixes_between(s, p, "2024-01-05", "2024-01-09").groupBy("kind").agg(F.count("*").alias("n"), F.min("fix_id").alias("first")),
        sql("SELECT kind, count(*) AS n, min(fix_id) AS first FROM fixes WHERE received_at >= TIMESTAMP '2024-01-05' AND received_at < TIMESTAMP '2024-01-09' GROUP BY 1"),
    ),
    "l5_nearest_first": (
        lambda s, p: d.airports(s, p).select("airport_id", F.round(geo.haversine(40.0, 5.0, F.col("lat"), F.col("lon")), 3).alias("metres")).orderBy("metres", "airport_id").limit(15),
        sql(f"SELECT airport_id, round({metres('40.0', '5.0', 'lat', 'lon')}, 3) AS metres FROM airports ORDER BY metres, airport_id LIMIT 15"),
    ),
}
