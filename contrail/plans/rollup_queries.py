"""Registered rollups, windows and relational reads, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge, rollups, search, tracks
from . import domain as d
from .domain import metres, seconds, sql

FIRST, LAST = "1996-01-01", "1996-12-31"
SECS = f"CASE WHEN takeoff IS NULL OR landing IS NULL THEN 0 ELSE floor({seconds('takeoff', 'landing')} + 0.5)::BIGINT END"
CELL = "((r * 67108864 + floor((lat + 90) / (16.0 / 2 ** r))::BIGINT) * 67108864 + floor((lon + 180) / (16.0 / 2 ** r))::BIGINT)"
MINUTES = f"floor(({SECS}) / 60)"


def _bucket_sql() -> str:
    from ..functions.when import DURATION_BUCKETS

    cases = " ".join(f"WHEN {MINUTES} < {m} THEN '{label}'" for m, label in DURATION_BUCKETS[:-1])
    return f"CASE {cases} ELSE '{DURATION_BUCKETS[-1][1]}' END"


def _bucket_rows() -> str:
    from ..functions.when import DURATION_BUCKETS

    return ", ".join(f"({i}, '{label}')" for i, (_, label) in enumerate(DURATION_BUCKETS))


COVERAGE_SQL = f"""
SELECT {CELL} AS cell, r AS resolution, receiver_id, strftime(received_at, '%Y-%m-%d') AS day, count(*) AS n_fixes,
       (epoch_us(min(received_at)) // 1000000) AS first_seen, (epoch_us(max(received_at)) // 1000000) AS last_seen, min(alt_ft) AS min_alt,
       max(alt_ft) AS max_alt, floor(avg(alt_ft) + 0.5)::BIGINT AS avg_alt
FROM fixes, (VALUES (3), (5), (8)) t(r) GROUP BY ALL"""
STEPS_SQL = f"""
steps AS (SELECT *, coalesce({metres('plat', 'plon', 'lat', 'lon')}, 0) AS step_m, coalesce({seconds('pt', 'received_at')}, 0) AS gap_s
  FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(received_at) OVER w AS pt, lag(speed_kt) OVER w AS pspeed
        FROM fixes WINDOW w AS (PARTITION BY aircraft_id ORDER BY received_at, fix_id)))"""
DAILY_AIRPORT_SQL = """
daily AS (SELECT slot, strftime(t, '%Y-%m-%d') AS day, sum(x)::BIGINT AS departures, sum(y)::BIGINT AS arrivals
          FROM (SELECT dep AS slot, takeoff AS t, 1 AS x, 0 AS y FROM flights UNION ALL SELECT arr, landing, 0, 1 FROM flights)
          WHERE slot IS NOT NULL AND t IS NOT NULL GROUP BY ALL)"""


def _now():  # noqa: ANN202
    return F.lit(d.FLIGHTS_AS_OF).cast("timestamp")


def cov(s, p):  # noqa: ANN001, ANN201
    return rollups.coverage(d.fixes(s, p), [3, 5, 8])


QUERIES = {
    "a1_daily_flights": (
        lambda s, p: rollups.daily_flights(d.flights(s, p)),
        sql(f"""SELECT strftime(takeoff, '%Y-%m-%d') AS day, count(*) AS n_flights, sum({SECS})::BIGINT AS total_seconds,
            floor(avg({SECS}) + 0.5)::BIGINT AS avg_seconds, round(sum(distance_m), 2) AS total_m, count(*) FILTER (towed) AS n_towed,
            count(*) FILTER (arr IS NOT NULL AND dep <> arr) AS n_cross_country FROM flights GROUP BY 1"""),
    ),
    "a2_hourly_flights": (
        lambda s, p: rollups.hourly_flights(d.flights(s, p)),
        sql("""SELECT epoch(date_trunc('hour', takeoff))::BIGINT AS hour, count(*) AS n_flights, count(DISTINCT aircraft_id) AS n_aircraft,
            count(DISTINCT club_id) AS n_clubs FROM flights GROUP BY 1"""),
    ),
    "a3_duration_histogram": (
        lambda s, p: rollups.duration_histogram(d.flights(s, p)),
        sql(f"""SELECT position, bucket, coalesce(n, 0) AS n_flights FROM (VALUES {_bucket_rows()}) b(position, bucket)
            LEFT JOIN (SELECT {_bucket_sql()} AS bucket, count(*) AS n FROM flights WHERE landing IS NOT NULL GROUP BY 1) USING (bucket)"""),
    ),
    "a4_aircraft_stats": (
        lambda s, p: rollups.aircraft_stats(d.aircraft(s, p), d.flights(s, p), _now()),
        sql(f"""WITH st AS (SELECT aircraft_id, any_value(registration) AS registration, count(flight_id) AS n_flights,
              count(*) FILTER (takeoff >= (SELECT tf::DATE - 30 FROM as_of)) AS n_30d, count(*) FILTER (takeoff >= (SELECT tf::DATE - 7 FROM as_of)) AS n_7d,
              (epoch_us(max(takeoff)) // 1000000) AS last_takeoff, coalesce(floor(avg(CASE WHEN flight_id IS NOT NULL THEN {SECS} END) + 0.5)::BIGINT, 0) AS avg_seconds,
              coalesce(round(sum(distance_m), 2), 0) AS total_m FROM aircraft LEFT JOIN flights USING (aircraft_id) GROUP BY 1),
            z AS (SELECT avg(n_30d) AS m, stddev_samp(n_30d) AS sd FROM st WHERE n_30d > 0)
            SELECT st.*, CASE WHEN sd > 0 THEN round((n_30d - m) / sd, 2) ELSE 0 END AS z_score FROM st, z"""),
    ),
    "a6_club_daily": (
        lambda s, p: rollups.club_daily(d.flights(s, p), d.clubs(s, p)),
        sql(f"""SELECT club_id, name, strftime(takeoff, '%Y-%m-%d') AS day, count(*) AS n_flights, count(DISTINCT aircraft_id) AS n_aircraft,
            sum({SECS})::BIGINT AS airtime_seconds, count(*) FILTER (towed) AS n_tows FROM flights JOIN clubs USING (club_id) GROUP BY ALL"""),
    ),
    "a7_airport_daily": (lambda s, p: rollups.airport_daily(d.flights(s, p)), sql(f"WITH {DAILY_AIRPORT_SQL} SELECT * FROM daily")),
    "a8_coverage": (cov, sql(COVERAGE_SQL)),
    "a9_coverage_by_cell": (
        lambda s, p: rollups.coverage_by_cell(cov(s, p)),
        sql(f"""WITH c AS ({COVERAGE_SQL}) SELECT cell, resolution, sum(n_fixes)::BIGINT AS n_fixes, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
            min(min_alt) AS min_alt, max(max_alt) AS max_alt, round(avg(avg_alt), 4) AS avg_alt, (sum(avg_alt * n_fixes) // sum(n_fixes))::BIGINT AS weighted_alt FROM c GROUP BY ALL"""),
    ),
    "a10_merged_coverage": (
        lambda s, p: rollups.merged_coverage(rollups.coverage(d.fixes(s, p).filter("fix_id % 2 = 0"), [5]), rollups.coverage(d.fixes(s, p).filter("fix_id % 2 = 1"), [5])),
        sql(f"""WITH c AS (SELECT h, {CELL} AS cell, r AS resolution, receiver_id, strftime(received_at, '%Y-%m-%d') AS day, count(*) AS n_fixes,
              (epoch_us(min(received_at)) // 1000000) AS first_seen, (epoch_us(max(received_at)) // 1000000) AS last_seen, min(alt_ft) AS min_alt, max(alt_ft) AS max_alt,
              floor(avg(alt_ft) + 0.5)::BIGINT AS avg_alt FROM (SELECT *, 5 AS r, fix_id % 2 AS h FROM fixes) GROUP BY ALL)
            SELECT cell, resolution, receiver_id, day, sum(n_fixes)::BIGINT AS n_fixes, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
              min(min_alt) AS min_alt, max(max_alt) AS max_alt, (sum(avg_alt * n_fixes) // sum(n_fixes))::BIGINT AS avg_alt FROM c GROUP BY ALL"""),
    ),
    "a12_counts_by_receiver": (
        lambda s, p: rollups.grouped_counts(d.fixes(s, p), "receiver_id", "kind"),
        sql("SELECT receiver_id, kind, count(*) AS n FROM fixes GROUP BY ALL"),
    ),
    "a13_unnested_counts": (
        lambda s, p: rollups.grouped_counts(d.table(s, p, "part").select(F.explode(F.split("p_name", " ")).alias("word")), "word"),
        "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1",
    ),
    "a14_grid_clusters": (
        lambda s, p: rollups.grid_clusters(d.fixes(s, p), 5.0),
        sql("""SELECT floor(lat / 5) * 5 AS south, floor(lon / 5) * 5 AS west, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon,
            min(f.lat) AS min_lat, max(f.lat) AS max_lat, min(f.lon) AS min_lon, max(f.lon) AS max_lon FROM fixes f GROUP BY 1, 2"""),
    ),
    "a15_boxes": (
        lambda s, p: rollups.flight_boxes(d.fixes(s, p), "aircraft_id"),
        sql("""SELECT aircraft_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon,
            (epoch_us(min(received_at)) // 1000000) AS created, (epoch_us(max(received_at)) // 1000000) AS last_fix FROM fixes GROUP BY 1"""),
    ),
    "a16_busiest_airports": (
        lambda s, p: rollups.busiest_airports(rollups.airport_daily(d.flights(s, p)), d.airports(s, p), FIRST, LAST, 20),
        sql(f"""WITH {DAILY_AIRPORT_SQL} SELECT slot, sum(departures)::BIGINT AS departures, sum(arrivals)::BIGINT AS arrivals, any_value(ident) AS ident
            FROM daily JOIN (SELECT slot, max(ident) AS ident FROM airports GROUP BY 1) USING (slot) WHERE day BETWEEN '{FIRST}' AND '{LAST}'
            GROUP BY slot ORDER BY sum(departures) + sum(arrivals) DESC, slot LIMIT 20"""),
    ),
    "a17_summary": (
        lambda s, p: rollups.summary(d.flights(s, p), _now()),
        sql(f"""SELECT count(*) AS n_flights, count(*) FILTER (takeoff::DATE = tf::DATE) AS today, count(*) FILTER (takeoff >= tf::DATE - 7) AS n_7d,
            count(*) FILTER (takeoff >= tf::DATE - 30) AS n_30d, coalesce(sum({SECS}) FILTER (takeoff >= tf::DATE - 30), 0)::BIGINT AS seconds_30d,
            count(*) FILTER (landing IS NULL) AS in_progress FROM flights, as_of"""),
    ),
    "a18_home_bases": (
        lambda s, p: rollups.home_bases(d.flights(s, p), d.airports(s, p), 3),
        sql("""WITH n AS (SELECT slot, min(ident) AS ident FROM airports GROUP BY 1), o AS (SELECT aircraft_id, count(*) AS n_flights FROM flights GROUP BY 1 HAVING count(*) >= 3)
            SELECT DISTINCT ON (aircraft_id) aircraft_id, n_flights, ident, n_uses FROM (SELECT aircraft_id, ident, count(*) AS n_uses
              FROM (SELECT aircraft_id, dep AS slot FROM flights UNION ALL SELECT aircraft_id, arr FROM flights) JOIN n USING (slot) GROUP BY ALL) JOIN o USING (aircraft_id)
            ORDER BY aircraft_id, n_uses DESC, ident"""),
    ),
    "a22_update_intervals": (
        lambda s, p: rollups.update_intervals(d.fixes(s, p)),
        sql(f"""SELECT receiver_id, count(*) AS n, round(avg({seconds('b', 'received_at')}), 4) AS avg_gap FROM
            (SELECT *, lag(received_at) OVER (PARTITION BY receiver_id ORDER BY received_at, fix_id) AS b FROM fixes) GROUP BY 1"""),
    ),
    "a24_missing_dimensions": (
        lambda s, p: rollups.missing_dimensions(cov(s, p), "2023-12-25", "2024-02-05", [3, 4, 5]),
        sql("""SELECT strftime(g, '%Y-%m-%d') AS day, r AS resolution FROM generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) t(g), (VALUES (3), (4), (5)) v(r)
            WHERE (strftime(g, '%Y-%m-%d'), r) NOT IN (SELECT strftime(received_at, '%Y-%m-%d'), x FROM fixes, (VALUES (3), (5), (8)) w(x))"""),
    ),
    "x9_rollup_delta": (
        lambda s, p: rollups.rollup_delta(d.flights(s, p), d.flights(s, p).withColumn("takeoff", F.expr("takeoff + INTERVAL 1 DAY"))),
        sql(f"""SELECT strftime(takeoff, '%Y-%m-%d') AS day, sum(s)::BIGINT AS n_flights, sum(s * ({SECS}))::BIGINT AS total_seconds, sum(s * towed::INT)::BIGINT AS n_towed FROM
            (SELECT takeoff, landing, towed, -1 AS s FROM flights UNION ALL SELECT takeoff + INTERVAL 1 DAY, landing, towed, 1 FROM flights) GROUP BY 1"""),
    ),
    "w2_superseded": (
        lambda s, p: tracks.superseded(d.flights(s, p)),
        sql("""SELECT flight_id, aircraft_id, epoch(takeoff + INTERVAL 1 SECOND)::BIGINT AS landed FROM flights WHERE landing IS NULL
            QUALIFY row_number() OVER (PARTITION BY aircraft_id ORDER BY takeoff DESC, flight_id DESC) > 1"""),
    ),
    "w4_neighbours": (
        lambda s, p: tracks.neighbours_in_time(d.flights(s, p)),
        sql("""SELECT flight_id, aircraft_id, lag(flight_id) OVER w AS previous, lead(flight_id) OVER w AS next FROM flights
            WINDOW w AS (PARTITION BY aircraft_id ORDER BY takeoff, flight_id)"""),
    ),
    "w5_gaps": (
        lambda s, p: tracks.gaps(d.fixes(s, p)),
        sql(f"""SELECT aircraft_id, fix_id, next_id, {seconds('received_at', 'nt')} AS gap_s, round({metres('lat', 'lon', 'nlat', 'nlon')}, 2) AS metres, climb_before, climb_after FROM
            (SELECT *, lead(fix_id) OVER w AS next_id, lead(received_at) OVER w AS nt, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon,
              round(avg(climb_fpm) OVER (PARTITION BY aircraft_id ORDER BY received_at, fix_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 4) AS climb_before,
              round(avg(climb_fpm) OVER (PARTITION BY aircraft_id ORDER BY received_at, fix_id ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), 4) AS climb_after
             FROM fixes WINDOW w AS (PARTITION BY aircraft_id ORDER BY received_at, fix_id)) WHERE {seconds('received_at', 'nt')} >= 300"""),
    ),
    "w6_trailing_climb": (
        lambda s, p: tracks.trailing_climb(d.fixes(s, p), 3600),
        sql("""SELECT fix_id, aircraft_id, CASE WHEN floor(epoch(b.t)) - floor(epoch(a.t)) >= 5 THEN
              (sign((b.alt - a.alt) * 60.0 / (floor(epoch(b.t)) - floor(epoch(a.t)))) * floor(abs((b.alt - a.alt) * 60.0 / (floor(epoch(b.t)) - floor(epoch(a.t)))) + 0.5))::BIGINT END AS climb FROM
            (SELECT fix_id, aircraft_id, min({'t': received_at, 'i': fix_id, 'alt': alt_ft}) OVER w AS a, max({'t': received_at, 'i': fix_id, 'alt': alt_ft}) OVER w AS b
             FROM fixes WINDOW w AS (PARTITION BY aircraft_id ORDER BY floor(epoch(received_at))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))"""),
    ),
    "w7_consecutive_inactive": (
        lambda s, p: tracks.consecutive_inactive(d.fixes(s, p), 2),
        sql("""SELECT fix_id, aircraft_id, coalesce(sum(q) OVER (PARTITION BY aircraft_id ORDER BY received_at, fix_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2, false) AS landed
            FROM (SELECT *, (NOT (speed_kt >= 25 OR agl_ft >= 250))::INT AS q FROM fixes)"""),
    ),
    "w9_path_distances": (
        lambda s, p: tracks.path_distances(d.fixes(s, p)),
        sql(f"WITH {STEPS_SQL} SELECT aircraft_id, count(*) AS n, round(sum(step_m), 1) AS metres FROM steps GROUP BY 1"),
    ),
    "t9_gap_sessions": (
        lambda s, p: tracks.gap_sessions(d.fixes(s, p)),
        sql(f"""WITH {STEPS_SQL}, n AS (SELECT *, sum((CASE WHEN gap_s > 7200 THEN true WHEN gap_s <= 1800 THEN false WHEN coalesce(pspeed > 25, false) THEN step_m < 0.3 * pspeed * 0.514444 * gap_s ELSE true END)::INT)
              OVER (PARTITION BY aircraft_id ORDER BY received_at, fix_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM steps)
            SELECT aircraft_id, session, count(*) AS n_fixes, (epoch_us(min(received_at)) // 1000000) AS first, (epoch_us(max(received_at)) // 1000000) AS last FROM n GROUP BY ALL"""),
    ),
    "t21_gap_windows": (
        lambda s, p: d.fixes(s, p).groupBy("aircraft_id", F.session_window("received_at", "30 minutes").alias("w")).agg(F.count("*").alias("n_fixes")).select("aircraft_id", F.unix_timestamp("w.start").alias("first"), "n_fixes"),
        sql(f"""SELECT aircraft_id, (epoch_us(min(received_at)) // 1000000) AS first, count(*) AS n_fixes FROM
            (SELECT *, sum(g) OVER (PARTITION BY aircraft_id ORDER BY received_at, fix_id ROWS UNBOUNDED PRECEDING) AS s FROM
              (SELECT *, coalesce({seconds('lag(received_at) OVER (PARTITION BY aircraft_id ORDER BY received_at, fix_id)', 'received_at')} >= 1800, true)::INT AS g FROM fixes)) GROUP BY aircraft_id, s"""),
    ),
    "j1_flights_by_club": (
        lambda s, p: d.flights(s, p).join(d.clubs(s, p), "club_id").groupBy("name").agg(F.count("*").alias("n")),
        sql("SELECT name, count(*) AS n FROM flights JOIN clubs USING (club_id) GROUP BY 1"),
    ),
    "j3_counts_left_joined": (
        lambda s, p: d.clubs(s, p).join(d.flights(s, p).filter("towed").groupBy("club_id").agg(F.count("*").alias("c")), "club_id", "left").select("club_id", "name", F.coalesce("c", F.lit(0)).alias("n_tows")),
        sql("SELECT club_id, name, coalesce(c, 0) AS n_tows FROM clubs LEFT JOIN (SELECT club_id, count(*) AS c FROM flights WHERE towed GROUP BY 1) USING (club_id)"),
    ),
    "j4_without_flights": (
        lambda s, p: d.aircraft(s, p).join(d.flights(s, p).filter("distance_m > 300000"), "aircraft_id", "left_anti"),
        sql("SELECT * FROM aircraft a WHERE NOT EXISTS (SELECT 1 FROM flights f WHERE f.aircraft_id = a.aircraft_id AND distance_m > 300000)"),
    ),
    "j5_clubs_with_aircraft": (
        lambda s, p: d.clubs(s, p).join(d.aircraft(s, p), "club_id", "left_semi"),
        sql("SELECT * FROM clubs WHERE club_id IN (SELECT club_id FROM aircraft)"),
    ),
    "j12_fixes_of_flights": (
        lambda s, p: tracks.fixes_of_flights(d.fixes(s, p), _trips(s, p)).groupBy("flight_id").agg(F.count("*").alias("n"), F.min("fix_id").alias("first_id")),
        sql("""WITH trips AS (SELECT fix_id AS flight_id, aircraft_id, received_at AS first, received_at + to_minutes(fix_id % 300) AS last FROM fixes WHERE kind = 'click')
            SELECT flight_id, count(*) AS n, min(fix_id) AS first_id FROM trips t JOIN fixes f ON f.aircraft_id = t.aircraft_id AND f.received_at BETWEEN t.first AND t.last GROUP BY 1"""),
    ),
    "j13_latest_fixes": (
        lambda s, p: tracks.latest(d.fixes(s, p), "aircraft_id", "received_at", "fix_id", "lat", "lon").drop("received_at"),
        sql("SELECT DISTINCT ON (aircraft_id) aircraft_id, fix_id, lat, lon FROM fixes ORDER BY aircraft_id, received_at DESC, fix_id DESC"),
    ),
    "j13_as_of": (
        lambda s, p: tracks.as_of_join(d.fixes(s, p).filter("kind = 'purchase'"), d.fixes(s, p).filter("kind = 'view'").groupBy("aircraft_id", "received_at").agg(F.max_by("alt_ft", "fix_id").alias("alt_ft")), "aircraft_id", "received_at", "fix_id", "alt_ft").select("aircraft_id", "fix_id", "found"),
        sql("""SELECT l.aircraft_id, l.fix_id, r.alt_ft AS found FROM (SELECT * FROM fixes WHERE kind = 'purchase') l
            ASOF LEFT JOIN (SELECT DISTINCT ON (aircraft_id, received_at) * FROM fixes WHERE kind = 'view' ORDER BY aircraft_id, received_at, fix_id DESC) r ON l.aircraft_id = r.aircraft_id AND l.received_at >= r.received_at"""),
    ),
    "l3_page_totals": (
        lambda s, p: search.page_with_totals(d.flights(s, p).filter("distance_m > 100000").select("flight_id", "distance_m"), [F.desc("distance_m"), "flight_id"], 25, 2),
        sql("""SELECT flight_id, distance_m, count(*) OVER () AS total_rows, (count(*) OVER () + 24) // 25 AS total_pages, 2 AS page_number
            FROM flights WHERE distance_m > 100000 ORDER BY distance_m DESC, flight_id LIMIT 25 OFFSET 25"""),
    ),
    "l3_page": (
        lambda s, p: search.page(d.flights(s, p).select("flight_id", "aircraft_id", "distance_m"), [F.desc("distance_m"), "flight_id"], 25, 3),
        sql("SELECT flight_id, aircraft_id, distance_m FROM flights ORDER BY distance_m DESC, flight_id LIMIT 25 OFFSET 50"),
    ),
    "f2_fuzzy": (
        lambda s, p: search.fuzzy(d.table(s, p, "part").select("p_partkey", "p_name", "p_type"), "small ring", ["p_name", "p_type"], "p_partkey").select("p_partkey", "score"),
        """WITH g AS (SELECT p_partkey, col, unnest(list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda w: len(w) > 0),
              lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))) AS g FROM
              (SELECT p_partkey, 1 AS col, p_name AS t FROM part UNION ALL SELECT p_partkey, 2, p_type FROM part UNION ALL SELECT -1, 0, 'small ring')),
            q AS (SELECT g FROM g WHERE p_partkey = -1),
            s AS (SELECT p_partkey, col, count(*) AS n, count(*) FILTER (g IN (SELECT g FROM q)) AS b FROM g WHERE p_partkey >= 0 GROUP BY ALL)
            SELECT p_partkey, max(round(b / (n + (SELECT count(*) FROM q) - b), 6)) AS score FROM s GROUP BY 1 HAVING score > 0.05 ORDER BY score DESC, p_partkey LIMIT 50""",
    ),
    "p5_substring": (
        lambda s, p: search.substring(d.table(s, p, "part").select("p_partkey", "p_name", "p_type"), "Ring", ["p_name", "p_type"]),
        "SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%ring%' OR p_type ILIKE '%ring%'",
    ),
    "m4_json": (
        lambda s, p: d.fixes(s, p).select(F.get_json_object("metadata", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n")),
        sql("SELECT (metadata ->> '$.k')::BIGINT AS k, count(*) AS n FROM fixes GROUP BY 1"),
    ),
    "x1_upsert": (
        lambda s, p: merge.upsert(d.aircraft(s, p), d.aircraft(s, p).filter("aircraft_id % 3 = 0").withColumn("registration", F.concat(F.lit("N"), F.col("aircraft_id"))), "aircraft_id"),
        sql("SELECT aircraft_id, CASE WHEN aircraft_id % 3 = 0 THEN 'N' || aircraft_id ELSE registration END AS registration, club_id, category FROM aircraft"),
    ),
    "x2_upsert_keeping": (
        lambda s, p: merge.upsert_keeping(d.aircraft(s, p), d.aircraft(s, p).select((F.col("aircraft_id") + 10).alias("aircraft_id"), F.when(F.col("aircraft_id") % 2 == 0, "").otherwise("new").alias("registration"), F.lit(None).cast("long").alias("club_id"), "category"), "aircraft_id"),
        sql("""SELECT coalesce(a.aircraft_id, b.id) AS aircraft_id, coalesce(nullif(r, ''), registration) AS registration, a.club_id AS club_id, coalesce(nullif(c, ''), a.category) AS category
            FROM aircraft a FULL JOIN (SELECT aircraft_id + 10 AS id, CASE WHEN aircraft_id % 2 = 0 THEN '' ELSE 'new' END AS r, category AS c FROM aircraft) b ON b.id = a.aircraft_id"""),
    ),
    "x4_insert_absent": (
        lambda s, p: merge.insert_absent(d.flights(s, p).select("club_id", "dep").filter("dep < 40").distinct(), d.flights(s, p).select("club_id", "dep"), ["club_id", "dep"]),
        sql("SELECT DISTINCT club_id, dep FROM flights"),
    ),
    "x5_entity_merge": (
        lambda s, p: merge.reassigned(d.flights(s, p).select("flight_id", "aircraft_id"), merge.merged_duplicates(d.aircraft(s, p).withColumn("tail", F.col("aircraft_id") % 100), "aircraft_id", "tail"), "aircraft_id").groupBy("aircraft_id").agg(F.count("*").alias("n")),
        sql("""WITH m AS (SELECT aircraft_id, min(aircraft_id) OVER (PARTITION BY aircraft_id % 100) AS t FROM aircraft)
            SELECT coalesce(t, f.aircraft_id) AS aircraft_id, count(*) AS n FROM flights f LEFT JOIN m USING (aircraft_id) GROUP BY 1"""),
    ),
    "x13_violations": (
        lambda s, p: merge.violations(d.flights(s, p)),
        sql("""SELECT count(*) FILTER (landing < takeoff) AS landing_before_takeoff, count(*) FILTER (distance_m < 0) AS negative_distance,
            count(*) FILTER (aircraft_id IS NULL) AS no_aircraft FROM flights"""),
    ),
    "x14_tow_fees": (
        lambda s, p: merge.tow_fee(_tows(s, p), _tiers(s, p)),
        sql("""WITH tows AS (SELECT fix_id, receiver_id AS club_id, agl_ft AS height_ft FROM fixes), tiers AS (SELECT club_id, m AS max_ft, (m // 100 + club_id)::BIGINT AS fee FROM clubs, (VALUES (1000), (2000), (3000)) t(m)
              UNION ALL SELECT club_id, NULL, 99 FROM clubs WHERE club_id % 2 = 0)
            SELECT fix_id, t.club_id, height_ft, (SELECT fee FROM tiers x WHERE x.club_id = t.club_id AND (max_ft IS NULL OR height_ft <= max_ft) ORDER BY max_ft NULLS LAST LIMIT 1) AS fee FROM tows t"""),
    ),
}


def _trips(s, p):  # noqa: ANN001, ANN202
    return d.fixes(s, p).filter("kind = 'click'").select(
        F.col("fix_id").alias("flight_id"), "aircraft_id", F.col("received_at").alias("first"),
        (F.col("received_at") + F.make_dt_interval(mins=(F.col("fix_id") % 300).cast("int"))).alias("last"),
    )


def _tows(s, p):  # noqa: ANN001, ANN202
    return d.fixes(s, p).select("fix_id", F.col("receiver_id").alias("club_id"), F.col("agl_ft").alias("height_ft"))


def _tiers(s, p):  # noqa: ANN001, ANN202
    clubs = d.clubs(s, p)
    capped = clubs.select("club_id", F.explode(F.array(*map(F.lit, (1000, 2000, 3000)))).alias("max_ft")).withColumn("fee", (F.floor(F.col("max_ft") / 100) + F.col("club_id")).cast("long"))
    return capped.unionByName(clubs.filter("club_id % 2 = 0").select("club_id", F.lit(None).cast("int").alias("max_ft"), F.lit(99).cast("long").alias("fee")))
